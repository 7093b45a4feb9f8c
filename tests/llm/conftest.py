import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHING = ["fp", "ids", "row", "word", "n", "c", "size", "score", "failed", "kind", "part", "payload", "digest", "first", "label"]


@pytest.fixture
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with names that clash."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "the only one without an id", "en", "a", 3), (3, "the man and the dog", "en", "b", 1),
            (3, "the man and the dog", "en", "b", 1), (4, "the man and the dog", "fr", "b", 1), (5, long, "en", "b", 1), (6, " \t\n\x0b\x0c\r ", "en", "b", 1),
            (7, "é" * 5000, "fr", "c", 1), (8, "1234 !!! ???", "fr", "c", 1), (9, "nul\x00 and   and \U0001f600", "de", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
