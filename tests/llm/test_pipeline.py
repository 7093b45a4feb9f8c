import os

import pytest

import __spark_entry__
import corpus_pipeline
from corpusweave.llm import byte_cnn, rules
from corpusweave.llm.rows import fold
from tests.llm.test_bpe import pieces_are_whole
from tests.llm.test_near_copies import groups_of

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    (_, classify), (_, apply_rules), (_, remove_copies), (_, pack) = corpus_pipeline.STAGES
    good = classify(spark, docs, FOLDER).cache()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = byte_cnn.fit(docs, labels, fold("doc_id", 3) != 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, t in texts.items() if model.score(t) >= 0.5}
    sound = apply_rules(spark, good, FOLDER).cache()
    assert {r.doc_id for r in sound.collect()} == {r.doc_id for r in rules.judged(good).filter("kept").collect()}
    single = remove_copies(spark, sound, FOLDER).cache()
    rows = sorted((r.doc_id, r.text) for r in sound.collect())
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[i][0] for i in groups_of([t for _, t in rows])})
    assert good.columns == sound.columns == single.columns == docs.columns
    packed = pack(spark, single, FOLDER).collect()
    pieces_are_whole(packed, {r.doc_id: r.doc_tokens for r in packed})
    assert {r.doc_id for r in packed} == {r.doc_id for r in single.collect()}
    whole = __spark_entry__.queries()["pipeline"](spark, FOLDER)
    assert {(r.doc_id, r.doc_tokens) for r in whole.collect()} == {(r.doc_id, r.doc_tokens) for r in packed}  # cuts depend on the workers


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_stages_take_odd_and_empty_tables(spark, odd_documents, no_documents):
    """Nulls, repeated rows, very long texts and clashing names pass all stages, and so does a table without rows; what a stage keeps has the columns that came."""
    *filters, (_, pack) = corpus_pipeline.STAGES
    for docs in (odd_documents, no_documents):
        columns = docs.columns
        for _, stage in filters:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == columns
        kept = docs.select("doc_id").collect()
        packed = pack(spark, docs, FOLDER).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in kept}
