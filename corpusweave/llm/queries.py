"""The registered query of each operator of this package, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusweave.llm import bottom_k, bpe, byte_cnn, language, main_text, maxent, order_minhash, packing, rules, simhash, spelling, turns, twins, warc
from corpusweave.queries import Family

QUERIES = Family()
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@QUERIES.add()
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), TOKENIZER)


@QUERIES.add()
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


@QUERIES.add()
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(table(spark, folder, "documents"))


@QUERIES.add(sql=r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
windows AS (SELECT doc_id, i, words[i:i + 7] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
same AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM split) WHERE words[i] = words[i + 1] GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(text, '[^a-z]', '', 'g')) AS BIGINT) AS n_lower,
    CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_marks, coalesce(same.n, 0) AS n_stutters
    FROM split LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN same USING (doc_id))
SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
        + 8 * (n_upper > n_lower AND n_upper > 0)::INT + 16 * (10 * n_marks > 3 * n_words)::INT + 32 * (2 * n_dup_lines > n_lines)::INT
        + 64 * (word_chars > 16 * n_words)::INT + 128 * (word_chars < 2 * n_words)::INT + 256 * (10 * n_stutters > 3 * n_words)::INT AS BIGINT) AS failed,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed = 0 AS kept
FROM m
""")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(table(spark, folder, "documents"))


@QUERIES.add()
def op3_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    return byte_cnn.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


@QUERIES.add()
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predictions(table(spark, folder, "documents"))


@QUERIES.add()
def op9_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.edits(table(spark, folder, "documents"))


@QUERIES.add()
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_texts(table(spark, folder, "pages"))


@QUERIES.add(sql="""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
""")
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@QUERIES.add()
def op6_maxent(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.held_out_scores(table(spark, folder, "documents"))


@QUERIES.add(sql=twins.TURNS)
def op11_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.repairs(table(spark, folder, "conversations"))


@QUERIES.add(sql=twins.SPELLING)
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@QUERIES.add(sql=twins.BOTTOM_K)
def op13_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return bottom_k.groups(table(spark, folder, "documents"))
