"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a value between them at most half the radius from both. So every distinct
fingerprint emits all values in the ball of half the radius around it, values are brought together by a shuffle, and fingerprints
that share one are linked. All members of a bucket are within the radius of each other, so a chain through the sorted bucket
links them all; a bucket holds at most a ball of fingerprints (65 for radius 2), however many documents there are, because equal
fingerprints count once.

Null and word-free texts have fingerprint zero and are linked like any other. Rows without an id count as one with the smallest id. Repeated
rows get equal results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.llm.components import components
from corpusweave.llm.rows import map_documents, text_or_empty, word_windows
from corpusweave.session import cut

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
NO_ID = -(1 << 63)
BLOCK = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the XXH64 of the word shingles, repeats included; bytes.split takes just space and 09-0D."""
    words = text.encode().lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined, starts, ends = word_windows(words, width)
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), BLOCK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[at:at + BLOCK], ends[at:at + BLOCK], strict=True)]
        counts += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def start():
        return lambda doc_id, text: [(doc_id, (value := fingerprint(text, shingle)) - (value >> 63 << 64))]

    return map_documents(docs, ["doc_id", text_or_empty()], schema, start)


def ball(radius: int) -> list[int]:
    """All masks of up to ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for size in range(radius + 1) for bits in combinations(range(BITS), size)]
    return [m - (m >> 63 << 64) for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs fp, other of distinct fingerprints at most ``radius`` bits apart that connect all such pairs."""
    if radius % 2:
        raise ValueError("the radius is even: two balls of half of it meet in the middle")
    near = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in ball(radius // 2)])).alias("mask"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    bucket = Window.partitionBy("value").orderBy("fp")
    met = near.withColumn("other", F.lag("fp").over(bucket)).filter("other IS NOT NULL").select("fp", "other").distinct()
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)


def groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included."""
    marks = cut(fingerprints(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text"), shingle))
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp"), radius), "fp", "other")
    classes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = classes.join(least, "root").select("fp", "component_id")
    named = [F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("doc_id", "component_id")]
    return marks.join(of_print, "fp").select(named[0], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named[1])
