"""Near copies: texts with at least 0.8 of their 5-word shingles in common (Jaccard, as sets), and one document of each group of them.

SimHash comes first: the fingerprint of each distinct shingle set, and by ball hashing (``simhash.links``) all pairs at most ``RADIUS`` bits apart. Sets of similarity 0.8
differ in about 15 % of the bits, which balls don't reach, so these candidates are the closest copies only. The others come from bottom-k sketches (``bottom_k.links``), which take
the first ones along. Every candidate of either kind is verified on the full sets.

Texts of fewer words than a shingle are one shingle; null and word-free texts are equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import bottom_k, simhash
from corpusweave.llm.components import components
from corpusweave.llm.rows import stored
from corpusweave.plans.bitmaps import bit_is_set, bit_map, leading_bits, part_of
from corpusweave.session import cut

SHINGLE = 5


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set of 63-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), simhash.BLOCK):
        counts += np.unpackbits(shingles[at:at + simhash.BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles)).view(np.int64)[0])


def close_pairs(sets: DataFrame) -> DataFrame:
    """Pairs a, b of keys that connect all sets (key, fp) with fingerprints at most ``simhash.RADIUS`` bits apart."""
    first = cut(sets.groupBy("fp").agg(F.min("key").alias("first")))
    same = sets.select("key", "fp").join(first, "fp").filter("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    near = simhash.links(first.select("fp")).join(first.withColumnRenamed("first", "a"), "fp")
    return same.union(near.join(first.select(F.col("fp").alias("other"), F.col("first").alias("b")), "other").select("a", "b"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group of linked texts, with all its columns. A group keeps one row, so rows with equal ids or none
    count as different documents unless their texts are linked; a null id is smaller than any other.

    Most rows stay and are never shuffled: a bit map, of bounded size, tells which of them must be looked up among those that go or stand twice.
    """
    marked = bottom_k.mark(docs, ["doc_id"], SHINGLE, fp=fingerprint)
    sets = bottom_k.distinct_sets(marked, "fp")
    found = components(bottom_k.links(sets, docs, SHINGLE, close_pairs(sets)), "a", "b").withColumnRenamed("node", "key")
    order = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "text_a")
    classes = marked.groupBy("key").agg(F.min(order).alias("least")).join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = classes.groupBy("root").agg(F.min("least").alias("least"))
    of_key = classes.select("key", "root").join(least, "root").select("key", "least")
    name = F.xxhash64("doc_id", "text_a").alias("__name")
    rows = marked.groupBy("doc_id", "text_a", "key").agg(F.count(F.lit(1)).alias("n")).join(of_key, "key")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_a") == F.col("least.text_a"))
    looked_up = stored(rows.select(name, F.col("doc_id").alias("__id"), F.col("text_a").alias("__text"), stays.alias("__stays"), "n").filter("NOT __stays OR n > 1").drop("n"), "not-kept")

    power = leading_bits(looked_up.count())
    parts = stored(bit_map(looked_up.select("__name"), power).toDF("__part", "__bits"), "bit-map")  # at most 64 MB
    named = docs.select("*", bottom_k.text_id().alias("__text_a")).select("*", F.xxhash64("doc_id", "__text_a").alias("__name"))
    named = named.withColumn("__part", part_of("__name", power)).join(F.broadcast(parts), "__part", "left").withColumn("__maybe", bit_is_set("__bits", "__name", power))
    passed = named.filter("NOT __maybe").select(*docs.columns)
    asked = named.filter("__maybe").join(looked_up.withColumnRenamed("__name", "__their"), (
        F.col("__name") == F.col("__their")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_a") == F.col("__text")), "left")
    once = asked.filter("__stays").dropDuplicates(["__name", "__id", "__text"]).select(*docs.columns)
    return passed.union(asked.filter("__stays IS NULL").select(*docs.columns)).union(once)
