"""Near-duplicates by bottom-k sketches from one hash function.

A document is the set of its distinct word shingles, as 63-bit hashes. Its sketch keeps the ``K`` smallest. Steps:

1. Equal sets count once from here on, however many copies there are.
2. Every retained value is counted over all sets. A value found once links nothing; of the others each set indexes only its rarest, so many
   that two similar sets must meet: they share ``least_shared`` retained values or more, so all but that many, less one, can be left out.
   A passage that a third of all documents hold comes last in this order, so it is a key only for sets which consist of little else.
3. In each inverted list every set is held against one hub, the set whose values are the most common. Lists make as many pairs as they have rows.
4. A pair is dropped if the bottom k of its union leave no hope for the similarity, and else verified on the full sets.
5. Sets of lists whose members still lie in different components are taken once more, now by the rarest values of their full sets: similar sets of n and m shingles share ``s = ceil(4 (n + m) / 9)`` or more, so one of the ``n - s + 1`` rarest of the one is among the ``m - s + 1`` rarest of
   the other. That is exact, and sets which share a long passage but not enough of it meet in none of these. Each is held against hubs first; then
   lists whose members still lie apart are joined with themselves, without pairs of one component.

Where both sets have at most ``K`` shingles step 2 is exact. Otherwise the shared part of a sketch is a random draw, and ``least_shared`` lies 4 standard
deviations below its mean at the similarity itself; even then a pair is missed only if what it doesn't share is also the rarest of what it has.

Sets are told apart by 64 bits of their hashes. Texts without words have the empty set, whose size is 0 and which is linked with nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.components import compact, components
from corpusweave.llm.rows import SLICE, Memo, map_documents, slices, text_or_empty
from corpusweave.plans.bitmaps import bit_map, leading_bits
from corpusweave.session import cut, new_table_path

SHINGLE, K, SEED = 4, 64, 42
#: The similarity as a fraction, so that the border is exact.
PART, WHOLE = 4, 5
SIGMAS = 4.0
NO_ID = -(1 << 63)
REMEMBERED = 1 << 16
MIX = np.array([0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
MARK = [pa.field("key", pa.int64()), pa.field("size", pa.int64()), pa.field("sketch", pa.list_(pa.int64()))]


def shingler(width: int) -> Callable[[str], np.ndarray]:
    """A function that gives the distinct shingles of a text as sorted 63-bit hashes. bytes.split takes just space and 09-0D, bytes.lower just A-Z."""
    word_hash = Memo(lambda w: xxhash.xxh64_intdigest(w, SEED), REMEMBERED)

    def shingles(text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.int64)
        each = np.array(list(map(word_hash.__getitem__, words)), np.uint64)
        n = max(1, len(each) - width + 1)
        found = np.full(n, min(width, len(each)), np.uint64)
        for i in range(min(width, len(each))):
            found = (found ^ each[i:i + n]) * MIX[0]
            found ^= found >> np.uint64(29)
        for factor in MIX[1:]:
            found *= factor
            found ^= found >> np.uint64(32)
        return np.unique(found >> np.uint64(1)).view(np.int64)

    return shingles


def key_of(shingles: np.ndarray) -> int:
    value = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return value - (value >> 63 << 64)


def text_id() -> Column:
    """Names a text; where another one has the same name, the key of its set tells them apart."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_a")


def mark(docs: DataFrame, columns: list[str], width: int = SHINGLE, **more: Callable[[np.ndarray], int]) -> DataFrame:
    """``columns``, text_a, key, size, sketch of every row, written and read again; and what functions named in ``more`` give for its set."""
    spark, given = docs.sparkSession, docs.select(*columns, text_id(), text_or_empty("text"))
    schema = pa.schema([*(pa.field(c, pa.int64()) for c in columns), pa.field("text_a", pa.int64()), *MARK, *(pa.field(m, pa.int64()) for m in more)])

    def start():
        shingles = shingler(width)

        def each(*values):
            found = shingles(values[-1])
            return [(*values[:-1], key_of(found), len(found), found[:K], *(fn(found) for fn in more.values()))]

        return each

    path = new_table_path(spark, "sketches")
    map_documents(given, given.columns, schema, start).write.parquet(path)
    return spark.read.parquet(path)


def distinct_sets(marked: DataFrame, *more: str) -> DataFrame:
    """key, size, sketch, text_a (of one of its texts) of each set that isn't empty."""
    return cut(marked.filter("size > 0").groupBy("key").agg(F.min("text_a").alias("text_a"), *(F.first(c).alias(c) for c in ("size", "sketch", *more))))


def least_shared(size: Column) -> Column:
    """Retained values that a set of this size shares with any similar one at least (see above)."""
    drawn = int(PART / WHOLE * K - SIGMAS * (K * PART / WHOLE * (1 - PART / WHOLE)) ** 0.5)
    whole = F.ceil(size * PART / WHOLE)
    return F.when(size * WHOLE <= K * PART, whole).otherwise(F.least(whole, F.lit(drawn)))


def rarest(points: DataFrame, sizes: DataFrame, keep: Column) -> DataFrame:
    """key, size, weight, alone (how many values stand in no other set; they come first) and the rest of the ``keep`` rarest ``values`` of each set. ``keep`` may use
    ``size`` and ``total``, the number of values of the set in ``points``."""
    counted = points.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = points.join(counted, "value").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("values"), F.sum("n").alias("weight"))
    counted = shared.join(sizes, "key").withColumn("alone", F.col("total") - F.size("values"))
    cutoff = F.greatest(F.lit(0), keep - F.col("alone")).cast("int")
    return counted.select("key", "size", "weight", "alone", F.slice("values", F.lit(1), cutoff)["value"].alias("values"))


def fits(one: str, two: str) -> Column:
    """Sets of these sizes may be similar."""
    return F.lit(WHOLE) * F.least(one, two) >= F.lit(PART) * F.greatest(one, two)


def hopeful(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b without those that the bottom k of their union rule out."""
    one, two = (sets.select(F.col("key").alias(side), F.col("sketch").alias(f"of_{side}")) for side in "ab")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (of_a, of_b), keep = (batch.column(i) for i in (2, 3)), []
            for x, y in zip(of_a, of_b, strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = both[1:] == both[:-1]
                # up to the smaller of the largest values both sketches are complete, if they are cut at all
                end = min((s[-1] for s in (x, y) if len(s) == K), default=both[-1])
                shared = int(same[both[1:] <= end].sum())
                k = int((both <= end).sum()) - shared
                slack = SIGMAS * (k * PART * (WHOLE - PART)) ** 0.5 if len(x) == K or len(y) == K else 0
                keep.append(WHOLE * shared >= PART * k - slack)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(work, "a long, b long")


def text_bits(wanted: DataFrame) -> np.ndarray:
    """A bit map of the texts of ``wanted``, at most 64 MB."""
    power = leading_bits(wanted.count())
    parts = bit_map(wanted.select("text_a"), power)
    out = np.zeros(1 << power - 3, np.uint8)
    for part, bits in parts.collect():
        out[part << 12:(part << 12) + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def full_sets(keys: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """key, hashes (the whole set as bytes) of ``keys``, from the texts again. Texts stay where they are: a bit map tells which to look at, and only sets are
    shuffled; a set that isn't wanted, which the bit map let pass, goes then."""
    wanted = compact(sets.join(keys, "key", "left_semi").select("key", "text_a"))
    bits = docs.sparkSession.sparkContext.broadcast(text_bits(wanted))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known, done = shingler(width), bits.value, set()
        shift = np.uint64(64 - (len(known).bit_length() + 2))
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> shift
            found = np.flatnonzero(known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            for begin in range(0, len(found), SLICE):
                part, out = batch.take(pa.array(found[begin:begin + SLICE])), []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if name not in done:  # copies of one text
                        done.add(name)
                        of_text = shingles(text)
                        out.append((key_of(of_text), of_text.tobytes()))
                if len(done) > REMEMBERED:
                    done.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["key", "hashes"])

    found = docs.select(text_id(), text_or_empty("text")).mapInArrow(work, "key long, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))
    return cut(found.join(wanted.select("key"), "key", "left_semi"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """a and b are sorted and distinct."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return WHOLE * shared >= PART * (len(both) - shared)


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Of pairs a, b those whose full sets are similar."""
    one, two = (full.select(F.col("key").alias(side), F.col("hashes").alias(f"of_{side}")) for side in "ab")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, of_a, of_b in slices(batches):
            ok = [similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(of_a, of_b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, keep in zip(c, ok, strict=True) if keep], pa.int64()) for c in (a, b)], names=["a", "b"])

    return compact(pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(work, "a long, b long"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def values_of(full: DataFrame) -> DataFrame:
    """key, value: every shingle of full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(raw.as_buffer(), np.int64)
                for at in range(0, len(values), 1 << 16):
                    part = values[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(part)], names=["key", "value"])

    return full.select("key", "hashes").mapInArrow(work, "key long, value long")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """Pairs a, b of each set and the hub of each list (key, size, weight, value) that it stands in: the set whose values are the most common."""
    hubs = lists.groupBy("value").agg(F.max(F.struct("weight", "key", "size")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = lists.join(hubs.select("value", "hub.key", "hub.size").toDF("value", "hub", "hub_size"), "value")
    return met.filter(fits("size", "hub_size")).select(F.col("key").alias("a"), F.col("hub").alias("b"))


def rooted(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``lists`` with the root of each key, without lists whose keys all have one root."""
    root = components(links, "a", "b").withColumnRenamed("node", "key")
    whole = lists.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = whole.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return compact(whole.join(apart.select("value"), "value"))


def links(sets: DataFrame, docs: DataFrame, width: int = SHINGLE, more: DataFrame | None = None) -> DataFrame:
    """Pairs a, b of keys with similar sets that connect all such pairs. ``more`` may hold further candidates a, b."""
    sizes = sets.select("key", "size", F.least("size", F.lit(K)).alias("total"))
    points = sets.select("key", F.explode("sketch").alias("value"))
    lists = compact(rarest(points, sizes, F.col("total") - least_shared(F.col("size")) + 1).select("key", "size", "weight", F.explode("values").alias("value")))
    pairs = hub_pairs(lists)
    pairs = compact(hopeful(ordered(pairs.union(more) if more is not None else pairs), sets))
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    found = verified(pairs, full_sets(keys, sets, docs, width))

    # what is left is done exactly
    open_keys = compact(rooted(lists.select("key", "value"), found).select("key").distinct())
    full = full_sets(open_keys, sets, docs, width)
    sizes = sets.join(open_keys, "key", "left_semi").select("key", "size", F.col("size").alias("total"))
    rare = rarest(values_of(full), sizes, F.col("size") - F.ceil(F.col("size") * PART / WHOLE) + 1)
    lists = compact(rare.select("key", "size", "weight", "alone", F.posexplode("values").alias("at", "value")).withColumn("at", F.col("at") + F.col("alone")).drop("alone"))
    found = found.union(verified(hopeful(ordered(hub_pairs(lists)), sets), full))
    lists = rooted(lists, found)
    small, large = (lists.select("value", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "size", "root", "at"))) for side in "ab")
    # the first common value leaves as many behind it, in either set, as they must share at least
    shared = F.ceil((F.col("size_a") + F.col("size_b")) * PART / (PART + WHOLE))
    ahead = (F.col("at_a") <= F.col("size_a") - shared) & (F.col("at_b") <= F.col("size_b") - shared)
    before = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("key_a") < F.col("key_b")))
    pairs = small.join(large, "value").filter(before & fits("size_a", "size_b") & ahead & (F.col("root_a") != F.col("root_b")))
    pairs = hopeful(ordered(pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))), sets)
    return found.union(verified(pairs, full))


def groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included), kept (doc_id is the component's) of every row.

    Null, empty and word-free texts have no shingles and are linked with nothing. Rows without an id count as one with the smallest id; rows with
    equal ids are told apart by their texts, repeated rows get equal results.
    """
    marked = mark(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text"), ["doc_id"], width)
    found = components(links(distinct_sets(marked), docs, width), "a", "b").withColumnRenamed("node", "key")
    least = marked.filter("size > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = least.join(roots, "root").select("key", "component_id")
    whole = marked.select("doc_id", "key", "size").join(of_key, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    named = [F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("doc_id", "component_id")]
    return whole.select(named[0], F.col("size").alias("n_shingles"), named[1], (F.col("doc_id") == F.col("component_id")).alias("kept"))
