"""Document fingerprints by Order MinHash, in DataFrame functions only.

The k-mers of a text are runs of ``K`` words, each numbered by its occurrence, so that repeats count. Their hashes are dealt into ``BUCKETS``
equal ranges; in each the ``SELECT`` smallest are selected, put back in the order in which they stand in the text, and the tuple of
them hashed. Two texts agree in a component only if they share the selected k-mers and their order, so moved passages cost likeness, as
they cost edits. Likeness is the share of components that agree among those that either text has.

A fingerprint is an array of at most ``BUCKETS`` longs, the component's bucket in the high bits; equal texts have equal fingerprints. Words
are runs without space or 09-0D, longer ones cut each 16 letters. Texts with fewer than ``K`` words have one k-mer, null and empty texts an empty
fingerprint; two empty ones are alike (1.0). Texts are read whole; beyond 2^23 words the order among the last ones is not kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.functions.text import let
from corpusweave.llm.rows import text_or_empty

K, BUCKETS, SELECT = 3, 64, 2
#: Low bits of a packed k-mer: its position. The rest are the high bits of its hash.
PLACE = 23
LAST = (1 << PLACE) - 1
BUCKET = 58
NO_ID = -(1 << 63)


def _pack(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~LAST)).bitwiseOR(F.least(place.cast("long"), F.lit(LAST)))


def _mark(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE)


def _bucket(value: Column) -> Column:
    return F.shiftrightunsigned(value, BUCKET)


def _kmers(words: Column, k: int) -> Column:
    """Sorted: hash and place of each run of k words."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
    packed = F.transform(places, lambda i: _pack(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(packed))


def _numbered(kmers: Column) -> Column:
    """Number repeats: equal k-mers stand next to each other, the first keeps its hash, each later one takes its number into it."""

    def starts(i: Column) -> Column:
        return (i == 0) | (_mark(F.get(kmers, i - 1)) != _mark(F.get(kmers, i)))

    firsts = F.filter(kmers, lambda x, i: (i == 0) | (_mark(F.get(kmers, i - 1)) != _mark(x)))
    places = F.sequence(F.lit(0), F.size(kmers) - 1)

    def with_repeats(first: Column) -> Column:
        def number(start: Column, again: Column) -> Column:
            # of the places before the j-th repeat i, i - j are starts
            later = F.transform(again, lambda i, j: _pack(
                F.xxhash64(_mark(F.get(kmers, i)), i - F.get(start, i - j - 1)), F.get(kmers, i).bitwiseAND(F.lit(LAST))))
            return F.array_sort(F.concat(first, later))

        return let(F.filter(places, starts), lambda start: let(F.filter(places, lambda i: ~starts(i)), lambda again: number(start, again)))

    return let(firsts, lambda first: F.when(F.size(first) == F.size(kmers), kmers).otherwise(with_repeats(first)))


def _tuples(kmers: Column, select: int) -> Column:
    """One hash per bucket: of its smallest k-mers in text order."""
    chosen = F.filter(kmers, lambda x, i: (i < select) | (_bucket(F.get(kmers, i - select)) != _bucket(x)))

    def heads(few: Column) -> Column:
        def component(x: Column, i: Column) -> Column:
            own = F.filter(F.slice(few, i + 1, select), lambda y: _bucket(y) == _bucket(x))
            in_order = F.array_sort(F.transform(own, lambda y: F.shiftleft(y.bitwiseAND(F.lit(LAST)), 64 - PLACE - 1).bitwiseOR(F.shiftrightunsigned(y, PLACE + 1))))
            hashed = F.xxhash64(F.transform(in_order, lambda y: y.bitwiseAND(F.lit((1 << (64 - PLACE - 1)) - 1))))
            return F.when((i == 0) | (_bucket(F.get(few, i - 1)) != _bucket(x)), F.shiftleft(_bucket(x), BUCKET).bitwiseOR(F.shiftrightunsigned(hashed, 64 - BUCKET)))

        return F.filter(F.transform(few, component), lambda c: c.isNotNull())

    return let(chosen, heads)


def fingerprint(text: Column, k: int = K, select: int = SELECT) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,16}"), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, lambda h: _kmers(h, k)), lambda m: let(_numbered(m), lambda n: _tuples(n, select)))


def likeness(left: Column, right: Column) -> Column:
    both = F.size(F.array_union(F.transform(left, _bucket), F.transform(right, _bucket)))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / both)


def _parts(docs: DataFrame, key: Column, parts: int) -> Column:
    """Which of about ``parts`` equal ranges of the key a row belongs to; the bounds are that many numbers."""
    steps = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(key, steps, 100 * parts)).first()[0] or []
    bounds = sorted(set(found))
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    # first among each width-th bound, then among the few between
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds[width - 1::width])), lambda b: b < key)) * width
    return let(coarse, lambda c: c + F.size(F.filter(F.slice(F.array(*map(F.lit, bounds)), c + 1, F.lit(width)), lambda b: b < key)))


def with_next(docs: DataFrame, key: str, derive: Callable[[DataFrame], DataFrame], columns: list[str], parts: int) -> DataFrame:
    """Each row of ``derive(docs)`` with ``next_`` columns: of the following row by ``key``, after the last of the first.

    Rows are shuffled once, by range of the key; inside a range the next row is a window's lead, and the last row of a range takes
    the first one of the next range. Only the bounds and first keys of the ranges pass the driver, as many as there are ranges.
    """
    ranged = derive(docs).select(key, *columns, _parts(docs, F.col(key), parts).alias("__part"))
    rest = [key, *[c for c in columns if c != key]]
    following = Window.partitionBy("__part").orderBy(*rest)
    led = ranged.withColumn("__next", F.lead(F.struct(*columns)).over(following))
    firsts = sorted(tuple(r) for r in ranged.groupBy("__part").agg(F.min(key)).collect())
    if not firsts:
        firsts = [(0, NO_ID)]
    ahead = [F.struct(F.lit(part).alias("__part"), F.lit(firsts[(i + 1) % len(firsts)][1]).alias("__key")) for i, (part, _) in enumerate(firsts)]
    heads = docs.sparkSession.range(1).select(F.inline(F.array(*ahead)))
    first_rows = derive(docs.join(F.broadcast(heads), F.col(key) == F.col("__key"))).groupBy("__part").agg(F.min(F.struct(*columns)).alias("__first"))
    joined = led.join(first_rows, "__part", "left").withColumn("__next", F.coalesce("__next", "__first"))
    return joined.select(key, *columns, *[F.col(f"__next.{c}").alias(f"next_{c}") for c in columns])


def edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as much of the beginning of the next document by ascending doc_id. Rows without an id
    come first; rows with equal ids follow each other by text. A table of one row is its own next.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text_or_empty())
    half = F.shiftright(F.char_length("text"), 1)
    paired = with_next(rows, "doc_id", lambda df: df.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"], parts)
    edited = paired.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(
        F.expr("left(text, char_length(text) - shiftright(char_length(text), 1))"), F.left(F.col("next_text"), half)).alias("edited"))
    edited = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return edited.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
