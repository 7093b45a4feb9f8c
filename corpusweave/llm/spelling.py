"""Spelling variants of words, found by walking a trie that is a table, level by level.

The trie over all words is never built as a structure. At level i its edges are rows (node, ch, child): a node is the prefix of i code points that
at least two words share. States (word, pos, node, edits) lie in a frontier:

* without an edit, a word stands at its own prefix; it branches into states with one edit: another, larger ``ch`` (the smaller ones come from the
  other word), or one code point of the word left out (the longer word of a pair finds the shorter one);
* with one edit, a state follows the one edge of its next code point, by a join on (node, ch).

A state ends where its node is a word and nothing of its own word is left, and also where only one word is left below its node: the rest is compared at
once. So there are as many levels as two different words have first code points in common, however long they are beyond that. Words of over ``LONG`` code
points, which could make that many levels, are joined by halves instead: one edit leaves the first or the last half of a word as it is.

The root is a hot key of one side of the joins; its edges are one row per letter. Frontiers are written to the shared folder at each level.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.rows import slices, stored, text_or_empty
from corpusweave.session import new_table_path

LEAST_CHARS, LEAST_COUNT, DAMAGED, TIMES, LONG = 6, 5, 199, 5, 32
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_CHARS)
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
FLUSH = 300_000


def words_of(doc_id: int | None, text: str) -> Counter[str]:
    """Lower-cased runs of a text with their counts; of one run in ``DAMAGED``, by a crc32, one code point is gone. Runs too short to be words are left out."""
    found: Counter[str] = Counter()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_CHARS:
                continue
        found[run] += n
    return found


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all whole texts (null: none), for words found often enough; each task adds up what it has before the shuffle. A null id
    counts as the empty string."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for ids, texts in slices(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                held.update(words_of(doc_id, text))
                if len(held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    counted = docs.select("doc_id", text_or_empty()).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def edges_at(alive: DataFrame, level: int) -> DataFrame:
    """node, ch, child, words (below the child), only (the smallest of them), ends (the child is a word) of a level."""
    return alive.groupBy("node", F.substring("word", level + 1, 1).alias("ch")).agg(
        F.count(F.lit(1)).alias("words"), F.min("word").alias("only"), F.max(F.length("word") == level + 1).alias("ends")
    ).withColumn("child", F.concat("node", "ch"))


def near_in_trie(words: DataFrame) -> DataFrame:
    """word, other: pairs with one edit between them, each once, of the words of ``words``, which are different."""
    spark = words.sparkSession
    path = new_table_path(spark, "spelling-pairs")
    alive = stored(words.select("word", F.lit("").alias("node"), F.lit(False).alias("ends")), "frontier")
    edited = spark.createDataFrame([], "word string, pos int, node string")
    level = 0
    while not (longer := alive.filter(F.length("word") > level)).isEmpty():
        edges = stored(edges_at(longer, level), "trie-edges")
        left_out = longer.select("word", F.lit(level + 1).alias("pos"), "node", "ends")
        last = left_out.filter(F.col("ends") & (F.length("word") == F.col("pos"))).select("word", F.col("node").alias("other"))
        reached = ["word", F.col("pos") + 1, "child", "words", "only", "ends"]
        going = edited.union(left_out.drop("ends")).filter(F.length("word") > F.col("pos")).withColumn("ch", F.expr("substring(word, pos + 1, 1)"))
        followed = going.join(edges, ["node", "ch"]).select(*reached)
        branching = longer.select("word", "node", F.lit(level).alias("pos"), F.substring("word", level + 1, 1).alias("own"))
        replaced = branching.join(edges, "node").filter(F.col("ch") > F.col("own")).select(*reached)
        moved = stored(followed.union(replaced).toDF("word", "pos", "node", "words", "only", "ends"), "frontier")
        rest, of_only = F.expr("substring(word, pos + 1)"), F.substring("only", level + 2, LONG)
        alone = moved.filter("words = 1").filter(rest == of_only).select("word", F.col("only").alias("other"))
        here = moved.filter("words > 1 AND ends").filter(F.length("word") == F.col("pos")).select("word", F.col("node").alias("other"))
        last.union(alone).union(here).write.mode("append").parquet(path)
        edited = moved.filter("words > 1").select("word", "pos", "node")
        own = longer.select("word", F.substring("word", 1, level + 1).alias("child"))
        alive = stored(own.join(edges.filter("words > 1").select("child", "ends"), "child").select("word", F.col("child").alias("node"), "ends"), "frontier")
        level += 1
    pairs = spark.read.parquet(path) if level else spark.createDataFrame([], "word string, other string")
    return pairs.distinct()


def near_by_halves(words: DataFrame) -> DataFrame:
    """word, other: pairs with one edit between them, each once; for long words. Of two such words, ``c`` code points at the front or at the end
    are the same, where c is half the length of the shorter one."""
    length = F.length("word")
    shorter = F.array(*[F.floor(n / 2).cast("int") for n in (length, length - 1)])
    halves = words.select("word", F.explode(F.array_distinct(shorter)).alias("c"))
    keyed = halves.select("word", "c", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.expr("left(word, c)").alias("half")), F.struct(F.lit(1).alias("side"), F.expr("right(word, c)").alias("half")))))
    other = keyed.withColumnRenamed("word", "other")
    return keyed.join(other, ["c", "side", "half"]).filter("word < other").filter(F.levenshtein("word", "other", 1) == 1).select("word", "other").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """word, other: all pairs of different words with exactly one inserted, deleted or replaced code point, each both ways."""
    short = near_in_trie(words.filter(F.length("word") <= LONG))
    long = near_by_halves(words.filter(F.length("word") >= LONG)).filter(F.greatest(F.length("word"), F.length("other")) > LONG)
    pairs = short.union(long)
    return pairs.union(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where following ``form`` ends, for words that have one. A form is at least ``TIMES`` as frequent as its word, so chains are short;
    each round doubles the length that is followed."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = at.alias("x").join(at.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        moved = stored(further.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: ``form`` is its most frequent near word (ties: the smallest in code-point order), if that is found
    ``TIMES`` times as often as the word, ``root`` where forms end."""
    words = stored(count_words(docs), "words")
    of_other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = near_words(words.select("word")).join(of_other, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    best = F.when(-F.col("best.rank") >= TIMES * F.col("n"), F.col("best.other"))
    known = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best.alias("form"),
                                                        F.when(best.isNotNull(), -F.col("best.rank")).alias("form_n")), "variants")
    roots = last_forms(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
