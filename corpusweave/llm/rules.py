"""Quality rules as a ledger of bitmasks.

Every rule is evaluated once per document over integer measurements; the ledger keeps the measurements and one bit per failed rule. A policy is
a versioned set of rules: a document passes if none of its failure bits is in the policy's mask. New policies, and what a
policy would keep without one of its rules, are answered from the ledger by bit operations, without reading texts again.

Null and empty texts measure zero everywhere and fail ``few_words``. Texts of any length are measured whole; repeated rows get
repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.rows import add_struct, map_documents, text_or_empty, word_windows

WINDOW = 8
BLOCK = 1 << 15
SPACES, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks", "n_stutters"]

#: Rule -> when it fails, as SQL over the measurements. The place of a rule is its bit, so rules are only ever added at the end.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "capitals": "n_upper > n_lower AND n_upper > 0",
    "exclamations": "10 * n_marks > 3 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 16 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "stutters": "10 * n_stutters > 3 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policies by version; a published one is not changed.
POLICIES = {
    "2026-01": BASE,
    "2026-02": (*BASE, "symbols", "capitals", "exclamations", "duplicate_lines", "long_words", "short_words", "stutters"),
}
CURRENT = "2026-02"


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more. Windows whose 64-bit hash recurs are compared byte by byte."""
    if len(words) <= width:
        return 0
    joined, starts, ends = word_windows(words, width)
    hashes, digest = np.empty(len(ends), np.uint64), xxhash.xxh3_64_intdigest
    for at in range(0, len(ends), BLOCK):
        part = [digest(joined[s:e]) for s, e in zip(starts[at:at + BLOCK], ends[at:at + BLOCK], strict=True)]
        hashes[at:at + BLOCK] = np.array(part, np.uint64)
    _, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
    maybe = np.nonzero(count[place] > 1)[0].tolist()
    if not maybe:
        return 0
    exact = Counter((joined[starts[i]:ends[i]]) for i in maybe)
    steps = np.zeros(len(words) + 1, np.int64)
    sure = np.array([i for i in maybe if exact[joined[starts[i]:ends[i]]] > 1], np.int64)
    steps[sure] += 1
    steps[sure + width] -= 1
    return int((np.cumsum(steps) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()

    def how_many(letters: bytes) -> int:
        return len(raw) - len(raw.translate(None, letters))

    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return (len(words), len(text) - how_many(SPACES), how_many(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines),
            how_many(UPPER), how_many(LOWER), raw.count(b"!"), sum(map(eq, words, islice(words, 1, None))))


def failure_bits(struct: str = "") -> Column:
    """Bit i is set if rule i fails, over measurements that are columns or fields of a struct column."""
    rules = [re.sub("|".join(MEASURES), lambda m: f"{struct}.{m[0]}", rule) if struct else rule for rule in RULES.values()]
    return reduce(Column.bitwiseOR, (F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules)))


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(rule) for rule in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit i is set if rule i fails."""
    schema = pa.schema([("doc_id", pa.int64())] + [(m, pa.int64()) for m in MEASURES])

    def start():
        return lambda doc_id, text: [(doc_id, *measure(text))]

    return map_documents(docs, ["doc_id", text_or_empty()], schema, start).withColumn("failed", failure_bits())


def passes(policy: str = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rule, failed (documents that fail it), only (that fail nothing else of the policy), kept_without: one row per rule of the policy.

    The ledger is first counted by its masks, of which there are few whatever the number of documents.
    """
    whole = F.lit(mask(POLICIES[policy]))
    masks = rows.groupBy(F.col("failed").bitwiseAND(whole).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r in POLICIES[policy]]
    each = masks.select("bits", "n", F.inline(F.array(*rules)))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def judged(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``: false if a base rule or a rule of the policy fails."""
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(docs).withColumn("base_failed", base).withColumn("kept", ~base & passes(policy))


def with_ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with all their columns, the measurements (struct ``__measured``) and the failure bits (``__failed``) of every rule, in one pass over
    the texts: no join back to them. Kept as a table, it answers any later policy."""
    measured = add_struct(docs, "text", "__measured", pa.schema([(m, pa.int64()) for m in MEASURES]), lambda: measure)
    return measured.withColumn("__failed", failure_bits("__measured"))


def without_failures(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass by the mask of the policy, with all their columns."""
    return with_ledger(docs).filter(passes(policy, "__failed")).drop("__measured", "__failed")
