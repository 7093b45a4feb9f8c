"""Language identification by known words first and character n-grams for the rest.

A word seen in training adds its log frequency in each language. A word not seen is scored by its characters: at each place the longest
known n-gram that ends there counts, with a penalty for each step to a shorter one. The score of a text is the posterior of the best
language, all languages taken as equally likely.

Fitted on the documents that ``trained_on`` selects, at most ``SAMPLE`` of each language (the first by the hash of their id), and of their
words the ``WORDS`` most frequent ones of each language, of n-grams the ``GRAMS`` most frequent; ties go to the smaller text. Counting
is distributed and aggregated before the shuffle. Text is the only input of a prediction. Texts without a letter, and null ones, are
``und`` with score 0, as is everything if there is nothing to learn from. Equal scores go to the first language by name. Repeated rows get
equal results, texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.llm.rows import fold, map_documents, slices, text_or_empty

SAMPLE, WORDS, GRAMS = 1500, 30_000, 20_000
LONGEST = 5
#: Log10 lost for each character less of context, and the count given to what a language doesn't have.
PENALTY, SMALL = 0.4, 0.1
REMEMBERED, BLOCK = 300_000, 20_000
LETTERS = re.compile(r"[^\W\d_]+")
COUNTS = "lang string, size int, piece string, n long"


def grams(word: str, size: int) -> list[str]:
    edged = f"<{word}>"
    return [edged[i:i + size] for i in range(len(edged) - size + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language: counts of words (size 0) and of the n-grams of their running text."""
    found: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        rows = []
        for lang, words in found.items():
            pieces = Counter()
            for word, n in words.items():
                for size in range(1, LONGEST + 1):
                    for gram in grams(word, size):
                        pieces[size, gram] += n
            rows += [(lang, 0, word, n) for word, n in words.items()]
            rows += [(lang, size, piece, n) for (size, piece), n in pieces.items()]
        found.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()),
                                                                             strict=True)], names=["lang", "size", "piece", "n"])

    for langs, texts in slices(batches):
        for lang, text in zip(langs, texts, strict=True):
            found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        if sum(map(len, found.values())) > 100_000:
            yield from flush()
    yield from flush()


def counts(docs: DataFrame, trained_on: Column, sample: int = SAMPLE) -> DataFrame:
    """lang, size (0 for words), piece, n over the sample: bounded by the sample, kept to the most frequent of each language and size."""
    known = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL").filter(trained_on)
    # a language may hold most rows, so ids are first thinned to about twice the sample by their hash, in every task
    ids = known.select("lang", "doc_id")
    share = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))  # one row per language
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    wanted = drawn <= F.lit(2.0 * sample + 1000) / F.col("total")
    order = Window.partitionBy("lang").orderBy(drawn, "doc_id")
    first = ids.join(F.broadcast(share), "lang").filter(wanted).withColumn("__rank", F.row_number().over(order))
    first = first.filter(F.col("__rank") <= sample).select("doc_id").distinct()  # at most a sample for each language
    picked = known.select("doc_id", "lang", "text").join(F.broadcast(first), "doc_id")
    counted = picked.select("lang", text_or_empty()).mapInArrow(_count, COUNTS).groupBy("lang", "size", "piece").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "piece")
    return counted.withColumn("__rank", F.row_number().over(top)).filter(F.col("__rank") <= F.when(F.col("size") == 0, WORDS).otherwise(GRAMS)).drop("__rank")


@dataclass
class Model:
    langs: list[str]
    rows: list[dict[str, int]] = field(default_factory=list)  # by size, [0] for words: the row of a piece in ``scores``
    scores: np.ndarray | None = None  # rows x languages, with the penalty of an n-gram's size; the last row is for an unknown character

    @classmethod
    def of(cls, counted: pa.Table) -> Model:
        langs = sorted(counted.column("lang").unique().to_pylist())
        model, place, blocks, row = cls(langs), {lang: i for i, lang in enumerate(langs)}, [], 0
        for size in range(LONGEST + 1):
            part = counted.filter(pc.equal(counted.column("size"), size))
            table: dict[str, int] = {}
            at = [table.setdefault(piece, len(table)) for piece in part.column("piece").to_pylist()]
            counts = np.full((len(table), len(langs)), SMALL)
            counts[at, [place[lang] for lang in part.column("lang").to_pylist()]] += part.column("n").to_numpy()
            total = np.maximum(counts.sum(axis=0), 1) + SMALL
            blocks.append(np.log10(counts / total) - PENALTY * (LONGEST - size if size else 0))
            model.rows.append({piece: row + i for piece, i in table.items()})
            row += len(table)
            if size == 1:
                unknown = np.log10(SMALL / total) - PENALTY * LONGEST
        model.scores = np.vstack([*blocks, unknown])
        return model

    def unseen(self, word: str) -> np.ndarray:
        """The n-grams of the word, divided by its length: it counts about as much as a known one."""
        edged, found = f"<{word}>", []
        for end in range(2, len(edged) + 1):  # the sign before the word is context only
            for size in range(min(LONGEST, end), 0, -1):
                row = self.rows[size].get(edged[end - size:end])
                if row is not None:
                    break
            found.append(-1 if row is None else row)
        return self.scores[found].sum(axis=0) / (len(edged) - 1)


class Predictor(dict):
    """Word -> row of its scores: of a known word from the model, of up to ``REMEMBERED`` others as they come up. One per task."""

    def __init__(self, model: Model):
        super().__init__(model.rows[0] if model.langs else ())
        self.model = model
        if model.langs:
            self.scores = np.vstack([model.scores, np.empty((REMEMBERED, len(model.langs)))])
            self.used = len(model.scores)

    def __missing__(self, word: str) -> int:
        self.scores[self.used] = self.model.unseen(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def __call__(self, text: str) -> tuple[str, float]:
        langs, words = self.model.langs, LETTERS.findall(text.lower())
        if not langs or not words:
            return "und", 0.0
        total = np.zeros(len(langs))
        for at in range(0, len(words), BLOCK):
            part = words[at:at + BLOCK]
            if self.used + len(part) > len(self.scores):  # start anew
                self.clear()
                self.update(self.model.rows[0])
                self.used = len(self.model.scores)
            total += self.scores[list(map(self.__getitem__, part))].sum(axis=0)
        best = int(total.argmax())
        return langs[best], float(1 / np.exp(np.clip((total - total[best]) * math.log(10), -700, 0)).sum())


def fit(docs: DataFrame, trained_on: Column, sample: int = SAMPLE) -> Model:
    """The collected rows are bounded: per language WORDS and LONGEST times GRAMS."""
    return Model.of(counts(docs, trained_on, sample).toArrow())


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        predict = Predictor(shared.value)
        return lambda doc_id, text: [(doc_id, *predict(text))]

    return map_documents(docs, ["doc_id", text_or_empty()], schema, start)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 5 is 0), lang_pred, score; the languages of held-out rows aren't read."""
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    rows = identified(docs, fit(docs, ~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
