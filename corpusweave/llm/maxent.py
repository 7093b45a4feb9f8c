"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) P(word | class, history). Both factors are softmaxes over hashed features. That of the class: the word before, the
two before together, skips to the second and third before, and the classes of the three before. That of the word, over all words of its class: the word
before, the one before that and both together, each along with the class. There a word's weights are those of its slot: the ``OWN`` most frequent words of a
class have one each, the others are hashed to the rest. Without weights the factors are the base model's shares, with its smoothing, so that they cover
unseen words too; words of one slot differ by these shares alone, so the sum over a class is one over slots, and exact.

Counts come from all training documents and stay a table; only the ``HEAD`` most frequent words, of which there are no more however large
the corpus, go to every task. Rarer words are counted and looked up by joins, in which no key is hot: hot words are in the head.

Classes: the ``SEEDS`` most frequent words are clustered by which of the ``CONTEXTS`` most frequent words stand near them in all training documents; any other
word takes the cluster for which its letters speak, known from the seeds; words of a cluster are divided by frequency.

Coding: once the classes are known, each text is split and looked up once and written as numbers (``code``); training and scores read these. Classes of rare
words are found for all such words of a slice of texts together.

Training: in each of ``ROUNDS`` rounds every task starts from the common weights, follows the gradient over its own training documents of that
round, and gives back weights and how often it met each feature; these are averaged, feature by feature, in blocks.

Null and empty texts are the end token alone. Without training documents the model is the base. Texts are scored whole; repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.rows import Memo, fold, slices, stored, text_or_empty

END = b""
HEAD, SEEDS, CONTEXTS, NEAR = 1 << 17, 2048, 256, 4
TOPICS, BANDS = 8, 3
CLASSES = TOPICS * BANDS
#: Words that have features of their own; rarer ones count as their class there.
FEATURED = 1 << 13
ROW_BITS, BLOCK = 14, 1 << 9
ROWS = 1 << ROW_BITS
FEATURES = 5
#: The word factor: slots of a class, those of one word, and which features it takes.
SLOTS, OWN = 32, 24
INNER, INNER_BITS = (0, 1, 3), 15
INNER_ROWS = 1 << INNER_BITS
ROUNDS, RATE, BATCH, SCORED, BOUND = 2, 0.15, 8192, 2048, 15.0
FLUSH, REMEMBERED = 300_000, 300_000
#: Equal features of a batch whose gradients are summed side by side, up to so many.
SHORT = 8
#: Odd multipliers of the feature hash.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def tokens(text: str) -> list[bytes]:
    """A-Z in lower case, words between space and 09-0D, one end. bytes.lower and bytes.split know just these."""
    words = text.encode().lower().split()
    words.append(END)
    return words


# ---- counts

def count_words(docs: DataFrame) -> DataFrame:
    """word, c over all texts; each task adds up what it has before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])
            found.clear()
            return out

        for (texts,) in slices(batches):
            for text in texts:
                found.update(tokens(text))
            if len(found) >= FLUSH:
                yield flush()
        if found:
            yield flush()

    return docs.select(text_or_empty()).mapInArrow(work, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


# ---- sums of number blocks over tasks

def sum_blocks(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of ``values`` (float32, as bytes) by ``block``. Each task of the sum adds up rows as they arrive; the result is as large as one row of each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for blocks, values in slices(batches, 16):
            for block, raw in zip(blocks, values, strict=True):
                values = np.frombuffer(raw, np.float32)
                total.setdefault(block, np.zeros(len(values))).__iadd__(values)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["block", "values"])

    kinds = "block long, values binary"
    return {r["block"]: np.frombuffer(bytes(r["values"]), np.float32) for r in rows.repartition("block").mapInArrow(work, kinds).collect()}


# ---- classes

@dataclass
class Vocabulary:
    """The head and the classes of all words."""

    words: list[str]
    counts: np.ndarray
    total: int
    distinct: int
    classes: np.ndarray | None = None  # of the words
    slots: np.ndarray | None = None  # of the words, in their class
    grams: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def mass(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def finish(self, vectors: np.ndarray) -> Vocabulary:
        """Topics of the seeds by k-means over their neighbours, and from them what letters say."""
        seeds = cluster(vectors)
        grams: dict[str, np.ndarray] = {}
        for word, topic in zip(self.words, seeds, strict=False):
            for size in (2, 3, 4):
                edged = f"<{word}>"
                for i in range(len(edged) - size + 1):
                    grams.setdefault(edged[i:i + size], np.full(TOPICS, 0.1))[topic] += 1
        self.grams = {g: np.log(n / n.sum()) for g, n in grams.items()}
        share = self.counts / max(1, self.total)
        band = np.where(share > 2e-3, 0, np.where(share > 1e-4, 1, 2))
        self.classes = np.concatenate([seeds, Letters(self.grams).topics(self.words[len(seeds):])]) * BANDS + band
        before, slots = [0] * CLASSES, []  # words are in order of their counts
        for word, kind in zip(self.words, self.classes.tolist(), strict=True):
            slots.append(before[kind] if before[kind] < OWN else slot_of_rare(word))
            before[kind] += 1
        self.slots = np.array(slots, np.int64)
        return self


class Letters:
    """What letters say of words: at each place the longest known gram of 4, 3 or 2 counts. With a gram, ``grams`` has those that it begins with."""

    def __init__(self, grams: dict[str, np.ndarray]):
        row, self.levels = {g: i for i, g in enumerate(grams)}, []
        self.says = np.array([*grams.values(), np.zeros(TOPICS)]).T.copy()
        for size in (2, 3, 4):  # steps from a gram (at first a letter) to one that is longer by a letter
            steps = sorted((((row[g[:-1]] if size > 2 else ord(g[0])) << 21 | ord(g[-1]), i) for g, i in row.items() if len(g) == size))
            self.levels.append((np.array([s for s, _ in steps] + [1 << 62], np.int64), np.array([i for _, i in steps], np.int64)))

    def topics(self, words: Sequence[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))
        gram = np.full(len(letters), self.says.shape[1] - 1)
        at = np.flatnonzero(left > 1)
        last = letters[at]
        for step, (known, rows) in enumerate(self.levels, 1):
            asked = last << 21 | letters[at + step]
            place = np.searchsorted(known, asked)
            hit = known[place] == asked
            at, last = at[hit], rows[place[hit]]
            gram[at] = last
            more = left[at] > step + 1
            at, last = at[more], last[more]
        word = np.repeat(np.arange(len(sizes)), sizes)
        return np.array([np.bincount(word, said, len(sizes)) for said in self.says[:, gram]]).argmax(axis=0)

    def rare_cells(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes and slots of words that are not in the head."""
        return self.topics(words) * BANDS + BANDS - 1, np.array([slot_of_rare(w) for w in words], np.int64)


def slot_of_rare(word: str) -> int:
    return OWN + crc32(word.encode()) % (SLOTS - OWN)


def cluster(vectors: np.ndarray, rounds: int = 40) -> np.ndarray:
    """k-means by cosine around the mean; first centres: the most frequent word, then always the one least like the centres so far. Words without
    neighbours go to the first cluster."""
    label = np.zeros(len(vectors), np.int64)
    some = np.flatnonzero(vectors.sum(axis=1) >= 20)
    if len(some) < TOPICS:
        return label
    lifted = np.sqrt(vectors[some] / vectors[some].sum(axis=1, keepdims=True))
    lifted -= lifted.mean(axis=0)
    lifted /= np.maximum(np.linalg.norm(lifted, axis=1, keepdims=True), 1e-9)
    likely = lifted[: max(TOPICS, len(lifted) // 4)]  # the rarer words are too noisy for first centres
    centres = likely[:1]
    while len(centres) < TOPICS:
        centres = np.vstack([centres, likely[(likely @ centres.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        nearest = (lifted @ centres.T).argmax(axis=1)
        for k in range(TOPICS):
            if (nearest == k).any():
                mean = lifted[nearest == k].mean(axis=0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-9)
    label[some] = (lifted @ centres.T).argmax(axis=1)
    return label


def neighbours(docs: DataFrame, words: Broadcast) -> np.ndarray:
    """SEEDS x CONTEXTS: how often a context word stands within ``NEAR`` places of a seed, over all texts of ``docs``."""
    wide = 16

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w.encode(): i for i, w in enumerate(words.value[:SEEDS])}
        gap = [SEEDS] * NEAR  # no neighbours over the end of a text
        total = np.zeros(SEEDS * CONTEXTS, np.int64)
        for (texts,) in slices(batches):
            found: list[int] = []
            for text in texts:
                found += map(known.get, tokens(text), repeat(SEEDS))
                found += gap
            ids = np.array(found, np.int64)
            for step in range(1, NEAR + 1):
                for seed, context in ((ids[step:], ids[:-step]), (ids[:-step], ids[step:])):
                    both = (seed < SEEDS) & (context < CONTEXTS)
                    total += np.bincount(seed[both] * CONTEXTS + context[both], minlength=len(total))
        values = total.astype(np.float32).reshape(-1, wide * CONTEXTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())], names=["block", "values"])

    rows = docs.select(text_or_empty()).mapInArrow(work, "block long, values binary")
    found = sum_blocks(rows)
    out = np.zeros((SEEDS // wide, wide * CONTEXTS))
    for block, values in found.items():
        out[block] = values
    return out.reshape(SEEDS, CONTEXTS)


# ---- the model

class Reader:
    """Texts to ids, cells (class and slot) and features, in one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        size = len(vocabulary.words)
        # ids: of the head, then one per class and shared slot for rarer words
        shared = SLOTS - OWN
        self.classes = np.concatenate([vocabulary.classes, np.repeat(np.arange(CLASSES), shared)])
        self.cells = self.classes * SLOTS + np.concatenate([vocabulary.slots, np.tile(np.arange(OWN, SLOTS), CLASSES)])
        ids = np.arange(size + CLASSES * shared)
        self.named = np.where(ids < min(size, FEATURED), ids, FEATURED + self.classes).astype(np.uint64) + np.uint64(1)
        self.log_base = np.log10((vocabulary.counts + 0.5) / vocabulary.mass)
        self.size = size

    @cached_property
    def head(self) -> dict[bytes, int]:
        return {w.encode(): i for i, w in enumerate(self.vocabulary.words)}

    @cached_property
    def letters(self) -> Letters:
        return Letters(self.vocabulary.grams)

    def ids(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.head.get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(found < 0)
        if len(rare):
            each = [words[i] for i in rare.tolist()]
            distinct = list(dict.fromkeys(each))
            kinds, slots = self.letters.rare_cells([w.decode() for w in distinct])
            place = dict(zip(distinct, (self.size + kinds * (SLOTS - OWN) + slots - OWN).tolist(), strict=True))
            found[rare] = list(map(place.__getitem__, each))
        return found

    def ids_of(self, text: str | bytes) -> np.ndarray:
        """Of a text, plain or coded."""
        return np.frombuffer(text, np.int32) if isinstance(text, bytes) else self.ids(tokens(text))

    def features(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cells and rows of features of texts, of which each begins without history. Of the rows (a column per token) the first FEATURES are those of the class."""
        joined = np.concatenate(ids)
        at = np.concatenate([np.arange(len(i)) for i in ids])
        word, kind = self.named[joined], self.classes[joined]
        back = []
        for step in (1, 2, 3):
            one, two = np.zeros(len(joined), np.uint64), np.zeros(len(joined), np.uint64)
            one[step:], two[step:] = word[:-step], (kind[:-step] + 1).astype(np.uint64)
            gone = at < step
            one[gone], two[gone] = 0, 0
            back.append((one, two))
        (w1, c1), (w2, c2), (w3, c3) = back
        keys = (w1, w2, w3, w1 * np.uint64(100_003) + w2, (c1 * np.uint64(64) + c2) * np.uint64(64) + c3)
        rows = np.empty((FEATURES + len(INNER), len(joined)), np.int32)
        for i, key in enumerate(keys):
            rows[i] = ((key + np.uint64(i << 40)) * MIX[i]) >> np.uint64(64 - ROW_BITS)
        own = kind.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for n, i in enumerate(INNER):
            rows[FEATURES + n] = ((keys[i] + own + np.uint64((FEATURES + i) << 40)) * MIX[i]) >> np.uint64(64 - INNER_BITS)
        return self.cells[joined], rows


def exponentials(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Unscaled probabilities of the classes, or of the slots of each token's class (``prior``: a row per token); weights are kept within ``BOUND``,
    so nothing overflows."""
    z = weights.take(rows[0], axis=0)
    z += prior
    for row in rows[1:]:
        z += weights.take(row, axis=0)
    return np.exp(z, out=z)


def softmax(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty((rows.shape[1], weights.shape[1]), np.float32)
    for at in range(0, len(out), SCORED):
        part = slice(at, at + SCORED)
        z = exponentials(weights, prior if prior.ndim == 1 else prior[part], rows[:, part])
        np.divide(z, z.sum(axis=1, keepdims=True), out=out[part])
    return out


def sum_runs(values: np.ndarray, order: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of rows of ``values``, taken in ``order``, over runs that begin at ``first``. Most runs are short; for each of these and each column
    reduceat would start anew, so they are added side by side: the first rows of all, the second, and so on."""
    out = values.take(order.take(first), axis=0)
    by_size = np.argsort(np.minimum(sizes, SHORT + 1).astype(np.uint8), kind="stable")
    least = np.searchsorted(sizes[by_size].clip(max=SHORT + 1), range(2, SHORT + 2))  # where runs of 2 and more begin, of 3 and more ...
    short = by_size[least[0]:least[-1]]
    if len(short):
        start = first[short]
        rest = values.take(order.take(start + 1), axis=0)
        for k in range(2, SHORT):
            longer = least[k - 1] - least[0]
            rest[longer:] += values.take(order.take(start[longer:] + k), axis=0)
        out[short] += rest
    long = np.sort(by_size[least[-1]:])
    if len(long):
        inside = np.repeat(sizes > SHORT, sizes)
        out[long] = np.add.reduceat(values.take(order[inside], axis=0), np.cumsum(sizes[long]) - sizes[long], axis=0)
    return out


def descend(weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, prior: np.ndarray, kind: np.ndarray, rows: np.ndarray, rate: float) -> None:
    """One gradient step over a batch of tokens, with a step size for each feature that shrinks as its gradients add up."""
    gradient = softmax(weights, prior, rows)
    gradient[np.arange(len(kind)), kind] -= 1
    narrow = np.min_scalar_type(len(weights) - 1)  # 16 bits are sorted by radix
    for row in rows.astype(narrow):
        order = np.argsort(row, kind="stable")
        ordered = row.take(order)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sizes = np.diff(first, append=len(ordered))
        summed = sum_runs(gradient, order, first, sizes)
        which = ordered.take(first).astype(np.intp)
        square = squares.take(which) + np.einsum("ij,ij->i", summed, summed)
        squares[which] = square
        seen[which] += sizes
        summed *= (rate / np.sqrt(square + 1e-3))[:, None].astype(np.float32)
        stepped = np.subtract(weights.take(which, axis=0), summed, out=summed)
        weights[which] = np.clip(stepped, -BOUND, BOUND, out=stepped)


def batches_of(reader: Reader, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and features of texts, plain or coded."""
    held: list[np.ndarray] = []
    size = 0
    for (texts,) in slices(batches):
        for text in texts:
            held.append(reader.ids_of(text))
            size += len(held[-1])
            if size >= BATCH:
                yield reader.features(held)
                held, size = [], 0
    if held:
        yield reader.features(held)


@dataclass
class Priors:
    """The base model's logarithms of the classes' probabilities, and of slots within classes."""

    classes: np.ndarray
    slots: np.ndarray

    def outer(self, cells: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the class factor: prior, what came, rows of features."""
        return self.classes, cells // SLOTS, rows[:FEATURES]

    def inner(self, cells: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the word factor."""
        return self.slots[cells // SLOTS], cells % SLOTS, rows[FEATURES:]


def code(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """row, doc_id, ids (int32, as bytes) of the tokens of each whole text, and its words outside the head with their numbers; a table."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, row = Reader(vocabulary.value), TaskContext.get().partitionId() << 36
        for doc_ids, texts in slices(batches, 64):
            split = [tokens(text) for text in texts]
            ids = np.split(reader.ids(list(chain.from_iterable(split))), np.cumsum([len(words) for words in split])[:-1])
            out = []
            for doc_id, words, own in zip(doc_ids, split, ids, strict=True):
                rare = Counter([words[i] for i in np.flatnonzero(own >= reader.size).tolist()])
                out.append((row, doc_id, own.tobytes(), list(rare), list(rare.values())))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kinds = "row long, doc_id long, ids binary, words array<binary>, counts array<long>"
    return stored(docs.select("doc_id", text_or_empty()).mapInArrow(work, kinds), "coded-documents")


def train_round(coded: DataFrame, vocabulary: Broadcast, priors: Priors, weights: list[np.ndarray], rate: float) -> list[np.ndarray]:
    """Every task descends from ``weights`` (of classes, of slots) over its coded documents; the results are averaged by how often each met a feature."""
    start = coded.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = Reader(vocabulary.value), [w.copy() for w in start.value]
        squares, seen = [np.zeros(len(w)) for w in own], [np.zeros(len(w), np.float32) for w in own]
        for cells, rows in batches_of(reader, batches):
            for at in range(0, len(cells), BATCH):
                part = cells[at:at + BATCH], rows[:, at:at + BATCH]
                for i, factor in enumerate((priors.outer, priors.inner)):
                    descend(own[i], squares[i], seen[i], *factor(*part), rate)
        for i, met in enumerate(seen):
            for block in range(len(met) // BLOCK):
                part = slice(block * BLOCK, (block + 1) * BLOCK)
                if met[part].any():
                    values = np.concatenate([own[i][part] * met[part, None], met[part, None]], axis=1).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([2 * block + i], pa.int64()), pa.array([values.tobytes()], pa.binary())], names=["block", "values"])

    rows = coded.select("ids").mapInArrow(work, "block long, values binary")
    averaged = [w.copy() for w in weights]
    for place, values in sum_blocks(rows).items():
        block, i = divmod(place, 2)
        values = values.reshape(BLOCK, -1)
        met = values[:, -1] > 0
        averaged[i][block * BLOCK:(block + 1) * BLOCK][met] = values[met, :-1] / values[met, -1:]
    start.unpersist()
    return averaged


def base_priors(counts: DataFrame, vocabulary: Broadcast) -> Priors:
    """What the base model gives classes and slots, over all words; an unseen word may be in any shared slot of rare words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        head = {w: k for w, k in zip(known.words, (known.classes * SLOTS + known.slots).tolist(), strict=True)}
        total, letters = np.zeros(CLASSES * SLOTS), Letters(known.grams)
        for words, n in slices(batches, 4096):
            cells = np.fromiter(map(head.get, words, repeat(-1)), np.int64, len(words))
            rare = np.flatnonzero(cells < 0)
            kinds, slots = letters.rare_cells([words[i] for i in rare.tolist()])
            cells[rare] = kinds * SLOTS + slots
            total += np.bincount(cells, np.array(n) + 0.5, len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES * SLOTS), pa.int64()), pa.array(total)], names=["cell", "mass"])

    sums = counts.select("word", "c").mapInArrow(work, "cell long, mass double").groupBy("cell").agg(F.sum("mass").alias("mass")).collect()
    out = np.zeros(CLASSES * SLOTS)
    for cell, mass in sums:
        out[cell] = mass
    out = out.reshape(CLASSES, SLOTS)
    out[BANDS - 1::BANDS, OWN:] += 0.5
    whole = np.maximum(out.sum(axis=1), 0.5)
    return Priors(np.log(whole / vocabulary.value.mass).astype(np.float32), np.log(np.maximum(out / whole[:, None], 1e-30)).astype(np.float32))


@dataclass
class Model:
    counts: DataFrame
    vocabulary: Vocabulary
    shared: Broadcast  # the vocabulary
    priors: Priors
    weights: list[np.ndarray]


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``: all above a count that a histogram of 64 steps an octave gives, whose size is bounded."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    above, lowest = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        above += r["n"]
        if above > most:
            break
        lowest = r["step"]
    return counts.filter(F.lit(False)) if lowest is None else counts.filter(step >= lowest)


def learn_words(docs: DataFrame) -> Model:
    """Counts, classes and priors from all rows of ``docs[doc_id, text]``, without weights."""
    spark = docs.sparkSession
    counts = stored(count_words(docs), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = sorted(frequent(counts, HEAD).collect(), key=lambda r: (-r["c"], r["word"]))
    words = spark.sparkContext.broadcast([r["word"] for r in head])
    vocabulary = Vocabulary(words.value, np.array([r["c"] for r in head], float), total, distinct)
    vocabulary.finish(neighbours(docs, words)[:len(head)])
    shared = spark.sparkContext.broadcast(vocabulary)
    return Model(counts, vocabulary, shared, base_priors(counts, shared), [np.zeros((ROWS, CLASSES), np.float32), np.zeros((INNER_ROWS, SLOTS), np.float32)])


def train(coded: DataFrame, model: Model) -> Model:
    """Weights from all rows of ``coded``."""
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS))
    weights = model.weights
    for i in range(ROUNDS):
        weights = train_round(coded.filter(turn == i), model.shared, model.priors, weights, RATE / (i + 1))
    return replace(model, weights=weights)


def fit(docs: DataFrame) -> Model:
    """Train on all rows of ``docs[doc_id, text]``."""
    model = learn_words(docs)
    return train(code(docs, model.shared), model)


def gains(priors: Priors, weights: list[np.ndarray], cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log10 of P(class | history) P(slot | class, history) over the base model's share of the slot, of each token."""
    out = np.zeros(len(cells))
    for at in range(0, len(cells), SCORED):
        part = slice(at, at + SCORED)
        for table, factor in zip(weights, (priors.outer, priors.inner), strict=True):
            prior, came, which = factor(cells[part], rows[:, part])
            z = exponentials(table, prior, which)
            each = np.arange(len(came))
            before = prior[came] if prior.ndim == 1 else prior[each, came]
            out[part] += np.log10(np.maximum(z[each, came].astype(np.float64) / z.sum(axis=1), 1e-30)) - before.astype(np.float64) / np.log(10)
    return out


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: sums of log10 over the tokens of each whole text."""
    return coded_scores(code(docs, model.shared), model)


def coded_scores(coded: DataFrame, model: Model) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast((model.priors, model.weights))
    vocabulary = model.shared
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (priors, weights), reader = shared.value, Reader(vocabulary.value)
        for rows, doc_ids, texts in slices(batches, 64):
            ids = [reader.ids_of(text) for text in texts]
            gain = gains(priors, weights, *reader.features(ids))
            ends = np.cumsum([len(i) for i in ids])
            out = []
            for row, doc_id, own, end in zip(rows, doc_ids, ids, ends, strict=True):
                common = own < reader.size
                out.append((row, doc_id, len(own), int(common.sum()), float(reader.log_base[own[common]].sum()), float(gain[end - len(own):end].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kinds = "row long, doc_id long, n_tokens long, known long, base double, gain double"
    scored = stored(coded.select("row", "doc_id", "ids").mapInArrow(work, kinds), "scored-documents")
    rare = coded.select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    rare = rare.select("row", F.col("word").cast("string").alias("word"), "n").join(model.counts, "word", "left")
    c, mass = F.coalesce("c", F.lit(0)), F.lit(float(model.vocabulary.mass))
    looked_up = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10((c + 0.5) / mass)).alias("rare_base"))
    whole = scored.join(looked_up, "row", "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return whole.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
                        F.lit(int(model.vocabulary.total)).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id, 5) == 1, F.lit(False))


def held_out_scores(docs: DataFrame) -> DataFrame:
    """``scores`` of all documents by a model of those whose crc32 of the id mod 5 is not 1; those are ``held_out``. Each text is coded once for both."""
    model = learn_words(docs.filter(~held_out()))
    coded = code(docs, model.shared)
    found = coded_scores(coded, train(coded.filter(~held_out()), model))
    return found.withColumn("held_out", held_out())
