"""Quality classifier: a convolutional network over bytes, in numpy.

Each position sees the embeddings of ``WIDTH`` bytes and, as one more input channel, whether the ``REPEAT`` bytes there stood earlier in
the text. Learned filters run over every position of the document; their responses are pooled (largest and mean) in
chunks of ``CHUNK`` positions, whose windows overlap by a filter's width, so nothing at a chunk's edge is lost. The chunks' pooled values,
averaged over the whole document, are combined into one probability.

It is fitted on a bounded sample of labelled rows: the first ``SAMPLE`` of each label by the hash of their id, and of each up to
``CHUNKS`` chunks, evenly spaced. The sample is balanced; the intercept is then moved to the share of label 1 among all
labelled rows. Only bytes of texts are inputs of a score. Null and empty texts are scored like a chunk of zero bytes. Without labelled rows of
both kinds the score is the share of label 1, or 0.5 without any. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.rows import add_struct, fold, map_documents, text_or_empty

WIDTH, EMBEDDING, FILTERS, CHUNK, REPEAT = 6, 6, 8, 256, 24
SAMPLE, CHUNKS = 700, 8
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.02, 1e-4
#: Bytes of a text that are worked on at once; repeats are looked for within such a span.
SPAN = 1 << 20
SLOTS = 1 << 16
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def repeats(raw: bytes) -> np.ndarray:
    """1 at each position whose next ``REPEAT`` bytes stood at an earlier position, as far as a table of first places shows."""
    out = np.zeros(len(raw), np.uint8)
    n = len(raw) - REPEAT + 1
    if n < 2:
        return out
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    marks = words[:n] * MIX[0]
    marks ^= (words[8:8 + n] * MIX[1]) >> np.uint64(7)
    marks ^= words[16:16 + n] * MIX[2]
    marks *= MIX[1]
    slot = (marks >> np.uint64(48)).astype(np.int64)
    places = np.arange(n, dtype=np.int32)
    first = np.full(SLOTS, n - 1, np.int32)
    first[slot[::-1]] = places[::-1]
    found = first[slot]
    out[:n] = (found < places) & (marks[found] == marks)
    return out


def spans(text: str) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """Bytes (with those that the last windows reach into), their repeat channel, and the number of positions that count."""
    raw = text.encode()
    for at in range(0, max(1, len(raw)), SPAN):
        part = raw[at:at + SPAN + WIDTH - 1]
        count = max(1, min(SPAN, len(raw) - at))
        padded = part.ljust(count + WIDTH - 1, b"\0")
        yield padded, repeats(padded), count


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # WIDTH x (EMBEDDING + 1) x FILTERS; the last input is the repeat channel
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: of the largest, of the mean
    intercept: float

    def __post_init__(self):
        # one-hot bytes times embedding times filter: two neighbouring bytes in one table
        one = np.einsum("be,wef->wbf", self.embed, self.filters[:, :-1]).astype(np.float32)
        self.tables = [(one[w][None, :, :] + one[w + 1][:, None, :]).reshape(65536, -1) for w in range(0, WIDTH, 2)]
        flags = np.arange(1 << WIDTH)[:, None] >> np.arange(WIDTH) & 1
        self.repeat_table = (flags @ self.filters[:, -1] + self.bias).astype(np.float32)

    def pooled(self, raw: bytes, repeat: np.ndarray, count: int) -> tuple[np.ndarray, int]:
        """Sum over chunks of the pooled filter responses, and the number of chunks."""
        pairs = np.ndarray((len(raw) - 1,), "<u2", raw, strides=(1,))
        flags = np.zeros(count, np.uint8)
        for w in range(WIDTH):
            flags |= repeat[w:w + count] << w
        total, chunks = np.zeros(2 * FILTERS), 0
        for at in range(0, count, 64 * CHUNK):
            n = min(64 * CHUNK, count - at)
            z = self.repeat_table[flags[at:at + n]]
            for i, table in enumerate(self.tables):
                z += table[pairs[at + 2 * i:at + 2 * i + n]]
            np.maximum(z, 0, out=z)
            edges = np.arange(0, n, CHUNK)
            sizes = np.minimum(CHUNK, n - edges)
            total[:FILTERS] += np.maximum.reduceat(z, edges).sum(axis=0)
            total[FILTERS:] += (np.add.reduceat(z, edges) / sizes[:, None]).sum(axis=0)
            chunks += len(edges)
        return total, chunks

    def score(self, text: str) -> float:
        total, chunks = np.zeros(2 * FILTERS), 0
        for part in spans(text):
            found, n = self.pooled(*part)
            total, chunks = total + found, chunks + n
        return float(1 / (1 + np.exp(-np.clip(total @ self.weights / chunks + self.intercept, -40, 40))))


@dataclass
class Constant:
    """What is left without labels of both kinds."""

    share: float

    def score(self, text: str) -> float:
        return self.share


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], share: float, seed: int = 7) -> Network:
    """``docs``: label, bytes and repeat channel of its chunks (chunks x (CHUNK + WIDTH - 1)). Adam on the log loss."""
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBEDDING)), "filters": rng.normal(0, 0.3, (WIDTH, EMBEDDING + 1, FILTERS)), "bias": np.zeros(FILTERS),
        "weights": rng.normal(0, 0.3, 2 * FILTERS), "intercept": np.zeros(1),
    }
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            batch = [docs[i] for i in order[at:at + BATCH]]
            label = np.array([b[0] for b in batch], float)
            doc = np.repeat(np.arange(len(batch)), [len(b[1]) for b in batch])
            share_of = 1 / np.bincount(doc)[doc]
            raw, flag = np.concatenate([b[1] for b in batch]), np.concatenate([b[2] for b in batch])
            inputs = np.concatenate([p["embed"][raw], flag[..., None]], axis=2).astype(np.float32)  # chunks x bytes x channels
            seen = np.concatenate([inputs[:, w:w + CHUNK] for w in range(WIDTH)], axis=2)
            flat = p["filters"].reshape(-1, FILTERS).astype(np.float32)
            z = np.maximum(seen @ flat + p["bias"].astype(np.float32), 0)
            best = z.argmax(axis=1)
            chunk = np.concatenate([np.take_along_axis(z, best[:, None], 1)[:, 0], z.mean(axis=1)], axis=1)
            pooled = np.zeros((len(batch), 2 * FILTERS))
            np.add.at(pooled, doc, chunk * share_of[:, None])
            error = 1 / (1 + np.exp(-np.clip(pooled @ p["weights"] + p["intercept"], -40, 40))) - label
            g = {"weights": pooled.T @ error / len(batch), "intercept": np.array([error.mean()])}
            back = (error[doc] * share_of / len(batch))[:, None] * p["weights"]
            dz = np.repeat((back[:, None, FILTERS:] / CHUNK).astype(np.float32), CHUNK, axis=1)
            np.put_along_axis(dz, best[:, None], np.take_along_axis(dz, best[:, None], 1) + back[:, None, :FILTERS], 1)
            dz *= z > 0
            g["bias"] = dz.sum(axis=(0, 1))
            g["filters"] = (seen.reshape(-1, seen.shape[2]).T @ dz.reshape(-1, FILTERS)).reshape(p["filters"].shape)
            dseen = (dz @ flat.T).reshape(*dz.shape[:2], WIDTH, EMBEDDING + 1)
            dinput = np.zeros(inputs.shape, np.float32)
            for w in range(WIDTH):
                dinput[:, w:w + CHUNK] += dseen[:, :, w]
            g["embed"] = np.stack([np.bincount(raw.ravel(), dinput[..., e].ravel(), 256) for e in range(EMBEDDING)], axis=1)
            step += 1
            for k, x in p.items():
                gradient = g[k] + DECAY * x * (k != "intercept")
                m[k] = 0.9 * m[k] + 0.1 * gradient
                v[k] = 0.99 * v[k] + 0.01 * gradient ** 2
                x -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return Network(p["embed"], p["filters"], p["bias"], p["weights"], float(p["intercept"][0]) + float(np.log(share / (1 - share))))


def sample_chunks(rows: DataFrame) -> DataFrame:
    """label, bytes, repeats: evenly spaced chunks of each text, cut in the tasks so that a long text isn't sent whole."""
    schema = pa.schema([("label", pa.int32()), ("bytes", pa.binary()), ("repeats", pa.binary())])

    def start():
        def each(label, text):
            raw, flags = [], []
            for part, repeat, count in spans(text):
                for at in range(0, count, CHUNK):
                    raw.append(part[at:at + CHUNK + WIDTH - 1].ljust(CHUNK + WIDTH - 1, b"\0"))
                    flags.append(repeat[at:at + CHUNK + WIDTH - 1].tobytes().ljust(CHUNK + WIDTH - 1, b"\0"))
            picked = np.unique(np.linspace(0, len(raw) - 1, CHUNKS).astype(int))
            yield label, b"".join(raw[i] for i in picked), b"".join(flags[i] for i in picked)

        return each

    return map_documents(rows, ["label", text_or_empty()], schema, start)


def fit(docs: DataFrame, labels: DataFrame, trained_on: Column, sample: int = SAMPLE) -> Network | Constant:
    """Learn ``labels[doc_id, quality]`` over ``docs[doc_id, text]``; only labels where ``trained_on`` (over doc_id) holds are read."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label")).filter(trained_on)
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = dict(known.groupBy("label").count().collect())
    if len(counts) < 2:
        return Constant(float(next(iter(counts))) if counts else 0.5)
    ranked = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = ranked[0].union(ranked[1])  # at most twice the sample of small rows
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
    rows = sorted((r["label"], bytes(r["bytes"]), bytes(r["repeats"])) for r in sample_chunks(texts).collect())
    shape = (-1, CHUNK + WIDTH - 1)
    found = [(label, np.frombuffer(raw, np.uint8).reshape(shape), np.frombuffer(flags, np.uint8).reshape(shape)) for label, raw, flags in rows]
    return train(found, counts[1] / (counts[0] + counts[1]))


def scored(docs: DataFrame, model: Network | Constant) -> DataFrame:
    """doc_id, score of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    return map_documents(docs, ["doc_id", text_or_empty()], schema, lambda: lambda doc_id, text: [(doc_id, model.score(text))])


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 3 is 1), score, predicted; labels of held-out rows aren't read."""
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    rows = scored(docs, fit(docs, labels, ~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    model = fit(docs, labels, F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    score = "__score"
    marked = add_struct(docs, "text", score, pa.schema([("value", pa.float64())]), lambda: lambda text: (model.score(text),))
    return marked.filter(F.col(f"{score}.value") >= threshold).drop(score)
