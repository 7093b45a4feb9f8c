"""Harmonic packing of token sequences into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class i holds pieces longer than capacity/(i+1) and not longer than capacity/i, and
a bin of class i takes exactly i pieces of it. Every worker fills its own bins: no shuffle, no shared state, one open bin per class.

Documents are cut so that the classes waste little. Full capacities come off the front; the rest is cut at its binary digits down
to ``grain`` tokens, so all pieces but the last have a power of two as length and fill their bins wholly. The last piece, below
twice the grain, goes to a class of many small pieces, whose bins lack less than one piece. What a worker has left in open bins at its end
is cut at all its binary digits; these pieces fill bins again, and the very last ones make sequences whose length is a power of two, which
need no padding. The result has padding only in full bins of the small classes: below capacity/(i+1) tokens in a bin of class i.

Every token lies in exactly one piece. A document without tokens has the end token alone. Repeated rows are packed each on its own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from corpusweave.llm.bpe import WORDS, encoder
from corpusweave.llm.rows import give_back, slices, text_or_empty

CAPACITY = 4096
GRAIN = 64
END = 2
END_BYTES = END.to_bytes(4, "little")

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def cuts(length: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of the pieces of a document: full ones, powers of two, and one piece shorter than twice the grain."""
    found = [capacity] * (length // capacity)
    rest, digit = length % capacity, capacity // 2
    while rest >= 2 * grain:
        if rest >= digit:
            found.append(digit)
            rest -= digit
        digit //= 2
    return [*found, rest] if rest else found


class Packer:
    """The bins of one worker. ``add`` and ``finish`` give finished rows."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, grain: int = GRAIN):
        self.next_id, self.capacity, self.grain = first_id, capacity, grain
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1

    def _put(self, piece: tuple) -> Iterator[tuple]:
        kind = self.capacity // (len(piece[2]) // 4)
        self.open[kind].append(piece)
        if len(self.open[kind]) == kind:
            yield from self._close(self.open.pop(kind))

    def add(self, doc_id: int, ids: bytes) -> Iterator[tuple]:
        """``ids``: little-endian unsigned 32-bit."""
        at = 0
        for length in cuts(len(ids) // 4, self.capacity, self.grain):
            yield from self._put((doc_id, at, ids[4 * at:4 * (at + length)], len(ids) // 4))
            at += length

    def finish(self) -> Iterator[tuple]:
        left, self.open = self.open, defaultdict(list)
        for kind in sorted(left):
            for doc_id, start, ids, total in left[kind]:
                at = 0
                for length in cuts(len(ids) // 4, self.capacity, 1):
                    yield from self._put((doc_id, start + at, ids[4 * at:4 * (at + length)], total))
                    at += length
        for kind in sorted(self.open):  # fewer than a bin's pieces of one power of two: sequences by the binary digits of their number
            pieces = self.open[kind]
            for count in cuts(len(pieces), 1 << len(pieces).bit_length(), 1):
                yield from self._close(pieces[:count])
                pieces = pieces[count:]
        self.open.clear()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, grain: int = GRAIN, remembered: int = WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs[doc_id, text]``, null texts empty; ``path``: the tokenizers file. Sequence ids are unique over all workers: the partition's number
    and a counter. ``capacity`` and ``grain`` are powers of two. ``remembered``: words that a worker
    keeps the ids of, some 600 bytes each; fewer cost time only.
    """
    if capacity & (capacity - 1) or grain & (grain - 1) or grain > capacity:
        raise ValueError("capacity and grain are powers of two, the grain not above the capacity")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(TaskContext.get().partitionId() << 40, capacity, grain), encoder(path, remembered).encode_bytes

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

        for ids, texts in slices(batches):
            rows = [row for doc_id, text in zip(ids, texts, strict=True) for row in packer.add(doc_id, encode(text) + END_BYTES)]
            if rows:
                yield batch(rows)
        if rows := list(packer.finish()):
            yield batch(rows)
        give_back()

    return docs.select("doc_id", text_or_empty()).mapInArrow(work, from_arrow_schema(PIECES))
