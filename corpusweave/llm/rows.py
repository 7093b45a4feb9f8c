"""Per-document work in Arrow batches, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type
from pyspark.sql.types import StructField, StructType

from corpusweave.session import new_table_path

#: Rows that are Python objects at the same time in a task; the Arrow batch itself is bounded by Spark.
SLICE = 128


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[list[list]]:
    """The columns of at most ``size`` rows at a time as Python lists."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield [column.to_pylist() for column in part.columns]


def give_back() -> None:
    """For the end of a task: its worker lives on, and what Arrow keeps for later would stand beside the memory of the next stage."""
    pa.default_memory_pool().release_unused()


def map_documents(df: DataFrame, columns: Sequence[Column | str], schema: pa.Schema,
                  start: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Apply a function to rows; ``start`` makes it once per task, it takes the columns' values and gives output rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for values in slices(batches):
            found = [row for given in zip(*values, strict=True) for row in each(*given)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, type=field.type) for column, field in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
        give_back()

    return df.select(*columns).mapInArrow(work, from_arrow_schema(schema))


def add_struct(df: DataFrame, column: str, name: str, schema: pa.Schema, start: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """``df`` with one more column: a struct of what a function gives for the text in ``column`` (null: empty)."""
    names = list(df.columns)
    kind = pa.struct(list(schema))
    out = StructType([*df.schema.fields, StructField(name, from_arrow_type(kind))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = zip(*(each(t or "") for t in part.column(names.index(column)).to_pylist()), strict=True)
                struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], fields=list(schema))
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*names, name])
        give_back()

    return df.mapInArrow(work, out)


def word_windows(words: Sequence[bytes], width: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by one space, and where each window of ``width`` words starts and ends in that."""
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][:max(0, len(words) - width + 1)]
    return b" ".join(words), starts, (ends[width - 1:] - 1).tolist()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again. In loops this is preferable to a checkpoint, which hands on what the optimizer
    had inferred about columns: that may double in each round."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Memo(dict):
    """Remembers ``fn`` for up to ``limit`` arguments, then starts anew: bounded memory, whatever the input."""

    def __init__(self, fn: Callable, limit: int):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
