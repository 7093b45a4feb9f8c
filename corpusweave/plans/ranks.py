"""Order-dependent values inside groups of any size, with one shuffle.

A plain window sends a whole group to one task. Here rows are range-partitioned by (group, order) and sorted, so a hot group is spread over many
partitions. One pass over each partition numbers the rows of its groups as they come by. Only a partition's first group may have begun in an earlier one;
where it did, the rows before it are added from a table of one row per partition, which is broadcast. The numbered rows are
written to the shared folder: the boundaries are sampled, so they must not be drawn twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from corpusweave.plans.keyed import lookup
from corpusweave.session import cut

GROUP = ["__group_a", "__group_b"]


def _numbered(df: DataFrame) -> DataFrame:
    """``df``, whose partitions are sorted by group, with __local (number in the group, within the partition), __part, __first (of the partition's first group)."""
    schema = StructType([*df.schema.fields, StructField("__local", LongType()), StructField("__part", IntegerType()), StructField("__first", BooleanType())])
    names = [f.name for f in schema.fields]
    where = [df.columns.index(g) for g in GROUP]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in where])
            begins = np.concatenate([[last is None or (keys[:, 0] != last).any()], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            starts = np.flatnonzero(begins)
            # rows before the batch's first start go on with the count so far
            at = np.arange(n)
            since = np.full(n, -count)
            if len(starts):
                since[starts[0]:] = np.repeat(starts, np.diff([*starts, n]))
            local = at - since + 1
            own = np.zeros(n, bool)
            if first:
                later = starts[1:] if last is None else starts
                own[:later[0] if len(later) else n] = True
                first = not len(later)
            last, count = keys[:, -1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64()), pa.array(np.full(n, part), pa.int32()), pa.array(own)], names=names)

    return df.mapInArrow(work, schema)


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], rank: str = "rank",
                  total: str | None = None, spread: bool = True) -> DataFrame:
    """Number rows 1..n inside ``group`` by ``order`` (which must be unique there); ``total`` names the group size.

    ``spread=False`` is for groups whose size has a fixed bound.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if not spread:
        within = Window.partitionBy(*group)
        out = df.withColumn(rank, F.row_number().over(within.orderBy(*order)).cast("long"))
        return out.withColumn(total, F.count(F.lit(1)).over(within)) if total else out
    keys = [F.col(g) for g in group] or [F.lit(0)]
    # a group is named by 128 bits, whatever its columns are
    named = df.withColumns({name: F.xxhash64(F.lit(i), *keys) for i, name in enumerate(GROUP)})
    place = [*[F.col(g) for g in group], *order]
    numbered = cut(_numbered(named.repartitionByRange(*place).sortWithinPartitions(*place)))
    last = F.max_by(F.struct(*GROUP, "__local"), "__row")  # rows of a partition keep their order
    ends = numbered.select("*", F.monotonically_increasing_id().alias("__row")).groupBy("__part").agg(last.alias("last")).select("__part", *[f"last.{g}" for g in GROUP], F.col("last.__local").alias("n"))
    before = Window.partitionBy(*GROUP).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begun = numbered.filter("__first").select("__part", *GROUP).distinct()  # at most one row a partition, as the others
    told = begun.select("*", F.lit(0).cast("long").alias("n")).union(ends.select("__part", *GROUP, "n"))
    told = told.groupBy("__part", *GROUP).agg(F.sum("n").alias("n")).withColumn("__before", F.sum("n").over(before))
    offsets = told.join(begun, ["__part", *GROUP]).filter("__before > 0").select("__part", F.lit(True).alias("__first"), "__before")
    out = numbered.join(F.broadcast(offsets), ["__part", "__first"], "left")
    out = out.withColumn(rank, F.col("__local") + F.coalesce("__before", F.lit(0)))
    if total:
        sizes = numbered.groupBy(*GROUP).agg(F.count(F.lit(1)).alias(total))
        out = lookup(out, sizes, GROUP, "inner")
    return out.select(*df.columns, rank, *([total] if total else []))
