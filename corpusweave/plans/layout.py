"""How rows lie over tasks at the start of heavy per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows that arrive in fewer pieces than there are cores; otherwise leave them where they are.

    A table of a few files without splits would keep all parsing in a few tasks. Input of cluster size has
    more splits than cores, and then this adds nothing to the plan.
    """
    plan = df._jdf.queryExecution()
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df  # already shuffled, and asking for its partitions would run its stages
    pieces = plan.toRdd().getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if pieces >= cores else df.repartition(cores)


def write_by_key(df: DataFrame, name: str, path: str, key: str, order: str, buckets: int) -> DataFrame:
    """Write rows bucketed by ``key``; windows, groups and joins on ``key`` over the table need no shuffle any more.

    Meant for tables with several consumers, the token table first of all. The bucket count is for the table's
    size (some hundred MB per bucket), not for today's cores.
    """
    df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, order).saveAsTable(name)
    return df.sparkSession.table(name)
