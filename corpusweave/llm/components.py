"""Connected components of an edge table by alternating stars.

Large star: every node tells its larger neighbours its smallest one. Small star: every node tells its smaller neighbours, and itself, the
smallest of them. Both keep the components and never add edges; repeated, they leave each node with one edge to the smallest
node of its component, after about log(n) rounds. A node with many neighbours is a hot key of one side of a join against one
row per node, which AQE splits, and of an aggregate with partial sums. Every round is written to the shared folder, in as many
pieces as its edges need: links are far fewer than rows, and rounds over hundreds of all but empty pieces cost more than the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.session import cut

ROWS_A_PIECE = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    told = edges.join(lowest, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return told.union(lowest).coalesce(n).distinct().coalesce(n)


def pieces(rows: int) -> int:
    """How many tasks should read so many narrow rows."""
    return max(1, -(-rows // ROWS_A_PIECE))


def compact(df: DataFrame) -> DataFrame:
    """``df`` materialised, and read by as many tasks as its rows need."""
    df = cut(df)
    return df.coalesce(pieces(df.count()))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge; null ends and loops are ignored."""
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = compact(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, now = None, state(edges)
    while now != before:
        n = pieces(now[0])  # edges never become more
        edges = cut(_small_star(_large_star(edges).coalesce(n), n))
        before, now = now, state(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
