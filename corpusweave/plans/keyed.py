"""Joins and per-key choices that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``rows`` (any key may be hot) to ``table`` (one row per key).

    A plain join: a partition of ``rows`` that a hot key makes large is split by map output while the query runs (adaptive skew joins,
    which ``session.build_session`` turns on), whether its rows differ or not, and the one row of ``table`` is read by each piece. Nothing is
    copied for other keys, and small and large tables behave alike.
    """
    return rows.join(table, list(keys), how)


def members_of(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lookup(rows, table.select(*keys).distinct(), keys, "left_semi")


def missing_from(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lookup(rows, table.select(*keys).distinct(), keys, "left_anti")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Column | Sequence[Column]) -> DataFrame:
    """The row with the largest ``order`` per key, by an aggregate: each map task sends one row per key."""
    order = order if isinstance(order, Column) else F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])
