"""Registered queries: each runs one operator over a whole benchmark table and may carry its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None = None


FAMILIES = ["catalogue", "redirects", "categories", "links", "content", "assets", "dependencies", "variants", "quality",
            "outputs", "streams"]


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        for name, query in import_module(f"corpusweave.queries.{family}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found


class Family(dict[str, Query]):
    """Collects the queries of one module; ``sql`` is the same result in DuckDB's dialect."""

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Build], Build]:
        def keep(build: Build) -> Build:
            self[name or build.__name__] = Query(build, sql)
            return build

        return keep
