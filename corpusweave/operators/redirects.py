"""Redirects: from page records to admitted snapshot entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.text import title_path, truncate_words
from corpusweave.plans.keyed import best_per_key, lookup, missing_from


def explode_redirects(pages: DataFrame, seq: str) -> DataFrame:
    """from_title, to_title, fragment of every redirect a page lists; of two claims on one title the last counts."""
    refs = pages.select(seq, F.col("title").alias("to_title"), F.posexplode("redirects").alias("__pos", "__ref"))
    rows = refs.select(
        F.col("__ref.title").alias("from_title"), "to_title", F.coalesce("__ref.fragment", F.lit("")).alias("fragment"), seq, "__pos",
    )
    return best_per_key(rows, ["from_title"], [F.col(seq), F.col("__pos")]).select("from_title", "to_title", "fragment")


def swap_conflicts(pages: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Redirects whose source is itself a catalogued page turn around, and the page that listed them goes.

    Conflicts are judged against the whole catalogue. Returns (redirects, pages to remove).
    """
    catalogue = pages.select(F.col("title").alias("ref_title"), F.lit(True).alias("clash")).distinct()
    refs = pages.select(seq, "title", F.posexplode("redirects").alias("__pos", "__ref")).select(
        seq, "title", "__pos", F.col("__ref.title").alias("ref_title"), F.coalesce("__ref.fragment", F.lit("")).alias("fragment"),
    )
    marked = lookup(refs, catalogue, ["ref_title"]).withColumn("clash", F.coalesce("clash", F.lit(False)))
    turned = marked.select(
        seq, "__pos",
        F.when(F.col("clash"), F.col("title")).otherwise(F.col("ref_title")).alias("from_title"),
        F.when(F.col("clash"), F.col("ref_title")).otherwise(F.col("title")).alias("to_title"),
        F.when(F.col("clash"), F.lit("")).otherwise(F.col("fragment")).alias("fragment"),
    )
    redirects = best_per_key(turned, ["from_title"], [F.col(seq), F.col("__pos")]).drop(seq, "__pos")
    return redirects, marked.filter("clash").select("title").distinct()


def moved_back(fetched: DataFrame, pages: DataFrame, redirects: DataFrame, seq: str) -> DataFrame:
    """Redirects to add because a fetch followed one: new place to old, unless the new place is already known.

    ``fetched``: from_title, to_title, seq. The first fetch that reaches a place counts.
    """
    known = pages.select("title").unionByName(redirects.select(F.col("from_title").alias("title")))
    fresh = missing_from(fetched.withColumn("title", F.col("to_title")), known, ["title"])
    first = fresh.groupBy("to_title").agg(F.min_by("from_title", seq).alias("from_title"))
    return first.select(F.col("to_title").alias("from_title"), F.col("from_title").alias("to_title"), F.lit("").alias("fragment"))


def usable_moves(move_log: DataFrame, order: list[Column]) -> DataFrame:
    """title, target of the newest move of each title, if it has a target and left no redirect behind."""
    newest = best_per_key(move_log, ["title"], order)
    return newest.filter(F.col("params")["target_title"].isNotNull() & F.map_contains_key("params", "suppressredirect")).select(
        "title", F.col("params")["target_title"].alias("target"))


def judge(redirects: DataFrame, pages: DataFrame, lead_only: bool = False) -> DataFrame:
    """Adds ``reason``: why a redirect is dropped, or ``written``. One hop only, chains are not followed."""
    known = pages.select("title").distinct().withColumn("found", F.lit(True))
    marked = lookup(redirects, known.withColumnsRenamed({"title": "from_title", "found": "from_is_page"}), ["from_title"])
    marked = lookup(marked, known.withColumnsRenamed({"title": "to_title", "found": "to_is_page"}), ["to_title"])
    reason = (
        F.when(F.col("from_is_page"), F.lit("source is a page"))
        .when(F.col("from_title") == F.col("to_title"), F.lit("points to itself"))
        .when(F.col("to_is_page").isNull(), F.lit("target is not a page"))
        .when(F.lit(lead_only) & (F.col("fragment") != ""), F.lit("ignored"))
        .otherwise(F.lit("written"))
    )
    return marked.withColumn("reason", reason).select(*redirects.columns, "reason")


def admitted(redirects: DataFrame, pages: DataFrame) -> DataFrame:
    return judge(redirects, pages).filter("reason = 'written'").drop("reason")


def routed(redirects: DataFrame, lead_only: bool | Column = False, keep: Sequence[str] = ()) -> DataFrame:
    """How an admitted redirect is written: natively, as an HTML stub (section targets), or not at all. ``lead_only`` may differ by row."""
    lead = lead_only if isinstance(lead_only, Column) else F.lit(lead_only)
    section = F.concat(title_path("to_title"), F.lit("#"), title_path("fragment"))
    has_fragment = F.col("fragment") != ""
    return redirects.select(
        *keep, title_path("from_title").alias("path"), truncate_words("from_title").alias("title"),
        F.when(has_fragment & lead, F.lit("ignored")).when(has_fragment, F.lit("stub")).otherwise(F.lit("redirect")).alias("route"),
        F.when(has_fragment, section).otherwise(title_path("to_title")).alias("target"),
    )


def report(judged: DataFrame) -> DataFrame:
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("redirects"))
