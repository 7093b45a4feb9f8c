"""Which page records belong to the snapshot, and what is kept of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.constants import BLACKLISTED_NAMESPACES, DEFAULT_CONTENT_MODEL
from corpusweave.functions.text import plain_number, title_path
from corpusweave.plans.keyed import best_per_key, lookup, members_of, missing_from


# --- selection -------------------------------------------------------------------------------------

def select_titles(pages: DataFrame, titles: DataFrame, main_page: str | None = None) -> DataFrame:
    """Pages on the list, plus the main page."""
    wanted = titles.select("title")
    if main_page is not None:
        wanted = wanted.unionByName(wanted.sparkSession.range(1).select(F.lit(main_page).alias("title")))
    return members_of(pages, wanted, ["title"])


def select_namespaces(pages: DataFrame, mirrored: Sequence[int]) -> DataFrame:
    return pages.filter(F.col("ns").isin(*mirrored))


def with_revision(pages: DataFrame) -> DataFrame:
    return pages.filter(F.coalesce(F.size("revisions"), F.lit(0)) > 0)


def with_content_model(pages: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return pages.filter(F.col("contentmodel").isin(DEFAULT_CONTENT_MODEL, *extra))


def without_ignored(pages: DataFrame, ignored: DataFrame) -> DataFrame:
    """Drop pages whose title, or its underscore form, is on the ignore list."""
    # a listed text names a title if it equals the title or its underscore form: one list of both forms per page, one join
    forms = pages.select("title").distinct().select("title", F.explode(F.array_distinct(F.array("title", title_path("title")))).alias("__listed"))
    named = members_of(forms, ignored.select(F.col("title").alias("__listed")), ["__listed"])
    return missing_from(pages, named, ["title"])


def scoped_redirects(redirects: Column, page_ns: Column, mirrored: Sequence[int]) -> Column:
    """Keep redirects that lie in the page's own namespace or in a mirrored one."""
    return F.filter(redirects, lambda r: (r["ns"] == page_ns) | r["ns"].isin(*mirrored))


def namespace_dimension(entries: DataFrame, add: Sequence[int] = (), only: Sequence[int] = ()) -> DataFrame:
    """name, num, allowed_subpages, mirrored for every spelling of every namespace.

    ``entries``: seq, name, canonical, num, subpages, content, is_alias. Spellings differ in the case of
    their first letter; of two entries with one spelling the later one counts. Mirroring is decided per
    number: aliases never count as content.
    """
    listed = F.col("num").isin(*only) if only else (
        ((F.col("content") & ~F.col("is_alias")) | F.col("num").isin(*add)) & ~F.col("name").isin(*BLACKLISTED_NAMESPACES)
    )
    mirrored = entries.filter(listed).select("num").distinct().withColumn("mirrored", F.lit(True))
    spellings = entries.select(
        "seq", "num", F.col("subpages").alias("allowed_subpages"),
        F.explode(F.filter(F.array("name", "canonical"), lambda n: n.isNotNull() & (n != ""))).alias("base"),
    )
    first, rest = F.substring("base", 1, 1), F.expr("substring(base, 2)")
    spellings = spellings.select(
        "seq", "num", "allowed_subpages", F.explode(F.array_distinct(F.array(
            F.concat(F.lower(first), rest), F.concat(F.upper(first), rest)))).alias("name"),
    )
    chosen = best_per_key(spellings, ["name"], F.col("seq")).drop("seq")
    return lookup(chosen, mirrored, ["num"]).withColumn("mirrored", F.coalesce("mirrored", F.lit(False)))


# --- projection ------------------------------------------------------------------------------------

def catalogue_rows(records: DataFrame) -> DataFrame:
    """Page records to catalogue rows: first revision, first coordinate, categories without their prefix."""
    revision, geo = F.get("revisions", F.lit(0)), F.get("coordinates", F.lit(0))
    return records.select(
        "title",
        F.when(F.col("ns") != 0, F.col("ns")).alias("ns"),
        F.when(F.col("contentmodel") != DEFAULT_CONTENT_MODEL, F.col("contentmodel")).alias("contentmodel"),
        revision["revid"].alias("revision_id"), revision["timestamp"].alias("timestamp"),
        F.when(F.col("flagged.stable_revid") != 0, F.col("flagged.stable_revid")).alias("stable_revision_id"),
        F.concat(plain_number(geo["lat"]), F.lit(";"), plain_number(geo["lon"])).alias("coordinates"),
        F.transform("categories", lambda c: F.regexp_extract(c["title"], r"^[^:]*:?(.*)$", 1)).alias("categories"),
        "thumbnail",
        F.when(F.col("categoryinfo").isNotNull(), F.col("categoryinfo").withField(
            "nogallery", F.coalesce(F.col("pageprops")["nogallery"] == "", F.lit(False)))).alias("categoryinfo"),
        "missing", F.col("pagelanguagehtmlcode").alias("pagelang"), F.col("pagelanguagedir").alias("pagedir"),
    )


def render_request(pages: DataFrame, stable: bool, lead_only: bool) -> DataFrame:
    """Revision and section to fetch: the reviewed revision if wanted and known; the lead of wikitext pages only."""
    oldid = F.col("stable_revision_id") if stable else F.lit(None).cast("bigint")
    section = F.when(
        F.lit(lead_only) & F.col("contentmodel").isNull() & ~F.coalesce("missing", F.lit(False)), F.lit("0")
    ).otherwise(F.lit(""))
    return pages.withColumns({"oldid": oldid, "section_id": section})


# --- catalogue as a keyed table ---------------------------------------------------------------------

def upsert(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Later rows replace earlier ones with the same key."""
    return best_per_key(changes, [key], F.col(seq))


def existing(titles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds ``exists`` to asked-for titles."""
    found = catalogue.select("title").distinct().withColumn("exists", F.lit(True))
    return lookup(titles, found, ["title"]).withColumn("exists", F.coalesce("exists", F.lit(False)))


def delete(catalogue: DataFrame, titles: DataFrame) -> DataFrame:
    return missing_from(catalogue, titles, ["title"])


def missing_titles(required: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Titles that must exist but are neither a page nor a redirect; the caller aborts unless this is empty."""
    known = pages.select("title").unionByName(redirects.select(F.col("from_title").alias("title")))
    return missing_from(required.select("title").distinct(), known, ["title"])


def subpage_flags(pages: DataFrame, namespaces: DataFrame) -> DataFrame:
    """A title is a subpage if it has a slash and its namespace (by prefix) allows subpages; the main space never does."""
    has_slash = F.col("title").contains("/") & F.col("title").contains(":")
    marked = pages.withColumn("__ns", F.when(has_slash, F.split("title", ":")[0]))
    allowed = namespaces.select(F.col("name").alias("__ns"), F.col("allowed_subpages").alias("is_subpage"))
    return lookup(marked, allowed, ["__ns"]).withColumn("is_subpage", F.coalesce("is_subpage", F.lit(False))).drop("__ns")


def namespace_names(namespaces: DataFrame) -> DataFrame:
    """num to one name (the first in spelling order)."""
    return namespaces.groupBy("num").agg(F.min("name").alias("ns_name"))
