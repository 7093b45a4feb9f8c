"""What a snapshot finally holds: entry manifest, index page, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave import constants as c
from corpusweave.functions.text import title_path, truncate_words
from corpusweave.plans.keyed import best_per_key, lookup
from corpusweave.session import cut

ENTRY_COLUMNS = ["kind", "path", "title", "mime", "front", "bytes"]


def entries(rows: DataFrame, kind: str, path: Column, title: Column, mime: Column | str, size: Column) -> DataFrame:
    """Rows as manifest entries. An entry without a title is hidden from suggestions."""
    title = F.coalesce(title, F.lit(""))
    mime = F.lit(mime) if isinstance(mime, str) else mime
    return rows.select(
        F.lit(kind).alias("kind"), path.alias("path"), truncate_words(title).alias("title"), mime.alias("mime"),
        (title != "").alias("front"), size.cast("long").alias("bytes"))


def page_entries(pages: DataFrame) -> DataFrame:
    """``pages``: title, display_title (or null), html."""
    shown = F.coalesce(F.nullif("display_title", F.lit("")), F.col("title"))
    return entries(pages, "page", title_path("title"), shown, "text/html", F.octet_length("html"))


def redirect_stub(title: Column, target: Column) -> Column:
    """The page that stands for a redirect to a section and forwards to it."""
    url = F.concat(F.lit("./"), target)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        title, url = F.replace(title, F.lit(raw), F.lit(entity)), F.replace(url, F.lit(raw), F.lit(entity))
    return F.concat(F.lit('<html><head><title>'), title, F.lit('</title><meta http-equiv="refresh" content="0;URL=\''), url, F.lit('\'"></head><body></body></html>'))


def redirect_entries(routed: DataFrame) -> DataFrame:
    """Native redirects and HTML stubs from ``redirects.routed``; ignored ones write nothing."""
    stub = F.octet_length(redirect_stub(F.col("title"), F.col("target")))
    written = routed.filter("route <> 'ignored'")
    return written.select(
        F.col("route").alias("kind"), "path", "title", F.when(F.col("route") == "stub", F.lit("text/html")).alias("mime"),
        F.lit(True).alias("front"), F.when(F.col("route") == "stub", stub).otherwise(0).cast("long").alias("bytes"))


def asset_entries(assets: DataFrame) -> DataFrame:
    """``assets``: path, mime, bytes."""
    return entries(assets, "asset", F.col("path"), F.lit(""), F.col("mime"), F.col("bytes"))


def module_entries(modules: DataFrame) -> DataFrame:
    """``modules``: kind (js, css), module, text (as it is written)."""
    mime = F.when(F.col("kind") == "js", F.lit("text/javascript")).otherwise(F.lit("text/css"))
    path = F.concat(F.lit(c.MODULE_DIR + "/"), "module", F.lit("."), "kind")
    return entries(modules, "module", path, F.lit(""), mime, F.coalesce(F.octet_length("text"), F.lit(0)))


def partial_entries(partials: DataFrame) -> DataFrame:
    """Listing pages with an entry of their own, from ``categories.listing_partials`` with their ``html``; they have no title."""
    return entries(partials.filter("path IS NOT NULL"), "partial", F.col("path"), F.lit(""), "text/html", F.coalesce(F.octet_length("html"), F.lit(0)))


def placeholder_entries(failures: DataFrame) -> DataFrame:
    """Notes in place of pages that failed without ending the run. They have no title, so links lead somewhere and no search finds them.
    ``failures``: as from ``quality.route_failures``, with ``html``, the note."""
    return entries(failures.filter("entry_path IS NOT NULL"), "placeholder", F.col("entry_path"), F.lit(""), "text/html", F.octet_length("html"))


def metadata_entries(metadata: DataFrame) -> DataFrame:
    """``metadata``: key, value."""
    return entries(metadata, "metadata", F.col("key"), F.lit(""), "text/plain", F.octet_length("value"))


def manifest(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*ENTRY_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*ENTRY_COLUMNS))
    return out


def write_manifest(rows: DataFrame, path: str) -> None:
    """Parquet by kind, so that a reader of one kind reads only its files."""
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)


def path_collisions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1")


def index_path(pages: DataFrame, redirects: DataFrame, candidates: Sequence[str] = tuple(c.INDEX_PATH_CANDIDATES)) -> DataFrame:
    """The first candidate that is neither a page nor a redirect; no row if all are taken (the run then aborts)."""
    wanted = F.array(*[F.lit(x) for x in candidates])
    titles = pages.select("title").unionByName(redirects.select(F.col("from_title").alias("title")))
    # at most one row per candidate comes out of the filter and the aggregate
    taken = titles.filter(F.col("title").isin(*candidates)).agg(F.collect_set("title").alias("taken"))
    free = F.filter(wanted, lambda x: ~F.array_contains(F.col("taken"), x))
    return taken.select(F.get(free, F.lit(0)).alias("index_path")).filter("index_path IS NOT NULL")


def index_entries(listed: DataFrame, pages: DataFrame, redirects: DataFrame, limit: int = c.INDEX_MAX_IMAGES) -> DataFrame:
    """Pages of the index, in list order, and its layout: pos, title, has_image, layout.

    Redirects lead to their target; the list is read up to its ``limit``-th page with an image. With more
    than ten images only pages with images are shown, as tiles; otherwise all, as a list.
    """
    targets = best_per_key(redirects.select(F.col("from_title").alias("title"), "to_title"), ["title"], F.col("to_title"))
    entered = lookup(listed.select("pos", "title"), targets, ["title"]).select("pos", F.coalesce("to_title", "title").alias("title"))
    found = cut(lookup(entered, pages.select("title", "has_image"), ["title"], "inner"))
    first = found.filter("has_image").orderBy("pos").limit(limit)
    images, last = first.agg(F.count(F.lit(1)), F.max("pos")).first()
    shown = found.filter(F.col("pos") <= last) if images >= limit else found
    tiled = images > c.INDEX_MIN_IMAGES
    shown = shown.filter("has_image") if tiled else shown
    return shown.select("pos", "title", "has_image", F.lit("tiles" if tiled else "list").alias("layout"))


def entry_stats(rows: DataFrame) -> DataFrame:
    """Entries and bytes by kind and mime, with subtotals (nulls) per kind and overall."""
    return rows.withColumn("mime", F.coalesce("mime", F.lit("none"))).rollup("kind", "mime").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"))
