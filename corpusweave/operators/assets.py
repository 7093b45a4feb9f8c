"""Asset manifest: references, best resolution per path, source choice, cache state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave import constants as c
from corpusweave.functions.assets import asset_path, subtitle_path, subtitle_url, url_multiplier, url_width
from corpusweave.functions.text import relative_href
from corpusweave.functions.urls import Site, absolute_url, url_host, without_http
from corpusweave.operators.links import Flags
from corpusweave.plans.intervals import drop_subtrees, is_start, with_running
from corpusweave.plans.keyed import best_per_key, lookup

FULL_SIZE = 10_000_000


# --- references ------------------------------------------------------------------------------------

def file_elements(tokens: DataFrame) -> DataFrame:
    """The tokens that ``token_refs`` and ``media_sources`` look at: starts of elements that name files."""
    return tokens.filter(is_start("img", "video", "audio", "source", "track"))


def token_refs(tokens: DataFrame, site: Site, key: str = "page_id") -> DataFrame:
    """key, url, kind, width, seq of the images, posters and subtitles a page's elements name.

    Images without a readable source are left out. Sound and film come from ``media_sources``.
    """
    attr = F.col("attrs")
    src = F.coalesce(attr["src"], F.lit(""))
    usable = (src != "") & ~src.contains("./Special:FilePath/") & ~src.startswith("data:")
    width = F.coalesce(_positive(attr["width"]), _positive(attr["data-width"]))

    def ref(when: Column, kind: str, url: Column, w: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), url.alias("href"), w.alias("width")))

    none = F.lit(None).cast("long")
    found = F.array_compact(F.array(
        ref(is_start("img") & usable, "image", src, width),
        ref(is_start("video") & (F.coalesce(attr["poster"], F.lit("")) != ""), "image", attr["poster"], _positive(attr["width"])),
        ref(is_start("track") & usable, "subtitle", src, none),
    ))
    rows = tokens.filter(is_start("img", "video", "track")).select(key, "seq", F.inline(found)).withColumn("url", absolute_url("href", site.origin + "/"))
    return rows.select(key, F.when(F.col("kind") == "subtitle", subtitle_url(F.col("url"))).otherwise(F.col("url")).alias("url"), "kind", "width", "seq")


def _with_choice(tokens: DataFrame, key: str) -> DataFrame:
    """Adds to video and audio elements and their sources: __at (where the element starts), __chosen (the start token of the source taken, the
    element itself where it has no sources) and __address. Windows inside the page; no token is joined to another.

    An element with ``source`` children is judged by them alone; without, its own address counts. A video without a webm
    source has no choice.
    """
    attr, owner, source = F.col("attrs"), is_start("video", "audio"), is_start("source")
    family = Window.partitionBy(key, "__owner")
    own = F.struct("tag", "seq", attr["width"].try_cast("double").cast("long").alias("display_width"))
    staged = tokens.withColumn("__owner", F.when(owner, F.col("elem_id")).when(source, F.col("parent_id"))).withColumns({
        "__own": F.max(F.when(owner, own)).over(family), "__sources": F.count_if(source).over(family)})
    address = F.when(source, attr["src"]).when(F.col("tag") == "audio", F.coalesce(attr["src"], attr["resource"])).otherwise(attr["src"])
    candidate = F.col("__owner").isNotNull() & F.col("__own").isNotNull() & (source | (F.col("__sources") == 0))
    staged = staged.withColumn("__address", F.when(candidate, F.nullif(address, F.lit(""))))
    pos, src = F.col("seq"), F.col("__address")
    width = F.coalesce(_positive(attr["data-file-width"]), _positive(attr["data-width"]))
    film = F.max_by(pos, F.when(src.endswith(".webm") & (F.col("__own.tag") == "video"), video_rank(src, width, F.col("__own.display_width"), pos)))
    sound = F.max_by(pos, F.when(src.isNotNull() & (F.col("__own.tag") == "audio"), audio_rank(src, attr["type"], pos)))
    return staged.withColumns({"__at": F.col("__own.seq"), "__chosen": F.coalesce(film.over(family), sound.over(family))}).drop("__own", "__sources", "__owner")


def media_sources(tokens: DataFrame, site: Site, key: str = "page_id") -> DataFrame:
    """The one source taken for each video and audio element, in the columns of ``token_refs`` plus source_seq."""
    kept = _with_choice(file_elements(tokens), key).filter(F.col("__chosen") == F.col("seq"))
    return kept.select(
        key, absolute_url("__address", site.origin + "/").alias("url"), F.lit("video").alias("kind"), F.lit(None).cast("long").alias("width"),
        F.col("__at").alias("seq"), F.col("seq").alias("source_seq"))


def prune_sources(tokens: DataFrame, key: str = "page_id", step: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
    """Keep of each video and audio element the chosen source only; elements without one go.

    ``step`` is what is done to each token besides: it runs when sources are chosen and before tokens are put in order again.
    """
    media = F.col("tag").isin("video", "audio")
    chosen = _with_choice(tokens, key).select(
        *tokens.columns, (media & F.col("__chosen").isNull()).alias("__lost"), (is_start("source") & ~F.col("__chosen").eqNullSafe(F.col("seq"))).alias("__spare"))
    left = drop_subtrees(step(chosen), F.col("__lost"), key, helpers=("__lost",))
    marked = with_running(left, {"__media": F.max(F.when(is_start() & media, F.col("end_seq")))}, key)
    return marked.filter(~F.coalesce(F.col("__spare") & (F.col("__media") >= F.col("seq")), F.lit(False))).select(*tokens.columns)


def _positive(value: Column) -> Column:
    number = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*\+?([0-9]+)", 1).try_cast("long")
    return F.when(number > 0, number)


def page_deps(element_refs: DataFrame, classified_links: DataFrame, style_refs: DataFrame, key: str = "page_id") -> DataFrame:
    """All files a page needs: key, url, kind, width, path.

    ``element_refs`` as from ``token_refs`` and ``media_sources``; ``classified_links`` as from ``links.classify``; ``style_refs``:
    key, full_url of inline styles. Several uses of one URL stay; ``best_resolution`` weighs them all.
    """
    none = F.lit(None).cast("long")
    media = classified_links.filter("asset_url IS NOT NULL").select(key, F.col("asset_url").alias("url"), F.lit("media").alias("kind"), none.alias("width"))
    styles = style_refs.select(key, F.col("full_url").alias("url"), F.lit("media").alias("kind"), none.alias("width"))
    refs = element_refs.select(key, "url", "kind", "width").unionByName(media).unionByName(styles)
    return with_paths(refs).filter("path IS NOT NULL")


def first_uses(refs: DataFrame, page: str, order: str) -> DataFrame:
    """One row per page and URL: its first use."""
    return refs.groupBy(page, "url").agg(F.min_by("kind", order).alias("kind"), F.min(order).alias(order))


def requested_widths(refs: DataFrame, page: str) -> DataFrame:
    """Largest requested width per page and URL; uses without a width do not count."""
    return refs.filter("width > 0").groupBy(page, "url").agg(F.max("width").alias("width"))


def with_paths(refs: DataFrame, escape: bool = False) -> DataFrame:
    """Adds path; subtitles (by ``kind``, where refs have it) lie under their title and language."""
    path = asset_path("url", escape)
    return refs.withColumn("path", F.when(F.col("kind") == "subtitle", subtitle_path(F.col("url"))).otherwise(path) if "kind" in refs.columns else path)


def best_resolution(refs: DataFrame, first: list[Column], keep: list[str]) -> DataFrame:
    """One row per path: the largest width, then multiplier, then the first use (smallest ``first`` numbers).

    The width is the requested one, else the one in the URL; a use with neither asks for the full size.
    """
    sized = refs.withColumns({
        "width": F.coalesce("width", url_width("url")), "mult": url_multiplier("url"), "__first": F.struct(*[(-f).alias(f"f{i}") for i, f in enumerate(first)]),
    }).select("path", "url", "width", "mult", *keep, "__first")
    order = F.struct(F.coalesce("width", F.lit(FULL_SIZE)), F.coalesce("mult", F.lit(1.0)), F.col("__first"))
    return best_per_key(sized, ["path"], order).drop("__first")


# --- source choice ---------------------------------------------------------------------------------

def video_rank(src: Column, width: Column, display_width: Column, pos: Column) -> Column:
    """Order of webm sources; the largest is taken.

    With a display width: the smallest source at least as wide, else the widest; among equals the last
    vp9, else the first. Without: the widest, then vp9, then the first.
    """
    vp9 = src.endswith(".vp9.webm")
    width = F.coalesce(width, F.lit(0))
    diff = width - display_width
    sized = F.coalesce(display_width > 0, F.lit(False))
    return F.struct(
        F.when(sized, diff >= 0).otherwise(F.lit(True)).cast("int"),
        F.when(sized, -F.abs(diff)).otherwise(width).cast("long"),
        vp9.cast("int"),
        F.when(sized & vp9, pos).otherwise(-pos).cast("long"),
    )


def audio_rank(src: Column, kind: Column, pos: Column) -> Column:
    """The first ogg source, else the first; the largest is taken."""
    ogg = F.coalesce(kind.startswith("audio/ogg"), F.lit(False)) | F.coalesce(src.endswith(".ogg"), F.lit(False))
    return F.struct(ogg.cast("int"), (-pos).cast("long"))


def choose_video_source(sources: DataFrame, *video: str) -> DataFrame:
    """One webm source per video (its key columns): pos, src, width, display_width in; the chosen row out."""
    rank = video_rank(F.col("src"), F.col("width"), F.col("display_width"), F.col("pos"))
    return best_per_key(sources.filter(F.col("src").endswith(".webm")), video, rank)


def choose_audio_source(sources: DataFrame, *audio: str) -> DataFrame:
    """One source per audio element: pos, src, type in; the chosen row out."""
    return best_per_key(sources, audio, audio_rank(F.col("src"), F.col("type"), F.col("pos")))


def subtitle_refs(tracks: DataFrame, site: Site) -> DataFrame:
    """Adds url (as vtt), path and src of subtitle tracks: page_path, src."""
    url = subtitle_url(absolute_url("src", site.origin + "/"))
    return tracks.withColumn("url", url).withColumn("path", subtitle_path(F.col("url"))).withColumn("new_src", relative_href("page_path", "path"))


def media_decision(tag: Column, src: Column, is_formula: Column, flags: Flags) -> Column:
    """What a variant does with a media element: drop, keep, placeholder or fetch."""
    silent = F.lit(flags.nopic or flags.novid or flags.nodet)
    src = F.coalesce(src, F.lit(""))
    return (
        F.when(tag.isin("audio", "video"), F.when(silent, "drop").otherwise("fetch"))
        .when((src == "") | src.contains("./Special:FilePath/"), "drop")
        .when(src.startswith("data:"), "keep")
        .when(F.lit(flags.nopic) & ~is_formula, "placeholder")
        .otherwise("fetch")
    )


# --- cache -----------------------------------------------------------------------------------------

def cache_version(width: Column, webp: bool) -> Column:
    """Version token of a cached image: its format and the width it was asked for."""
    return F.concat(F.lit("webp" if webp else "1"), F.when(width > 0, F.concat(F.lit("-w"), width)).otherwise(F.lit("")))


def strong_etag(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def reconcile_cache(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``state`` and ``if_none_match`` to wanted assets (url, version, upstream_etag or null).

    ``cache``: cache_key (URL without scheme, unique), cached_version, cached_etag, length. miss: nothing
    usable is cached; stale: another version, so it is fetched anew; revalidate: ask with the tag; hit: the
    upstream tag is already known to be the same.
    """
    joined = lookup(wanted.withColumn("cache_key", without_http(F.col("url"))), cache, ["cache_key"])
    tag = strong_etag(F.col("cached_etag"))
    usable = (F.coalesce("length", F.lit(0)) > 0) & F.col("cached_etag").isNotNull()
    current = F.col("cached_version").eqNullSafe(F.col("version"))
    state = (
        F.when(~usable, "miss").when(~current, "stale")
        .when(strong_etag(F.col("upstream_etag")).eqNullSafe(tag), "hit").otherwise("revalidate")
    )
    return joined.select(*wanted.columns, state.alias("state"), F.when(usable & current, tag).alias("if_none_match"))


# --- mime, hosts, thumbnails -----------------------------------------------------------------------

def mime_of(path: Column) -> Column:
    """MIME type by extension, null for files that are not kept."""
    extension = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))
    return F.create_map(*[F.lit(x) for kv in c.MIME_BY_EXTENSION.items() for x in kv])[extension]


def mime_flags(mime: Column) -> Column:
    return F.struct(
        mime.rlike(c.IMAGE_MIME_PATTERN).alias("is_image"), mime.rlike(c.BITMAP_MIME_PATTERN).alias("is_bitmap"),
        mime.rlike(c.WEBP_CANDIDATE_MIME_PATTERN).alias("is_webp_candidate"))


def host_rollup(fetches: DataFrame) -> DataFrame:
    """Assets, successes and failures per host. ``fetches``: url, ok."""
    return fetches.groupBy(url_host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("assets"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("fail"))


def listed_thumbnails(listed: DataFrame, limit: int = c.INDEX_MAX_IMAGES) -> DataFrame:
    """First ``limit`` listed pages with a thumbnail, the thumbnail asked for 500 px wide. ``listed``: pos, title, source."""
    top = listed.filter("source IS NOT NULL").orderBy("pos").limit(limit)
    width = url_width("source")

    def resize(url: Column, mark: str) -> Column:
        return F.regexp_replace(url, F.concat(F.lit(f"^(.*?){mark}"), width, F.lit("px-")), F.lit(f"$1{mark}500px-"))

    url = F.when(width.isNull(), F.col("source")).otherwise(resize(resize(F.col("source"), "/"), "-"))
    sized = top.withColumn("url", url)
    return sized.withColumns({"path": asset_path("url"), "width": url_width("url"), "mult": url_multiplier("url")}).withColumn(
        "internal_url", F.concat(F.lit("./"), asset_path("url", escape=True)))
