"""Cleaning of page content, as steps over the token table; each takes and returns tokens."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache, partial, reduce
from itertools import pairwise
from operator import or_
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from corpusweave import constants as c
from corpusweave.functions.assets import asset_path, subtitle_path, subtitle_url
from corpusweave.functions.text import encode_component, let, plain_number, relative_href, title_path
from corpusweave.functions.urls import Site, absolute_url
from corpusweave.plans.intervals import (
    before_drops, count_nearest, drop_first, drop_subtrees, followed_inside, is_start, of_element, with_child, with_next, with_running,
)
from corpusweave.sources.html_tokens import VOID, css_classes, runs, with_rare_collections

ATTRS = "attrs"


def attr(name: str) -> Column:
    return F.col(ATTRS)[name]


def has_class(*names: str) -> Column:
    # most tokens have no class, and words are split by a pattern, so they are only looked at where there are some
    return attr("class").isNotNull() & F.arrays_overlap(css_classes(), F.array(*[F.lit(n) for n in names]))


def _drop_if_none_inside(tokens: DataFrame, boxes: Column, needed: Column, key: str) -> DataFrame:
    return drop_subtrees(with_next(tokens, "__n", needed, key), boxes & ~followed_inside("__n"), key, helpers=("__n",))


# --- removal ---------------------------------------------------------------------------------------

def remove_tags(tokens: DataFrame, nopic: bool = False, key: str = "page_id") -> DataFrame:
    tags = ["link", "input", *(["map"] if nopic else [])]
    return drop_subtrees(tokens, F.col("tag").isin(*tags), key)


def remove_classes(tokens: DataFrame, lead_only: bool = False, extra: tuple[str, ...] = (), key: str = "page_id") -> DataFrame:
    names = [*c.CLASS_BLACKLIST, *(c.CLASS_BLACKLIST_LEAD_ONLY if lead_only else []), *extra]
    return drop_subtrees(tokens, has_class(*names), key)


def remove_linkless(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Hatnotes and the like go when no link is left in them."""
    return _drop_if_none_inside(tokens, has_class(*c.CLASS_BLACKLIST_IF_NO_LINK), is_start("a"), key)


def remove_empty_galleries(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Boxes without a medium go, then galleries without a box of their own."""
    box, gallery = has_class("gallerybox"), has_class("gallery")
    counted = with_next(tokens, "__media", is_start("img", "audio", "video"), key)
    # a box that stays, and that no emptied box around it takes along, has a medium; so boxes are counted as they are
    counted = with_next(counted, "__boxes", is_start() & box & followed_inside("__media"), key)
    empty = (box & ~followed_inside("__media")) | (gallery & ~followed_inside("__boxes"))
    return drop_subtrees(counted, empty, key, helpers=("__media", "__boxes"))


def remove_ids(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Drops the first element with each listed id."""
    return drop_first(tokens, [attr("id") == name for name in c.ID_BLACKLIST], key)


def lead_section(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    outside = (F.col("tag") == "section") & ~attr("data-mw-section-id").eqNullSafe(F.lit(c.LEAD_SECTION_ID))
    return drop_subtrees(tokens, outside, key)


def remove_citations(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    cited = (F.col("tag") == "sup") & F.coalesce(attr("class"), F.lit("")).contains("reference")
    return drop_subtrees(tokens, cited | has_class("mw-ext-cite-error", "mw-references-wrap"), key)


def remove_empty_sections(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Sections whose child elements are headings only. Children are counted as they stand before any removal."""
    heading = (F.col("tag") == "h2") | has_class("mw-heading", "pcs-edit-section-header")
    return drop_subtrees(with_child(tokens, "__child", is_start() & ~heading, key), (F.col("tag") == "section") & ~F.col("__child"), key, helpers=("__child",))


def remove_scripts(tokens: DataFrame, allow_all: bool = False, key: str = "page_id") -> DataFrame:
    return tokens if allow_all else drop_subtrees(tokens, F.col("tag") == "script", key)


def remove_edit_links(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    return drop_subtrees(tokens, has_class("mw-editsection"), key)


def remove_empty_frames(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    kinds = F.split(F.coalesce(attr("typeof"), F.lit("")), r"\s+")
    frame = (F.col("tag") == "figure") | ((F.col("tag") == "span") & F.arrays_overlap(
        kinds, F.array(F.lit("mw:Image/Frameless"), F.lit("mw:File/Frameless"))))
    return _drop_if_none_inside(tokens, frame, is_start("img", "video"), key)


# --- rewriting -------------------------------------------------------------------------------------

def clean_attributes(tokens: DataFrame) -> DataFrame:
    """Editor attributes and two class words go, and forced-display classes lose an inline ``display``."""
    dropped = [F.lit(n) for n in c.ATTRS_DROPPED]
    kept = F.map_filter(ATTRS, lambda k, v: ~k.isin(*dropped))
    words = F.filter(css_classes(), lambda w: ~w.isin(*c.CLASS_TOKENS_DROPPED))
    style = F.regexp_replace(attr("style"), r"(?i)(^|;)\s*display\s*:[^;]*(;|$)", "$1")

    def rewrite(k: Column, v: Column) -> Column:
        return F.when(k == "class", F.array_join(words, " ")).when(
            (k == "style") & has_class(*c.CLASS_FORCED_DISPLAY), style).otherwise(v)

    return tokens.withColumn(ATTRS, F.when(is_start(), F.transform_values(kept, rewrite)).otherwise(F.col(ATTRS)))


def reference_marks(key: str = "page_id") -> dict[str, Column]:
    """What ``reference_spans`` asks of elements; a step before it that goes through the elements may add it."""
    return {"__call": of_element((F.col("tag") == "span") & attr("rel").eqNullSafe(F.lit("dc:references")), key)}


def reference_spans(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Reference spans become ``sup`` with only their id; empty ones go."""
    called = is_start("span") & attr("rel").eqNullSafe(F.lit("dc:references"))
    # elements first, so that all that follows runs in the order of the page; by page before that, as a window by element is finer and would shuffle for itself
    marked = tokens if "__call" in tokens.columns else tokens.repartition(key).withColumns(reference_marks(key))
    # token numbers may have gaps, so an empty element is one whose next token is its own end
    # asked of marked tokens, or the optimizer would put this window below the one by element, and a sort more
    following = F.lead(F.when(F.col("__call"), F.col("elem_id"))).over(Window.partitionBy(key).orderBy("seq"))
    filled = drop_subtrees(marked.withColumn("__next", following), called & F.col("__next").eqNullSafe(F.col("elem_id")), key).drop("__next")
    return filled.withColumns({
        "tag": F.when(F.col("__call"), F.lit("sup")).otherwise(F.col("tag")),
        ATTRS: F.when(F.col("__call") & is_start(), F.map_filter(ATTRS, lambda k, v: k == "id")).otherwise(F.col(ATTRS)),
    }).drop("__call")


def globe_map_links(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """The content of map links that show text is replaced by a globe."""
    page = Window.partitionBy(key).orderBy("seq")
    running = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    link = is_start() & has_class("mw-kartographer-maplink")
    ranges = tokens.withColumns({
        "__from": F.max(F.when(link, F.col("seq"))).over(running), "__to": F.max(F.when(link, F.col("end_seq"))).over(running),
    }).withColumn("__in", F.coalesce((F.col("seq") > F.col("__from")) & (F.col("seq") < F.col("__to")), F.lit(False)))
    # a link's tokens follow one another, so the link of the text before and of the text after tells whether it shows any, in the same order
    shown = F.col("__in") & (F.col("kind") == "text")
    told = ranges.withColumn("__shown", F.when(shown, F.col("__from")))
    told = told.withColumns({
        "__before": F.coalesce(F.max("__shown").over(page.rangeBetween(Window.unboundedPreceding, -1)) == F.col("__from"), F.lit(False)),
        "__after": F.coalesce(F.expr(f"lead(`__shown`) IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY seq)") == F.col("__from"), F.lit(False)),
    })
    first = F.col("__shown").isNotNull() & ~F.col("__before")
    silent = F.col("__shown").isNull() & ~F.col("__before") & ~F.col("__after")
    kept = told.filter(~F.col("__in") | first | silent)
    return kept.withColumn("text", F.when(first, F.lit("🌍")).otherwise(F.col("text"))).drop("__from", "__to", "__in", "__shown", "__before", "__after")


def replace_iframes(tokens: DataFrame, site: Site, key: str = "page_id") -> DataFrame:
    """Embedded frames become a link: videos with a thumbnail, everything else a card; without source they go.

    The new elements are tokens like any other, so later steps see the thumbnail. Token numbers are
    spread by 8 to make room, and new elements get negative numbers.
    """
    room = 8
    iframe = is_start("iframe")
    # what is dropped before, frames without source and what frames hold go in one pass after the new tokens are made, as it takes the tokens in order
    staged = before_drops(tokens, "__gone", key)
    staged = staged.withColumn("__gone", F.col("__gone") | (iframe & (F.coalesce(attr("src"), F.lit("")) == "")))
    attrs, parent = F.col(ATTRS), F.col("parent_id")
    first, second = -(F.col("seq") * 2 + 1), -(F.col("seq") * 2 + 2)

    def mapping(*pairs: tuple[str, Column | str]) -> Column:
        return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in pairs for x in pair])

    def replacement(parts: Column) -> Column:
        anchor = mapping(("class", "external"), ("href", parts["href"]))
        image = F.map_concat(F.map_filter(attrs, lambda k, v: ~k.isin("src", "alt", "loading")),
                             mapping(("src", parts["thumbnail"]), ("alt", c.FRAME_TEXTS["thumbnail"]), ("loading", "lazy")))
        card = F.map_concat(F.map_filter(attrs, lambda k, v: k != "class"),
                            mapping(("class", F.concat_ws(" ", attrs["class"], F.lit(c.FRAME_CARD_CLASS)))))
        labelled = F.map_concat(anchor, mapping(("aria-label", c.FRAME_TEXTS["label"])))
        # kind, element, parent, tag, attributes, text, levels below the frame, number of the last token inside
        layouts = {
            "thumbnail": [("start", first, parent, "a", anchor, None, 0, 2), ("start", second, first, "img", image, None, 1, 1),
                          ("end", first, parent, "a", None, None, 0, 2)],
            "link": [("start", first, parent, "a", labelled, None, 0, 2), ("text", None, first, None, None, c.FRAME_TEXTS["label"], 1, 1),
                     ("end", first, parent, "a", None, None, 0, 2)],
            "card": [("start", first, parent, "div", card, None, 0, 4), ("start", second, first, "a", anchor, None, 1, 3),
                     ("text", None, second, None, None, c.FRAME_TEXTS["card"], 2, 2), ("end", second, first, "a", None, None, 1, 3),
                     ("end", first, parent, "div", None, None, 0, 4)],
        }

        def token(at: int, kind: str, element: Column | None, above: Column, tag: str | None, values: Column | None, text: str | None, below: int, last: int) -> Column:
            cells = {
                "kind": F.lit(kind), "elem_id": F.lit(None) if element is None else element, "parent_id": above, "tag": F.lit(tag), "text": F.lit(text),
                ATTRS: F.lit(None) if values is None else values, "depth": F.col("depth") + below,
                "seq": F.col("seq") * room + at, "end_seq": F.col("seq") * room + last}
            return F.struct(*[cell.cast(types[name]).alias(name) for name, cell in cells.items()])

        chosen = [(parts["kind"] == kind, F.array(*[token(at, *row) for at, row in enumerate(rows)])) for kind, rows in layouts.items()]
        return F.coalesce(*[F.when(*choice) for choice in chosen])

    types = {f.name: f.dataType for f in tokens.schema}
    changed = ("kind", "elem_id", "parent_id", "tag", ATTRS, "text", "depth", "seq", "end_seq")
    # ordinary tokens stay one row each, and nothing is built for them
    dealt = staged.withColumn("__frame", F.explode_outer(F.when(iframe, let(iframe_parts(attr("src"), site), replacement))))
    own = {name: F.col(name) for name in changed} | {name: F.col(name) * room for name in ("seq", "end_seq")}
    dealt = dealt.withColumns({"__held": F.when(iframe, F.col("end_seq") * room)} | {
        n: F.when(F.col("__frame").isNull(), own[n]).otherwise(F.col("__frame")[n]) for n in changed}).drop("__frame")
    left = with_running(drop_subtrees(dealt, F.col("__gone"), key, helpers=("__gone",)), {"__to": F.max("__held")}, key)
    return left.filter("__held IS NOT NULL OR __to IS NULL OR __to < seq").select(*tokens.columns)


def iframe_target(src: Column, site: Site) -> Column:
    """Struct(full, video, video_id) of a frame source: full url, is a video host, video id or null."""

    def found(full: Column) -> Column:
        video = let(F.lower(full), lambda lower: reduce(or_, [lower.contains(mark) for mark in c.VIDEO_HOST_MARKS]))
        return F.struct(full.alias("full"), video.alias("video"), F.nullif(F.regexp_extract(full, c.VIDEO_ID_PATTERN, 1), F.lit("")).alias("video_id"))

    return let(absolute_url(src, site.origin + "/"), found)


def iframe_parts(src: Column, site: Site) -> Column:
    """Struct(kind, href, thumbnail): what a frame is replaced by."""

    def parts(full: Column, video: Column, video_id: Column) -> Column:
        kind = F.when(F.coalesce(src, F.lit("")) == "", "delete").when(~video, "card").when(video_id.isNull(), "link").otherwise("thumbnail")
        return F.struct(
            kind.alias("kind"),
            F.when(kind == "thumbnail", F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)).when(kind != "delete", full).alias("href"),
            F.when(kind == "thumbnail", F.concat(F.lit("https://img.youtube.com/vi/"), video_id, F.lit("/hqdefault.jpg"))).alias("thumbnail"),
        )

    return let(iframe_target(src, site), lambda t: parts(t["full"], t["video"], t["video_id"]))


def media_attributes(tokens: DataFrame, site: Site, page_path: Column) -> DataFrame:
    """Sources of images, audio, video and posters lead to the snapshot; unreadable or indirect images go."""
    base = site.origin + "/"
    tags, image, video, track = is_start("img", "video", "audio", "source", "track"), is_start("img"), is_start("video"), is_start("track")
    attrs, src = F.col(ATTRS), F.coalesce(attr("src"), F.lit(""))
    inline = src.startswith("data:")
    dropped = F.when(image & ~inline, F.array(F.lit("srcset"), F.lit("resource"), F.lit("loading"))).when(
        image, F.array(F.lit("loading"))).when(
        video & attr("poster").isNotNull(), F.array(F.lit("controls"), F.lit("resource"))).when(
        video, F.array(F.lit("controls"))).otherwise(F.array().cast("array<string>"))
    added = F.when(image, F.create_map(F.lit("loading"), F.lit("lazy"))).when(
        video, F.create_map(F.lit("controls"), F.lit("40"))).otherwise(F.create_map().cast("map<string,string>"))

    def place(full: Column) -> Column:
        return relative_href(page_path, F.when(track, subtitle_path(subtitle_url(full))).otherwise(asset_path(full, escape=True)))

    def rewritten(source: Column) -> Column:
        poster = relative_href(page_path, let(absolute_url(attr("poster"), base), lambda full: asset_path(full, escape=True)))

        def value(k: Column, v: Column) -> Column:
            return F.when((k == "src") & ~inline, F.when(track, F.coalesce(source, v)).otherwise(source)).when(k == "poster", F.when(video, poster)).when(
                (k == "height") & video & (v.try_cast("double") < 40), F.lit("40")).otherwise(v)

        lost = image & ((src == "") | src.contains("./Special:FilePath/") | (~inline & source.isNull()))
        kept = F.map_filter(attrs, lambda k, v: ~F.array_contains(dropped, k))
        return F.when(lost, F.array().cast("array<map<string,string>>")).otherwise(F.array(F.map_concat(F.transform_values(kept, value), added)))

    # paths are looked for once and for media only: every other token has the one row without new attributes, lost images have none
    found = F.when(tags, let(let(absolute_url(attr("src"), base), place), rewritten)).otherwise(F.array(F.lit(None).cast("map<string,string>")))
    return tokens.withColumn("__new", F.explode(found)).withColumn(ATTRS, F.when(tags, F.col("__new")).otherwise(attrs)).drop("__new")


# --- no-picture placeholder ------------------------------------------------------------------------

def image_size(attrs: Column, side: str) -> Column:
    """Width or height of an image: attribute, else style, else the size of the file; null if none is positive."""
    style = F.regexp_extract(F.coalesce(attrs["style"], F.lit("")), rf"(?i)(?:^|;)\s*{side}\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*(?:px)?\s*(?:;|$)", 1)

    def positive(v: Column) -> Column:
        return F.when(v > 0, v)

    return F.coalesce(
        positive(attrs[side].try_cast("double")), positive(F.floor(style.try_cast("double") + 0.5).cast("double")),
        positive(attrs[f"data-file-{side}"].try_cast("double")))


def _escape_xml(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def placeholder_svg(attrs: Column) -> Column:
    """The drawing that stands for an image in the variant without pictures."""
    width, height = image_size(attrs, "width"), image_size(attrs, "height")
    alt = F.nullif(F.regexp_replace(F.replace(F.coalesce(attrs["alt"], F.lit("")), F.lit(" "), F.lit(" ")), r"^\s+|\s+$", ""), F.lit(""))
    w, h = (plain_number(F.coalesce(v, F.lit(1.0))) for v in (width, height))
    roomy = F.coalesce((width >= 48) & (height >= 24), F.lit(False))
    font = F.greatest(F.lit(10), F.least(F.lit(16), F.floor(F.coalesce(height, F.lit(1.0)) / 3)))
    title = F.when(alt.isNotNull(), F.concat(F.lit("<title>"), _escape_xml(alt), F.lit("</title>"))).otherwise(F.lit(""))
    # fixed values: the parts of the drawing
    clip = F.when(roomy, F.lit('<defs><clipPath id="alt-text-clip"><rect x="0" y="0" width="100%" height="100%" /></clipPath></defs>')).otherwise(F.lit(""))
    label = F.when(roomy & alt.isNotNull(), F.concat(
        F.lit('<g clip-path="url(#alt-text-clip)"><text x="50%" y="50%" text-anchor="middle" dominant-baseline="middle" fill="#54595d" font-size="'),
        font, F.lit('" font-family="sans-serif">'), _escape_xml(alt), F.lit("</text></g>"))).otherwise(F.lit(""))
    return F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h,
        F.lit('" preserveAspectRatio="none">'), title, clip, F.lit('<rect width="100%" height="100%" fill="transparent"/>'), label, F.lit("</svg>"))


def is_formula_image(attrs: Column) -> Column:
    return F.coalesce(attrs["class"].contains("mwe-math-fallback-image-inline"), F.lit(False)) | attrs["typeof"].eqNullSafe(F.lit("mw:Extension/math"))


def drop_indirect_images(tokens: DataFrame) -> DataFrame:
    """Images without an address of their own are not shown in any variant."""
    src = F.coalesce(attr("src"), F.lit(""))
    return tokens.filter(~(is_start("img") & ((src == "") | src.contains("./Special:FilePath/"))))


def image_placeholders(tokens: DataFrame) -> DataFrame:
    """Replaces images by placeholders; inline data and formula images stay."""
    attrs = F.col(ATTRS)
    swap = is_start("img") & ~F.coalesce(attrs["src"].startswith("data:"), F.lit(False)) & ~is_formula_image(attrs)
    kept = F.map_filter(attrs, lambda k, v: ~k.isin("src", "resource", "srcset", "loading", "width", "height"))
    sizes = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(side).alias("key"), F.coalesce(F.nullif(attrs[side], F.lit("")), plain_number(image_size(attrs, side))).alias("value"))
        for side in ("width", "height")]), lambda e: e["value"].isNotNull()))
    added = F.create_map(
        F.lit("src"), F.concat(F.lit("data:image/svg+xml;charset=UTF-8,"), encode_component(placeholder_svg(attrs))), F.lit("loading"), F.lit("lazy"))
    return tokens.withColumn(ATTRS, F.when(swap, F.map_concat(kept, sizes, added)).otherwise(attrs))


# --- page facts ------------------------------------------------------------------------------------

def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>?", "")


def title_text(display_title: Column, page_title: Column) -> Column:
    """Display title without markup; the page title where nothing is left."""
    return F.coalesce(F.nullif(strip_tags(display_title), F.lit("")), page_title)


def document_title(html: Column) -> Column:
    on_one_line = F.nullif(F.regexp_extract(html, r"(?i)<title( [^>]*)?>(.*)</title>", 2), F.lit(""))
    return strip_tags(F.coalesce(on_one_line, F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1)))


def main_page_heading(override: Column, display_title: Column) -> Column:
    """The main page may override its heading: '' hides it (null here), '-' means no override."""
    return F.when(override.isNull() | (override == "-"), display_title).when(override != "", override)


def footer_facts(pages: DataFrame, site: Site, license_name: Column, license_url: Column, unknown: str) -> DataFrame:
    link = F.concat(F.lit(site.article_url + "?title="), encode_component(title_path("title")), F.lit("&oldid="), F.col("revision_id"))
    return pages.withColumns({
        "last_edit": F.date_format("timestamp", "yyyy-MM-dd"), "permalink": link,
        "license": F.replace(F.coalesce(F.nullif(license_name, F.lit("")), F.nullif(license_url, F.lit("")), F.lit(unknown)), F.lit("<"), F.lit("&lt;")),
        "geo_position": F.col("coordinates"),
    })


def page_config(head_html: Column, extra: Mapping[str, str] | None = None) -> Column:
    """Configuration found in the head, as a map of JSON texts: user keys dropped, fixed keys forced; null if unreadable."""
    dropped = [*c.USER_CONFIG_KEYS, *c.FORCED_CONFIG, *(extra or {})]
    added = {**(extra or {}), **c.FORCED_CONFIG}
    forced = F.create_map(*[F.lit(x) if x is not None else F.lit("null") for kv in added.items() for x in kv])

    def repaired(found: Column) -> Column:
        fixed = F.regexp_replace(F.regexp_replace(found, r'":\s*!0([,}])', '":true$1'), r'":\s*!1([,}])', '":false$1')
        return F.when(found.contains('"wgBreakFrames":!'), fixed).otherwise(found)

    def texts(values: Column) -> Column:
        # open JSON: the values keep their own type as JSON text
        kept = F.map_filter(values, lambda k, v: ~k.isin(*dropped))
        return F.transform_values(kept, lambda k, v: let(
            F.to_json(v), lambda t: F.when((k == "wgAction") & (t == '"nosuchaction"'), F.lit('"view"')).otherwise(t)))

    found = F.coalesce(*[F.nullif(F.regexp_extract(head_html, p, 1), F.lit("")) for p in c.CONFIG_PATTERNS])
    parsed = F.try_variant_get(F.try_parse_json(let(found, repaired)), "$", "map<string,variant>")
    return F.map_concat(F.coalesce(let(parsed, texts), F.create_map().cast("map<string,string>")), forced)


def normal_classes(css: Column, replacements: list[tuple[str, str]]) -> Column:
    """Replace the first occurrence of each listed class text, in order, and squeeze spaces."""
    for old, new in replacements:
        css = F.regexp_replace(css, rf"^(.*?)\Q{old}\E", f"$1{new}")
    return F.array_join(F.filter(F.split(css, " "), lambda w: w != ""), " ")


# --- user hooks ------------------------------------------------------------------------------------

def keep_pages(tokens: DataFrame, wanted: Column, key: str, main_page: Column | None = None) -> DataFrame:
    """Pages with at least one token satisfying ``wanted``; the main page is always kept. Returns the keys."""
    flag = wanted if main_page is None else wanted | main_page
    return tokens.groupBy(key).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias("__keep")).filter("__keep").select(key)


def transform_pages(tokens: DataFrame, step: Callable[[DataFrame], DataFrame], main_page: Column | None = None) -> DataFrame:
    """Apply a user's token step to all pages, or to all but the main page.

    Tokens are read once. Those of the main page go through the step veiled: of a kind of their own, without tag, attributes and text, so
    no rule of a step meets them; afterwards they have their own values again. A step keeps columns that it doesn't know.
    """
    if main_page is None:
        return step(tokens)
    names = ["kind", "tag", ATTRS, "text"]
    staged = tokens.withColumn("__main", F.when(main_page, F.struct(*names)))
    blank = {"kind": F.lit("main"), "tag": F.lit(""), ATTRS: F.create_map().cast("map<string,string>"), "text": F.lit("")}
    veiled = staged.withColumns({n: F.when(F.col("__main").isNull(), F.col(n)).otherwise(v) for n, v in blank.items()})
    out = step(veiled)
    return out.withColumns({n: F.when(F.col("__main").isNull(), F.col(n)).otherwise(F.col("__main")[n]) for n in names}).drop("__main")


def transform_each_page(tokens: DataFrame, step: Callable[[Any, list[Row]], Iterable[Row | tuple]], key: str = "page_id", skipped: Column | None = None) -> DataFrame:
    """Apply a user's function to the tokens of one page at a time: ``step(page, tokens)`` gets them in order and gives the tokens of the new page.

    For code that needs a page as a whole; rules that are columns are better off in ``transform_pages``. Tokens come sorted to a task that holds a batch and a page.
    What the function gives has the columns of ``tokens``; ``seq`` must be in order and ``end_seq`` of a start its end's ``seq``, as far as later steps need
    them (``renumbered`` sees to both). Pages that satisfy ``skipped``, such as the main page, don't pass through it.
    """
    names = list(tokens.columns)
    place = names.index(key)
    schema = to_arrow_schema(tokens.schema)
    # tokens that are skipped travel with the others, as a filter for them would parse every page a second time
    staged = tokens.withColumn("__skipped", F.lit(False) if skipped is None else F.coalesce(skipped, F.lit(False)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = token_type(names)
        passed: list[pa.RecordBatch] = []

        def in_order(token: Row | tuple) -> tuple | list:
            return [token[n] for n in names] if isinstance(token, Row) and token.__fields__ != names else token

        def worked_on() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flags, batch = batch.column(len(names)), batch.select(names)
                if flags.true_count:
                    passed.append(batch.filter(flags))
                    batch = batch.filter(pc.invert(flags))
                yield batch

        for part, ends in runs(worked_on(), place):
            rows = [*map(make, zip(*[(attribute_dicts if n == ATTRS else python_values)(c) for n, c in zip(names, part.columns)], strict=True))]
            own = type(rows[0])
            out: list[Row | tuple | list] = []
            for begin, end in pairwise([0, *ends.tolist()]):
                out += [token if type(token) is own else in_order(token) for token in step(rows[begin][place], rows[begin:end])]
            if out:
                columns = zip(schema, zip(*out, strict=True), strict=True)
                yield pa.RecordBatch.from_arrays([attribute_maps(c, f.type) if f.name == ATTRS else pa.array(c, f.type) for f, c in columns], schema=schema)
        for batch in passed:
            yield pa.RecordBatch.from_arrays(batch.columns, schema=schema)

    return staged.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(with_rare_collections(work), tokens.schema)


def python_values(column: pa.Array) -> list:
    """``to_pylist`` for the types of most token columns, whole columns at once: it makes an object of Arrow's for each value on the way."""
    if pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not pa.types.is_integer(column.type):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    values = column.fill_null(0).to_numpy().astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def attribute_dicts(column: pa.MapArray) -> list[dict | None]:
    first, last = (column.offsets[i].as_py() for i in (0, -1))
    names, values = (python_values(part.slice(first, last - first)) for part in (column.keys, column.items))
    known = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    spans = pairwise((column.offsets.to_numpy() - first).tolist())
    return [(dict(zip(names[b:e], values[b:e])) if e > b else {}) if there else None for there, (b, e) in zip(known, spans, strict=True)]


def attribute_maps(attrs: Iterable[dict | None], kind: pa.MapType) -> pa.MapArray:
    names, values, begins = [], [], []
    for pairs in attrs:
        begins.append(None if pairs is None else len(names))
        if pairs:
            names += pairs
            values += pairs.values()
    return pa.MapArray.from_arrays(pa.array([*begins, len(names)], pa.int32()), pa.array(names, kind.key_type), pa.array(values, kind.item_type), kind)


def token_type(names: list[str]) -> Callable[[Iterable], Row]:
    """Makes rows with these fields, whose fields are found by their places and not by a search for the name."""
    return _token_type(tuple(names))


@lru_cache
def _token_type(names: tuple[str, ...]) -> Callable[[Iterable], Row]:
    like = namedtuple("Token", names, rename=True)  # its fields are read faster than properties
    fields = {n: vars(like)[like._fields[i]] for i, n in enumerate(names) if not hasattr(Row, n)}
    return partial(tuple.__new__, type("Token", (Row,), {**fields, "__fields__": [*names]}))


def renumbered(page: list[Row]) -> list[Row]:
    """Tokens of a page, in their order, with ``seq``, ``end_seq``, ``depth`` and element numbers that fit; starts and ends must be nested."""
    if not page:
        return []
    names = page[0].__fields__
    alike = [token if token.__fields__ is names or token.__fields__ == names else [token[n] for n in names] for token in page]
    columns = dict(zip(names, zip(*alike, strict=True), strict=True))
    ends, depths, parents, elements = [*range(len(page))], [], [], []
    path: list[int] = []  # places of open elements
    depth, parent, number = 0, None, 0
    for seq, (kind, tag) in enumerate(zip(columns["kind"], columns["tag"])):
        if kind == "end":
            begun = path.pop()
            ends[begun] = seq
            depth, parent = depths[begun], parents[begun]
            depths.append(depth)
            parents.append(parent)
            elements.append(elements[begun])
            continue
        depths.append(depth)
        parents.append(parent)
        if kind != "start":
            elements.append(None)
            continue
        elements.append(number)
        if tag not in VOID:
            path.append(seq)
            depth, parent = depth + 1, number
        number += 1
    columns |= {"seq": range(len(page)), "end_seq": ends, "depth": depths, "parent_id": parents, "elem_id": elements}
    return [*map(token_type(names), zip(*columns.values(), strict=True))]


def keep_language_section(tokens: DataFrame, language: str, key: str = "page_id") -> DataFrame:
    """Pages with a section heading of the language; other languages' ``details`` and minor headings' go."""
    heading = is_start() & has_class("sectionlangue")
    # whole pages in the order of their tokens, which is that of the steps between
    page = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.max(F.when(heading & attr("id").eqNullSafe(F.lit(language)), True)).over(page)
    kept = tokens.withColumn("__wanted", wanted).filter("__wanted").drop("__wanted")
    unwanted = (heading & ~attr("id").eqNullSafe(F.lit(language))) | is_start("h4")
    counted = count_nearest(kept, "details", unwanted, "__bad", key)
    left = drop_subtrees(counted, (F.col("tag") == "details") & (F.col("__bad") > 0), key).drop("__bad")
    # of the summaries around the first heading the last one to start is the nearest
    headed = left.withColumn("__h2", F.min(F.when(is_start("h2"), F.col("seq"))).over(page))
    around = is_start("summary") & (F.col("seq") < F.col("__h2")) & (F.col("end_seq") >= F.col("__h2"))
    summaries = headed.withColumn("__holder", F.max(F.when(around, F.col("seq"))).over(page))
    hidden = F.map_concat(F.map_filter(ATTRS, lambda k, v: k != "style"), F.create_map(F.lit("style"), F.lit("display:none! important")))
    holds = is_start("summary") & F.col("seq").eqNullSafe(F.col("__holder"))
    return summaries.withColumn(ATTRS, F.when(holds, hidden).otherwise(F.col(ATTRS))).drop("__h2", "__holder")
