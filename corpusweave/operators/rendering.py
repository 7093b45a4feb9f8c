"""The standard order of content steps for one snapshot variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.urls import Site
from corpusweave.operators import assets, content, dependencies, links
from corpusweave.operators.links import Flags
from corpusweave.plans.intervals import drop_subtrees


def clean_pages(tokens: DataFrame, site: Site, page_path: Column, flags: Flags = Flags(), allow_all_scripts: bool = False,
                keep_empty_sections: bool = False, key: str = "page_id") -> DataFrame:
    """Everything between rewritten links and media: later steps see what earlier ones left.

    Frames come first, so that thumbnails are treated as images; galleries are judged before classes are
    removed; attributes come last, because classes and ids are still needed until then. Frames never become what ``remove_tags`` takes,
    so it comes before them, where it shares a pass.
    """
    out = content.replace_iframes(content.remove_tags(content.remove_edit_links(tokens, key), flags.nopic, key), site, key)
    if flags.nodet:
        out = content.remove_citations(out, key)
    out = content.remove_empty_galleries(out, key)
    out = content.remove_classes(out, lead_only=flags.nodet, key=key)
    if flags.nodet:
        out = content.lead_section(out, key)
    out = content.reference_spans(content.remove_linkless(out, key), key)
    out = dependencies.rewrite_inline_styles(out, site, page_path, key)
    out = content.remove_scripts(content.remove_ids(out, key), allow_all_scripts, key)
    if not keep_empty_sections:
        out = content.remove_empty_sections(out, key)
    return content.globe_map_links(content.clean_attributes(out), key)


def place_media(tokens: DataFrame, site: Site, page_path: Column, flags: Flags = Flags(), key: str = "page_id") -> DataFrame:
    """Media of cleaned pages: sources chosen and led to the snapshot, or replaced where the variant leaves them out."""
    def led(heard: DataFrame) -> DataFrame:
        return content.media_attributes(heard, site, page_path)

    if flags.nopic or flags.novid or flags.nodet:
        heard = drop_subtrees(tokens, F.col("tag").isin("video", "audio"), key)
        if flags.nopic:
            heard = content.image_placeholders(content.drop_indirect_images(heard))
        placed = led(heard)
    else:
        placed = assets.prune_sources(tokens, key, step=led)
    return content.remove_empty_frames(placed, key)


def render(tokens: DataFrame, known: DataFrame, site: Site, page_path: Column, flags: Flags = Flags(), key: str = "page_id") -> DataFrame:
    """Links, cleaning and media in their order. ``tokens`` is a table (``html_tokens.tokenize_to_table``), as links are looked up apart from it.

    Tokens are shuffled once, by page; the only other shuffle is that of link titles and known titles.
    """
    decided = links.classify(links.anchors(tokens, key).withColumn("page_path", page_path), site, flags)
    linked = links.rewrite_links(tokens, decided, known, key, marks=content.reference_marks(key))
    return place_media(clean_pages(linked, site, page_path, flags, key=key), site, page_path, flags, key)
