"""Link graph: extraction, classification, resolution against the catalogue, relative hrefs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave import constants as c
from corpusweave.functions.assets import asset_path
from corpusweave.functions.text import link_href, relative_href, title_path
from corpusweave.functions.urls import Site, absolute_url, geo_href, href_title, is_map_href, scheme
from corpusweave.plans.intervals import drop_subtrees
from corpusweave.plans.keyed import lookup


@dataclass(frozen=True)
class Flags:
    """What a snapshot variant leaves out; columns where rows are of different variants."""

    nopic: bool | Column = False
    novid: bool | Column = False
    nopdf: bool | Column = False
    nodet: bool | Column = False


def anchors(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """All links of a page in document order: key, elem_id, pos, tag, href, class, rel, resource."""
    starts = tokens.filter((F.col("kind") == "start") & F.col("tag").isin("a", "area"))
    attr = F.col("attrs")
    order = F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1
    return starts.select(
        key, "elem_id", order.cast("long").alias("pos"), "tag", F.coalesce(attr["href"], F.lit("")).alias("href"),
        F.coalesce(attr["class"], F.lit("")).alias("class"), F.coalesce(attr["rel"], F.lit("")).alias("rel"),
        attr["resource"].alias("resource"),
    )


def media_wanted(href: Column, flags: Flags) -> Column:
    sound = (href.contains(".ogg") | href.contains(".oga")) & ~(F.lit(flags.nopic) | F.lit(flags.novid) | F.lit(flags.nodet))
    return (href.contains(".pdf") & ~F.lit(flags.nopdf)) | sound


def classify(links: DataFrame, site: Site, flags: Flags = Flags()) -> DataFrame:
    """Decide each link. Input: page_path, href, rel, class, resource.

    Adds action (keep, unwrap, delete, geo, media, external, wiki), new_href, title (wiki targets),
    asset_url (media to fetch) and mark_external. Later rules see the href, rel and class as changed by
    earlier ones, so each change is a column of its own; the decision is one CASE over them.
    """
    def words(name: str) -> Column:
        return F.filter(F.split(F.coalesce(F.col(name), F.lit("")), " "), lambda w: w != "")

    def has(name: str, word: str) -> Column:
        return F.array_contains(F.col(name), word)

    # addresses are only worked out for links that the first rules leave open
    first = (has("__class", c.CLASS_NO_REWRITE) | (has("__class", c.CLASS_SELF_LINK) & (F.col("__href") == "")) | has("__class", c.CLASS_RED_LINK)
             | (F.col("__scheme0").isNotNull() & ~F.col("__scheme0").contains("http")) | has("__rel0", c.REL_NO_REWRITE))
    staged = links.withColumns({
        "__href": F.coalesce("href", F.lit("")), "__class": words("class"), "__rel0": words("rel"),
    }).withColumns({
        "__scheme0": scheme("__href"),
        "__bare": scheme("__href").isNull() & F.col("__href").startswith("//"),
    }).withColumns({
        "__url": F.when(F.col("__bare"), F.concat(F.lit(site.protocol), "__href")).otherwise(F.col("__href")),
        "__web": F.col("__bare") | F.coalesce(F.col("__scheme0").contains("http"), F.lit(False)),
        "__rel1": F.when((F.size("__rel0") == 0) & (F.coalesce("resource", F.lit("")) != ""), F.array(F.lit(c.REL_MEDIA))).otherwise(F.col("__rel0")),
    }).withColumns({
        "__rel": F.when(F.col("__web") & (F.size("__rel1") == 0), F.array(F.lit(c.REL_EXTERNAL))).otherwise(F.col("__rel1")),
        "__open": ~first & (F.col("__url") != "") & ~F.col("__url").startswith("#"),
    }).withColumns({
        "__geo": F.when(F.col("__open") & is_map_href(F.col("__url")), geo_href("__url")),
        "__title": F.when(F.col("__open"), href_title("__url", site)), "__abs": F.when(F.col("__open"), absolute_url("__url", site.origin + "/")),
    }).withColumns({
        "__outside": ~(F.col("__url").startswith(site.article_url) & ~has("__class", "external")) & ~has("__class", c.CLASS_MIRROR_LINK),
        "__foreign": has("__rel", c.REL_EXTERNAL) | has("__rel", c.REL_INTERWIKI) | has("__class", "extiw"),
        "__is_wiki": has("__rel", c.REL_WIKI),
        "__asset": F.when(F.col("__open") & media_wanted(F.col("__url"), flags), asset_path("__abs", escape=True)),
    })
    url = F.col("__url")
    external = has("__class", "external") | F.col("__foreign")
    media = ~F.col("__is_wiki") & ~is_map_href(url) & (has("__rel", c.REL_MEDIA) | has("__class", "internal"))
    asset_url = F.col("__abs")
    leaves = F.col("__outside") & (external | has("__rel", "nofollow"))
    other_rel = F.col("__outside") & (F.size("__rel") > 0) & ~F.col("__is_wiki") & ~has("__rel", c.REL_REFERENCED_BY)
    action = (
        F.when(has("__class", c.CLASS_NO_REWRITE), "keep")
        .when(has("__class", c.CLASS_SELF_LINK) & (F.col("__href") == ""), "keep")
        .when(has("__class", c.CLASS_RED_LINK), "unwrap")
        .when(F.col("__scheme0").isNotNull() & ~F.col("__scheme0").contains("http"), "keep")
        .when(has("__rel0", c.REL_NO_REWRITE), "keep")
        .when(url == "", "delete")
        .when(url.startswith("#"), "keep")
        .when(~F.col("__is_wiki") & F.col("__geo").isNotNull(), "geo")
        .when(media & F.col("__asset").isNotNull(), "media")
        .when(media & media_wanted(url, flags), "delete")
        .when(media, "unwrap")
        .when(leaves & url.startswith("/"), "external")
        .when(leaves & url.startswith("./"), "unwrap")
        .when(leaves, "external")
        .when(other_rel, "keep")
        .when(F.col("__title").isNotNull(), "wiki")
        .otherwise("external")
    )
    # a later filter on the action must not be pushed below it, or the chain would be evaluated twice
    decided = staged.select("*", F.explode(F.array(action)).alias("action"))
    act = F.col("action")
    anchor = F.regexp_extract(url, r"(#[^#]*)$", 1)
    new_href = (
        F.when(act == "geo", F.col("__geo"))
        .when(act == "media", relative_href("page_path", "__asset"))
        .when((act == "external") & (url.startswith("/") | ~leaves), asset_url)
        .when(act == "wiki", F.concat(link_href("__title"), anchor))
        .when(act.isin("keep", "external"), url)
    )
    mark = (act == "external") & ~has("__class", "external") & (F.col("__foreign") | ~leaves)
    return decided.select(
        *links.columns, "action", new_href.alias("new_href"), F.when(act == "wiki", F.col("__title")).alias("title"),
        F.when(act == "media", asset_url).alias("asset_url"), mark.alias("mark_external"),
    )


def known_titles(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """title, state for everything a link may lead to; a title that is both counts as a page."""
    both = pages.select("title", F.lit("page").alias("state")).unionByName(
        redirects.select(F.col("from_title").alias("title"), F.lit("redirect").alias("state")))
    return both.groupBy("title").agg(F.min("state").alias("state"))


def resolve(links: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``state``: page, redirect, or unwrap for titles outside the snapshot. Popular titles are salted."""
    return lookup(links, known, ["title"]).withColumn("state", F.coalesce("state", F.lit("unwrap")))


def final_hrefs(decided: DataFrame) -> DataFrame:
    """Hrefs of wiki links as seen from their page; only pages below the root need the steps up."""
    below = (F.col("action") == "wiki") & F.col("page_path").contains("/")
    return decided.withColumn("new_href", F.when(below, relative_href("page_path", "new_href")).otherwise(F.col("new_href")))


def rewrite_links(tokens: DataFrame, decided: DataFrame, known: DataFrame, key: str = "page_id", marks: Mapping[str, Column] | None = None) -> DataFrame:
    """Tokens with every link as decided: ``decided`` is ``classify(anchors(tokens))`` with its page_path.

    Wiki links outside the snapshot are unwrapped like the rest of that kind; their text stays. ``marks`` are columns of ``intervals.of_element`` that a later
    step wants, which are brought to the tokens on the way.
    """
    lost = (F.col("action") == "wiki") & (F.col("state") == "unwrap")
    final = final_hrefs(resolve(decided, known))
    verdicts = final.select(
        key, "elem_id", F.when(lost, "unwrap").otherwise(F.col("action")).alias("__action"), F.col("new_href").alias("__href"), F.col("mark_external").alias("__mark"))
    # brought to the element's tokens by a window of the page, so that tokens keep to their page in the shuffle
    columns = ["__action", "__href", "__mark"]
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in tokens.schema.fields if f.name not in (key, "elem_id")]
    told = tokens.withColumn("__told", F.lit(None).cast(verdicts.select(F.struct(*columns).alias("v")).schema["v"].dataType)).unionByName(
        verdicts.select(key, "elem_id", *blank, F.struct(*columns).alias("__told"))).repartition(key)
    element = Window.partitionBy(key, "elem_id")
    own = F.when(F.col("elem_id").isNotNull(), F.max("__told").over(element))
    joined = told.withColumns({"__told": own, **(marks or {})}).filter("kind IS NOT NULL").select(*tokens.columns, *(marks or {}), "__told.*")
    classes = F.concat_ws(" ", F.col("attrs")["class"], F.lit("external"))
    attrs = F.transform_values("attrs", lambda k, v: F.when(k == "href", F.coalesce("__href", v)).when((k == "class") & F.col("__mark"), classes).otherwise(v))
    attrs = F.when(F.col("__mark") & F.col("attrs")["class"].isNull(), F.map_concat(attrs, F.create_map(F.lit("class"), F.lit("external")))).otherwise(attrs)
    changed = (F.col("kind") == "start") & F.col("__action").isin("wiki", "external", "geo", "media", "keep")
    kept = joined.filter("`__action` IS NULL OR `__action` <> 'unwrap'").withColumn("attrs", F.when(changed, attrs).otherwise(F.col("attrs"))).drop("__href", "__mark")
    return drop_subtrees(kept, F.coalesce(F.col("__action") == "delete", F.lit(False)), key, helpers=("__action",))


def fan_in(links: DataFrame, known: DataFrame) -> DataFrame:
    """Targets by number of links and of linking pages. Counted first, so the join sees each title once."""
    counted = links.groupBy("title", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("title").agg(
        F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages"))
    return lookup(counted, known, ["title"]).select(
        "title", "links", "pages", F.coalesce("state", F.lit("unwrap")).alias("state"))


def breadcrumbs(pages: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Parents of every subpage, outermost first: key, level, parent, label, href (null unless catalogued)."""
    parts = F.split("title", "/")
    rows = pages.filter(F.size(parts) > 1).select(
        key, "title", F.explode(F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.struct(i.cast("long").alias("level"), F.array_join(F.slice(parts, 1, i), "/").alias("parent"), F.get(parts, i - 1).alias("label")),
        )).alias("p"),
    ).select(key, F.col("title").alias("page_title"), "p.*")
    known = catalogue.select(F.col("title").alias("parent"), F.lit(True).alias("found")).distinct()
    return lookup(rows, known, ["parent"]).select(
        key, "level", "parent", F.replace("label", F.lit("_"), F.lit(" ")).alias("label"),
        F.when(F.col("found"), relative_href(title_path("page_title"), link_href("parent"))).alias("href"))
