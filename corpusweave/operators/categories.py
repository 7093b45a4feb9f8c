"""Category graph and category listings.

A category may hold any share of all pages, so listings are paged by ranks from ``rank_in_group``; windows
are only used inside one listing page, whose length is the page size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave.constants import GALLERY_COLUMNS_ABOVE, LISTING_PAGE_SIZE, PARTIALS_DIR
from corpusweave.functions.text import relative_href, title_path
from corpusweave.plans.closure import reach
from corpusweave.plans.keyed import lookup, members_of
from corpusweave.plans.ranks import rank_in_group

# fixed values: listing names of the member types
LISTING_OF_TYPE = {"subcat": "subcats", "page": "pages", "file": "files"}


def visible_categories(pages: DataFrame) -> DataFrame:
    """Distinct category titles of the given pages, hidden ones left out."""
    return pages.select(F.inline("categories")).filter(~F.coalesce("hidden", F.lit(False))).select("title").distinct()


def category_closure(categories: DataFrame, parents: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """All categories above the given ones. ``parents``: src, dst. Ignored categories are cut in every round."""
    return reach(categories.select("title"), parents, "title", ignored)


def with_sort_prefix(members: DataFrame) -> DataFrame:
    """Adds ``prefix``: first character of the sort key; outside the main space the title counts without its prefix."""
    bare = F.regexp_extract("title", r"^[^:]*:?(.*)$", 1)
    name = F.when((F.col("ns") != 0) & (bare != ""), bare).otherwise(F.col("title"))
    return members.withColumn("prefix", F.substring(F.concat(F.coalesce("sortkeyprefix", F.lit("")), name), 1, 1))


def restrict_members(members: DataFrame, catalogue: DataFrame) -> DataFrame:
    return members_of(members, catalogue, ["title"])


def member_counts(members: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("type") == t).alias(name) for t, name in LISTING_OF_TYPE.items()]
    return members.groupBy("category").agg(*counts)


def paged_members(members: DataFrame, order: list[str], page_size: int = LISTING_PAGE_SIZE) -> DataFrame:
    """Adds rank, page and is_last per (category, type)."""
    ranked = rank_in_group(members, ["category", "type"], order, rank="rank", total="__members")
    page = F.floor((F.col("rank") - 1) / page_size) + 1
    last = F.floor((F.col("__members") - 1) / page_size) + 1
    return ranked.withColumn("page", page.cast("long")).withColumn("is_last", F.col("page") == last).drop("__members")


def is_numeric_collation(collation: str) -> bool:
    return collation == "numeric" or (collation.startswith("uca-") and collation.endswith("-u-kn"))


def letter_groups(paged: DataFrame, numeric: bool = False, digits_header: str = "0-9") -> DataFrame:
    """Runs of one header inside a listing page: category, type, page, group, header, first_rank, members."""
    header = F.when(F.lit(numeric) & F.col("prefix").rlike("^[0-9]"), F.lit(digits_header)).otherwise(F.col("prefix"))
    within = Window.partitionBy("category", "type", "page").orderBy("rank")
    marked = paged.withColumn("header", header)
    starts = (~F.col("header").eqNullSafe(F.lag("header").over(within)) | F.lag("rank").over(within).isNull()).cast("int")
    grouped = marked.withColumn("__start", starts).withColumn("group", F.sum("__start").over(within).cast("long"))
    return grouped.groupBy("category", "type", "page", "group").agg(
        F.min("header").alias("header"), F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("members"))


def listing_partials(members: DataFrame, page_size: int = LISTING_PAGE_SIZE) -> DataFrame:
    """One row per listing page: whether it is inline, its own entry path, links to its neighbours, its layout.

    Paging follows from the member counts, so no member is ranked for it.
    """
    counts = members.groupBy("category", "type").agg(F.count(F.lit(1)).alias("members"))
    last = F.floor((F.col("members") - 1) / page_size) + 1
    rows = counts.withColumn("last", last).withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))))
    listing = F.coalesce(*[F.when(F.col("type") == t, F.lit(n)) for t, n in LISTING_OF_TYPE.items()])
    base = F.concat(F.lit(PARTIALS_DIR), title_path("category"), F.lit("_"), listing)
    many = F.col("last") > 1

    def link(page):
        return F.concat(relative_href(title_path("category"), base), F.lit("_"), page)

    return rows.select(
        "category", "type", "page", (F.col("page") == 1).alias("is_inline"),
        F.when(many, F.concat(base, F.lit("_"), F.col("page"))).alias("path"),
        F.when(many & (F.col("page") > 1), link(F.col("page") - 1)).alias("previous"),
        F.when(many & (F.col("page") < F.col("last")), link(F.col("page") + 1)).alias("next"),
        (F.least(F.lit(page_size).cast("long"), F.col("members") - (F.col("page") - 1) * page_size) > GALLERY_COLUMNS_ABOVE).alias("columns"),
    )


def page_category_lists(pages: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """The categories of each page that have a page themselves, in page order; pages left without one are dropped.

    The list is rebuilt from one page's own array, so its length is that of the input row.
    """
    rows = pages.select(key, F.posexplode("categories").alias("pos", "title"))
    return members_of(rows, catalogue, ["title"]).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("categories"))


def listing_flags(categories: DataFrame, counts: DataFrame, restricted: bool) -> DataFrame:
    """Notes and layout per category. ``categories``: category, nogallery; ``counts`` as from ``member_counts``."""
    joined = lookup(categories, counts, ["category"])
    subcats, pages, files = (F.coalesce(c, F.lit(0).cast("long")) for c in ("subcats", "pages", "files"))
    size = subcats + pages + files
    return joined.select(
        "category", size.alias("size"), (size == 0).alias("empty_note"), ((size > 0) & F.lit(restricted)).alias("limited_note"),
        ((files > 0) & ~F.col("nogallery")).alias("gallery"), (pages > GALLERY_COLUMNS_ABOVE).alias("page_columns"),
    )
