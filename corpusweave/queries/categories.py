"""Category queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.operators import categories as ops
from corpusweave.queries import Family
from corpusweave.sources import views
from corpusweave.sources.views import with_views

QUERIES = Family()
PAGE_SIZE = 20


@QUERIES.add("SELECT DISTINCT p_type AS title FROM part WHERE p_size % 10 <> 0 UNION SELECT DISTINCT p_brand FROM part")
def visible_categories(spark, sf_dir):
    part = views.parts(spark, sf_dir)
    cats = F.array(F.struct(F.col("category").alias("title"), (F.col("size") % 10 == 0).alias("hidden")),
                   F.struct(F.col("parent").alias("title"), F.lit(None).cast("boolean").alias("hidden")))
    return ops.visible_categories(part.select(cats.alias("categories")))


@QUERIES.add(with_views("tree", recursive=True, body="""
c AS (SELECT 'C' || c_custkey AS title FROM customer WHERE c_acctbal < 0
  UNION SELECT dst FROM v_tree JOIN c ON src = c.title WHERE dst <> 'R3')
SELECT title FROM c"""))
def category_closure(spark, sf_dir):
    seeds = views.table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("C"), "c_custkey").alias("title"))
    ignored = views.table(spark, sf_dir, "region").filter("r_regionkey = 3").select(F.concat(F.lit("R"), "r_regionkey").alias("title"))
    return ops.category_closure(seeds, views.category_tree(spark, sf_dir), ignored).select("title")


def _members(spark, sf_dir):
    ns = F.when(F.col("type") == "subcat", 14).when(F.col("type") == "file", 6).otherwise(0)
    title = F.when(ns == 14, F.concat(F.lit("Category:"), "title")).when(ns == 6, F.concat(F.lit("File:"), "title")).otherwise(F.col("title"))
    key = F.when(F.col("size") % 4 == 0, F.lit("")).when(F.col("size") % 4 == 1, (F.col("size") % 10).cast("string")).otherwise(F.col("sortkeyprefix"))
    return ops.with_sort_prefix(views.parts(spark, sf_dir).select(
        "category", "member", "type", "size", ns.alias("ns"), title.alias("title"), key.alias("sortkeyprefix")))


_MEMBERS_SQL = """
m0 AS (SELECT category, member, type, size, title AS bare,
  CASE type WHEN 'subcat' THEN 'Category:' || title WHEN 'file' THEN 'File:' || title ELSE title END AS title,
  CASE WHEN size % 4 = 0 THEN '' WHEN size % 4 = 1 THEN CAST(size % 10 AS VARCHAR) ELSE sortkeyprefix END AS key FROM v_parts),
m AS (SELECT *, substr(key || bare, 1, 1) AS prefix FROM m0),
r AS (SELECT *, row_number() OVER (PARTITION BY category, type ORDER BY prefix, member) AS rank, count(*) OVER (PARTITION BY category, type) AS n FROM m),
p AS (SELECT *, (rank - 1) // 20 + 1 AS page, (n - 1) // 20 + 1 AS last FROM r)"""


@QUERIES.add(with_views("parts", body=_MEMBERS_SQL + " SELECT member, title, prefix FROM m"))
def member_prefix(spark, sf_dir):
    return _members(spark, sf_dir).select("member", "title", "prefix")


@QUERIES.add(with_views("parts", body="SELECT category, title FROM v_parts WHERE member IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) % 2 = 0)"))
def member_restrict(spark, sf_dir):
    used = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("member")).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0")
    catalogue = views.parts(spark, sf_dir).join(used, "member", "left_semi").select("title")
    return ops.restrict_members(views.parts(spark, sf_dir), catalogue).select("category", "title")


@QUERIES.add(with_views("parts", body="""SELECT category, count(*) FILTER (type = 'subcat') AS subcats, count(*) FILTER (type = 'page') AS pages,
  count(*) FILTER (type = 'file') AS files FROM v_parts GROUP BY category"""))
def member_counts(spark, sf_dir):
    return ops.member_counts(views.parts(spark, sf_dir))


def _paged(spark, sf_dir):
    return ops.paged_members(_members(spark, sf_dir), ["prefix", "member"], PAGE_SIZE)


@QUERIES.add(with_views("parts", body=_MEMBERS_SQL + " SELECT category, type, member, rank, page, page = last AS is_last FROM p"))
def member_pages(spark, sf_dir):
    return _paged(spark, sf_dir).select("category", "type", "member", "rank", "page", "is_last")


@QUERIES.add(with_views("parts", body=_MEMBERS_SQL + """
, h AS (SELECT *, CASE WHEN regexp_matches(prefix, '^[0-9]') THEN '0-9' ELSE prefix END AS header FROM p),
s AS (SELECT *, CASE WHEN lag(header) OVER w IS DISTINCT FROM header THEN 1 ELSE 0 END AS st FROM h WINDOW w AS (PARTITION BY category, type, page ORDER BY rank)),
g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY category, type, page ORDER BY rank) AS BIGINT) AS grp FROM s)
SELECT category, type, page, grp AS "group", min(header) AS header, min(rank) AS first_rank, count(*) AS members FROM g GROUP BY category, type, page, grp"""))
def member_groups(spark, sf_dir):
    return ops.letter_groups(_paged(spark, sf_dir), numeric=ops.is_numeric_collation("uca-default-u-kn"))


@QUERIES.add(with_views("parts", body=_MEMBERS_SQL + """
, q AS (SELECT DISTINCT category, type, page, last, n, '_categories_partials_' || category || '_' || CASE type WHEN 'subcat' THEN 'subcats' WHEN 'page' THEN 'pages' ELSE 'files' END AS base FROM p)
SELECT category, type, page, page = 1 AS is_inline, CASE WHEN last > 1 THEN base || '_' || page END AS path,
  CASE WHEN last > 1 AND page > 1 THEN './' || base || '_' || (page - 1) END AS previous,
  CASE WHEN last > 1 AND page < last THEN './' || base || '_' || (page + 1) END AS next, least(20, n - (page - 1) * 20) > 6 AS columns FROM q"""))
def member_partials(spark, sf_dir):
    return ops.listing_partials(views.parts(spark, sf_dir), PAGE_SIZE)


@QUERIES.add("""
WITH known AS (SELECT p_type AS t FROM part WHERE p_type < 'P' UNION SELECT p_brand FROM part WHERE p_brand LIKE 'Brand#1%'),
x AS (SELECT p_partkey AS member, p_type IN (SELECT t FROM known) AS a, p_brand IN (SELECT t FROM known) AS b, p_type, p_brand FROM part)
SELECT member, CASE WHEN a AND b THEN p_type || '|' || p_brand WHEN a THEN p_type ELSE p_brand END AS categories FROM x WHERE a OR b""")
def page_category_list(spark, sf_dir):
    part = views.parts(spark, sf_dir)
    known = part.filter("category < 'P'").select(F.col("category").alias("title")).unionByName(
        part.filter("parent LIKE 'Brand#1%'").select(F.col("parent").alias("title")))
    lists = ops.page_category_lists(part.select("member", F.array("category", "parent").alias("categories")), known, "member")
    return lists.select("member", F.array_join("categories", "|").alias("categories"))


@QUERIES.add("""
WITH m AS (SELECT c_nationkey || '/' || c_mktsegment AS category, count(*) FILTER (c_acctbal < 0) AS s, count(*) FILTER (c_acctbal >= 5000) AS f,
             count(*) FILTER (c_acctbal >= 0 AND c_acctbal < 5000) AS p FROM customer GROUP BY c_nationkey, c_mktsegment),
g AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE']) AS segment),
n AS (SELECT n_nationkey || '/' || segment AS category, n_nationkey % 2 = 0 AS nogallery FROM nation, g),
c AS (SELECT category, nogallery, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(f, 0) AS f FROM n LEFT JOIN m USING (category))
SELECT category, s + p + f AS size, s + p + f = 0 AS empty_note, s + p + f > 0 AS limited_note, f > 0 AND NOT nogallery AS gallery, p > 6 AS page_columns FROM c""")
def category_flags(spark, sf_dir):
    """One category per nation and market segment; no customer is in the segment NONE, so those are empty."""
    kind = F.when(F.col("c_acctbal") < 0, F.lit("subcat")).when(F.col("c_acctbal") >= 5000, F.lit("file")).otherwise(F.lit("page"))
    customers = views.table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("category"), kind.alias("type"))
    segments = F.explode(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"))))
    nations = views.table(spark, sf_dir, "nation").select("n_nationkey", segments.alias("segment"))
    cats = nations.select(F.concat_ws("/", "n_nationkey", "segment").alias("category"), (F.col("n_nationkey") % 2 == 0).alias("nogallery"))
    return ops.listing_flags(cats, ops.member_counts(customers), restricted=True)
