"""Output queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.operators import categories as category_ops
from corpusweave.operators import outputs as ops
from corpusweave.operators import redirects as redirect_ops
from corpusweave.queries import Family
from corpusweave.session import new_table_path, small_table
from corpusweave.sources import views
from corpusweave.sources.views import with_views

QUERIES = Family()


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _manifest(spark, sf_dir):
    pages = views.pages(spark, sf_dir).select(
        _cat("Page ", F.col("page_id")).alias("title"), F.when(F.col("page_id") % 2 == 0, F.col("heading")).alias("display_title"), "html")
    copies = views.text_copies(spark, sf_dir)
    redirects = redirect_ops.routed(redirect_ops.admitted(views.redirect_refs(copies), copies.filter("doc_id = first_id")))
    uses = views.asset_uses(spark, sf_dir).groupBy("image").agg(F.max("quantity").alias("bytes"))
    assets = uses.select(_cat("_assets_/P", F.col("image"), ".png").alias("path"), F.lit("image/png").alias("mime"), "bytes")
    modules = views.table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 2 == 0, "js").otherwise("css").alias("kind"), _cat("m", F.col("p_size")).alias("module"),
        F.repeat(F.lit("é;"), F.col("p_size")).alias("text")).distinct()
    partials = category_ops.listing_partials(views.parts(spark, sf_dir), 20).withColumn("html", _cat("<p>", F.col("path"), "</p>"))
    k = F.col("s_suppkey")
    failures = views.table(spark, sf_dir, "supplier").select(F.when(k % 3 != 0, _cat("Lost_", k)).alias("entry_path"), F.lit("<p>gone</p>").alias("html"))
    metadata = views.table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), _cat("Region ", F.col("r_name")).alias("value"))
    return ops.manifest(ops.page_entries(pages), ops.redirect_entries(redirects), ops.asset_entries(assets), ops.module_entries(modules),
                        ops.partial_entries(partials), ops.placeholder_entries(failures), ops.metadata_entries(metadata))


_MANIFEST_SQL = """
mf AS (SELECT 'page' AS kind, 'Page_' || page_id AS path, CASE WHEN page_id % 2 = 0 AND heading <> '' THEN heading ELSE 'Page ' || page_id END AS title, 'text/html' AS mime, TRUE AS front, CAST(strlen(html) AS BIGINT) AS bytes FROM v_pages
  UNION ALL SELECT CASE WHEN fragment <> '' THEN 'stub' ELSE 'redirect' END, replace(from_title, ' ', '_'), from_title, CASE WHEN fragment <> '' THEN 'text/html' END, TRUE,
    CASE WHEN fragment <> '' THEN strlen('<html><head><title>' || from_title || '</title><meta http-equiv="refresh" content="0;URL=''./'
      || replace(to_title, ' ', '_') || '#' || replace(fragment, ' ', '_') || chr(39) || '"></head><body></body></html>') ELSE 0 END FROM v_refs
  UNION ALL SELECT 'asset', '_assets_/P' || l_partkey || '.png', '', 'image/png', FALSE, max(CAST(l_quantity AS BIGINT)) FROM lineitem GROUP BY l_partkey
  UNION ALL SELECT DISTINCT 'module', '_mw_/m' || p_size || CASE WHEN p_size % 2 = 0 THEN '.js' ELSE '.css' END, '', CASE WHEN p_size % 2 = 0 THEN 'text/javascript' ELSE 'text/css' END, FALSE, 3 * p_size FROM part
  UNION ALL SELECT 'partial', '_categories_partials_' || category || '_' || CASE type WHEN 'subcat' THEN 'subcats' WHEN 'page' THEN 'pages' ELSE 'files' END || '_' || n AS path, '', 'text/html', FALSE, strlen(path) + 7
    FROM (SELECT category, type, unnest(range(1, (count(*) - 1) // 20 + 2)) AS n, (count(*) - 1) // 20 + 1 AS last FROM v_parts GROUP BY category, type) WHERE last > 1
  UNION ALL SELECT 'placeholder', 'Lost_' || s_suppkey, '', 'text/html', FALSE, 11 FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT 'metadata', r_name, '', 'text/plain', FALSE, strlen(r_name) + 7 FROM region)"""


@QUERIES.add(with_views("pages", "docs", "parts", body=_MANIFEST_SQL + " SELECT kind, path, title, mime, front, bytes FROM mf"))
def entry_manifest(spark, sf_dir):
    path = new_table_path(spark, "manifest")
    ops.write_manifest(_manifest(spark, sf_dir), path)
    return spark.read.parquet(path).select(*ops.ENTRY_COLUMNS)


@QUERIES.add(with_views("pages", "docs", "parts", body=_MANIFEST_SQL + """
SELECT kind, CASE WHEN kind IS NOT NULL OR g < 2 THEN mime END AS mime, entries, bytes FROM (
  SELECT kind, coalesce(mime, 'none') AS mime, grouping(kind, coalesce(mime, 'none')) AS g, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM mf GROUP BY ROLLUP (kind, coalesce(mime, 'none')))"""))
def entry_stats(spark, sf_dir):
    return ops.entry_stats(_manifest(spark, sf_dir))


@QUERIES.add(with_views("pages", body="""
SELECT 'index' AS kind, 'home' AS path, CAST(1 AS BIGINT) AS entries
UNION ALL SELECT 'collision', title, count(*) FROM (SELECT CASE page_id WHEN 0 THEN 'index' WHEN 1 THEN 'x' ELSE title END AS title FROM v_pages) GROUP BY title HAVING count(*) > 1"""))
def index_path(spark, sf_dir):
    pages = views.pages(spark, sf_dir).select("page_id", F.when(F.col("page_id") == 0, F.lit("index")).when(F.col("page_id") == 1, F.lit("x")).otherwise(F.col("title")).alias("title"))
    redirects = small_table(spark, ["from_title"], [("welcome",)])
    index = ops.index_path(pages, redirects).select(F.lit("index").alias("kind"), F.col("index_path").alias("path"), F.lit(1).cast("long").alias("entries"))
    collisions = ops.path_collisions(pages.select(F.col("title").alias("path")))
    return index.unionByName(collisions.select(F.lit("collision").alias("kind"), "path", "entries"))


@QUERIES.add(with_views("docs", body="""
l AS (SELECT d.doc_id AS pos, coalesce(r.to_title, d.title) AS title FROM v_docs d LEFT JOIN v_refs r ON r.from_title = d.title WHERE d.lang = 'en'),
f AS (SELECT l.pos, l.title, p.doc_id % 3 = 0 AS has_image FROM l JOIN v_docs p ON p.title = l.title AND p.doc_id = p.first_id),
i AS (SELECT *, count(*) FILTER (has_image) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seen FROM f)
SELECT pos, title, has_image, 'tiles' AS layout FROM i WHERE has_image AND seen <= 100"""))
def index_select(spark, sf_dir):
    copies = views.text_copies(spark, sf_dir)
    pages = copies.filter("doc_id = first_id").select("title", (F.col("doc_id") % 3 == 0).alias("has_image"))
    listed = copies.filter("lang = 'en'").select(F.col("doc_id").alias("pos"), "title")
    return ops.index_entries(listed, pages, views.redirect_refs(copies))
