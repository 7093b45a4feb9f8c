"""Style and module queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.operators import dependencies as ops
from corpusweave.plans.keyed import missing_from
from corpusweave.queries import Family
from corpusweave.session import small_table
from corpusweave.sources import views

QUERIES = Family()
HOST = "https://css.example.org/css/"


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _sheets(spark, sf_dir):
    """One sheet per supplier, importing two others and, back up the tree, its parent; the last ones import missing sheets."""
    k = F.col("s_suppkey")
    body = _cat('@import url("', k * 2 + 1, ".css\") screen;\n@IMPORT '", k * 2 + 2, ".css' supports(display: grid) print and (x);\n@import url(",
                F.when(k > 2, F.floor((k - 1) / 2).cast("long")).otherwise(-1), ".css);\n.a{background:url(img/", k, '.png)} .b{background:url("data:image/png;base64,x")} .c{src:url(\'../f/n',
                F.col("s_nationkey"), "(1.woff')} .d{background:URL()}\n.a.png{background:url(a.png)} .e{background:url('img/a.png')} .f{background:url(\"a.png\")}")
    return views.table(spark, sf_dir, "supplier").select("s_suppkey", _cat(HOST, k, ".css").alias("url"), body.alias("body"))


@QUERIES.add("""
SELECT 'https://css.example.org/css/' || s_suppkey || '.css' AS sheet, CAST(u.pos AS BIGINT) AS pos, u.url AS full_url, u.path AS path, '../' || replace(u.path, '(', '%28') AS replacement
FROM (SELECT s_suppkey, unnest([
  {'pos': 0, 'url': 'https://css.example.org/css/img/' || s_suppkey || '.png', 'path': '_assets_/' || md5('https://css.example.org/css/img/') || '/' || s_suppkey || '.png'},
  {'pos': 2, 'url': 'https://css.example.org/f/n' || s_nationkey || '(1.woff', 'path': '_assets_/' || md5('https://css.example.org/f/') || '/n' || s_nationkey || '(1.woff'},
  {'pos': 4, 'url': 'https://css.example.org/css/a.png', 'path': '_assets_/' || md5('https://css.example.org/css/') || '/a.png'},
  {'pos': 5, 'url': 'https://css.example.org/css/img/a.png', 'path': '_assets_/' || md5('https://css.example.org/css/img/') || '/a.png'},
  {'pos': 6, 'url': 'https://css.example.org/css/a.png', 'path': '_assets_/' || md5('https://css.example.org/css/') || '/a.png'}]) AS u FROM supplier)""")
def css_urls(spark, sf_dir):
    return ops.css_urls(_sheets(spark, sf_dir))


_EDGES_SQL = """
WITH RECURSIVE e AS (
  SELECT s_suppkey AS s, 0 AS pos, s_suppkey * 2 + 1 AS d, '' AS supports, 'screen' AS media FROM supplier
  UNION ALL SELECT s_suppkey, 1, s_suppkey * 2 + 2, 'display: grid', 'print and (x)' FROM supplier
    UNION ALL SELECT s_suppkey, 2, CASE WHEN s_suppkey > 2 THEN CAST(floor((s_suppkey - 1) / 2) AS BIGINT) ELSE -1 END, '', '' FROM supplier)"""


@QUERIES.add(_EDGES_SQL + """
SELECT 'https://css.example.org/css/' || s || '.css' AS src, CAST(pos AS BIGINT) AS pos, 'https://css.example.org/css/' || d || '.css' AS dst, supports, media FROM e""")
def css_imports(spark, sf_dir):
    return ops.css_imports(_sheets(spark, sf_dir))


# between any two sheets of this tree there is one simple path, so the paths can be listed
@QUERIES.add(_EDGES_SQL + """
, w AS (SELECT s_suppkey AS root, s_suppkey AS node, [s_suppkey] AS path, CAST([] AS INTEGER[]) AS place FROM supplier WHERE s_suppkey NOT IN (SELECT d FROM e)
  UNION ALL SELECT root, d, list_append(path, d), list_append(place, pos) FROM w JOIN e ON s = node WHERE d IN (SELECT s_suppkey FROM supplier) AND NOT list_contains(path, d))
SELECT 'https://css.example.org/css/' || root || '.css' AS root, 'https://css.example.org/css/' || node || '.css' AS sheet, row_number() OVER (PARTITION BY root ORDER BY place) AS position FROM w""")
def css_flatten(spark, sf_dir):
    sheets = _sheets(spark, sf_dir)
    imports = ops.css_imports(sheets)
    roots = missing_from(sheets.select("url"), imports.select(F.col("dst").alias("url")), ["url"])
    return ops.css_flatten_order(roots.select(F.col("url").alias("root")), imports, sheets)


_NAME = "'https://css.example.org/css/' || {} || '.css'"


@QUERIES.add(_EDGES_SQL + f"""
, w AS (SELECT s_suppkey AS root, s_suppkey AS node, [s_suppkey] AS path, CAST([] AS INTEGER[]) AS place FROM supplier WHERE s_suppkey NOT IN (SELECT d FROM e)
  UNION ALL SELECT root, d, list_append(path, d), list_append(place, pos) FROM w JOIN e ON s = node WHERE d IN (SELECT s_suppkey FROM supplier) AND NOT list_contains(path, d)),
q AS (SELECT root, node, list_transform(place, lambda p: 2 * p + 1) AS base, place[-1] AS via, s_nationkey AS nk FROM w JOIN supplier ON s_suppkey = node),
p AS (SELECT root, list_append(base, -1) AS key, chr(10) || '/* start ' || {_NAME.format("node")} || ' */' || chr(10) || chr(10)
    || CASE via WHEN 0 THEN '@media screen {{' || chr(10) WHEN 1 THEN '@media print and (x) {{' || chr(10) || '@supports (display: grid) {{' || chr(10) ELSE '' END AS text FROM q
  UNION ALL SELECT root, list_append(base, u), chr(10) FROM q, (VALUES (2), (4)) x(u)
  UNION ALL SELECT root, list_append(base, 6), chr(10) || '.a{{background:url(../_assets_/' || md5('https://css.example.org/css/img/') || '/' || node || '.png)}} .b{{background:url("data:image/png;base64,x")}} .c{{src:url(''../_assets_/'
    || md5('https://css.example.org/f/') || '/n' || nk || '%281.woff'')}} .d{{background:URL()}}' || chr(10)
    || '.a.png{{background:url(../_assets_/' || md5('https://css.example.org/css/') || '/a.png)}} .e{{background:url(''../_assets_/' || md5('https://css.example.org/css/img/') || '/a.png'')}} .f{{background:url("../_assets_/'
    || md5('https://css.example.org/css/') || '/a.png")}}' FROM q
  UNION ALL SELECT root, list_append(base, 1000), repeat(chr(10) || '}}' || chr(10), CASE via WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) || chr(10) || '/* end   ' || {_NAME.format("node")} || ' */' || chr(10) FROM q)
SELECT {_NAME.format("root")} AS root, md5(string_agg(text, '' ORDER BY key)) AS text_md5, CAST(sum(length(text)) AS BIGINT) AS chars FROM p GROUP BY p.root""")
def css_text(spark, sf_dir):
    sheets = _sheets(spark, sf_dir)
    imports = ops.css_imports(sheets)
    roots = missing_from(sheets.select("url"), imports.select(F.col("dst").alias("url")), ["url"])
    flat = ops.css_flatten_text(roots.select(F.col("url").alias("root")), imports, sheets)
    return flat.select("root", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.char_length("text").cast("long").alias("chars"))


def _pages(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    return views.table(spark, sf_dir, "part").select(
        key.alias("page"), F.array(_cat("mod.", size), F.lit("user.options"), F.when(size % 2 == 0, F.lit("ext.tmh.player")).otherwise(F.lit("jquery"))).alias("modules"),
        F.array(_cat("style.", size), _cat("mod.", size % 10), F.lit("user.styles")).alias("modulestyles"),
        F.when(size % 7 == 0, F.lit("<table class=sortable>")).when(size % 7 == 1, F.lit("mw-collapsible")).otherwise(F.lit("-")).alias("text"))


_MODULES_SQL = """
WITH RECURSIVE x AS (
  SELECT p_partkey AS page, p_size AS z FROM part),
m AS (SELECT page, 'css' AS kind, unnest(['site.styles', 'noscript', 'style.' || z, 'mod.' || (z % 10)]) AS module FROM x
  UNION SELECT page, 'css', CASE z % 7 WHEN 0 THEN 'jquery.tablesorter.styles' ELSE 'jquery.makeCollapsible.styles' END FROM x WHERE z % 7 < 2
  UNION SELECT page, 'js', CASE z % 7 WHEN 0 THEN 'jquery.tablesorter' ELSE 'jquery.makeCollapsible' END FROM x WHERE z % 7 < 2
  UNION SELECT page, 'js', unnest(['jquery', 'mediawiki.base', 'mod.' || z]) FROM x
  UNION SELECT page, 'js', 'ext.tmh.player' FROM x WHERE z % 2 = 0)"""


@QUERIES.add(_MODULES_SQL + " SELECT page, kind, module FROM m")
def module_edges(spark, sf_dir):
    return ops.module_edges(_pages(spark, sf_dir), "page")


@QUERIES.add(_MODULES_SQL + """ SELECT page, kind, module FROM m WHERE kind = 'css' OR module IN ('jquery', 'mediawiki.base', 'jquery.tablesorter', 'jquery.makeCollapsible', 'ext.tmh.player', 'mod.3')""")
def module_trusted(spark, sf_dir):
    return ops.trusted_scripts(ops.module_edges(_pages(spark, sf_dir), "page"), "trusted", ["mod.3"])


@QUERIES.add(_MODULES_SQL + " SELECT DISTINCT kind, module FROM m")
def module_union(spark, sf_dir):
    return ops.module_set(ops.module_edges(_pages(spark, sf_dir), "page"))


@QUERIES.add("""
WITH RECURSIVE reg AS (SELECT 'm' || p_partkey AS module FROM part UNION SELECT unnest(['ext.tmh.player', 'ext.tmh.player.inline'])),
e AS (SELECT 'm' || p_partkey AS src, 'm' || (p_partkey // 2) AS dst FROM part UNION ALL SELECT 'm' || p_partkey, 'm' || (p_partkey // 3) FROM part
  UNION ALL SELECT 'm' || p_partkey, 'ghost' || p_size FROM part UNION ALL SELECT 'm0', 'm1' UNION ALL SELECT 'ext.tmh.player.inline', 'm5'),
c AS (SELECT module FROM (SELECT 'm' || p_partkey AS module FROM part WHERE p_size = 49 UNION SELECT unnest(['ext.tmh.player', 'ext.tmh.player.inline'])) s
  UNION SELECT dst FROM e JOIN c ON src = c.module)
SELECT module FROM c WHERE module IN (SELECT module FROM reg)""")
def module_closure(spark, sf_dir):
    key, part = F.col("p_partkey"), views.table(spark, sf_dir, "part")
    module = _cat("m", key).alias("module")
    players = small_table(spark, ["module"], [("ext.tmh.player",), ("ext.tmh.player.inline",)])
    registry = part.select(module).unionByName(players)
    edges = part.select(_cat("m", key).alias("src"), F.explode(F.array(_cat("m", F.floor(key / 2)), _cat("m", F.floor(key / 3)), _cat("ghost", F.col("p_size")))).alias("dst"))
    edges = edges.unionByName(small_table(spark, ["src", "dst"], [("m0", "m1"), ("ext.tmh.player.inline", "m5")]))
    used = part.filter("p_size = 49").select(module).unionByName(small_table(spark, ["module"], [("ext.tmh.player",), ("unknown.module",)]))
    return ops.module_closure(used, edges, registry)


@QUERIES.add(_MODULES_SQL + " SELECT DISTINCT module FROM m WHERE kind = 'js' AND module NOT IN (SELECT module FROM m WHERE kind = 'css' AND module <> 'mod.3')")
def module_minus_css(spark, sf_dir):
    every = ops.module_set(ops.module_edges(_pages(spark, sf_dir), "page"))
    scripts, styles = (every.filter(F.col("kind") == kind).select("module") for kind in ("js", "css"))
    return ops.scripts_without_styles(scripts, styles, added=["mod.3"])


GADGETS = [
    {"id": "peers", "peers": ["peer.a", "peer.b"], "scripts": ["x.js"], "namespaces": [0, 2]},
    {"id": "script", "scripts": ["x.js"], "contentModels": ["wikitext", "src3"]},
    {"id": "deps", "dependencies": ["y"], "categories": ["fr", "de"]},
    {"id": "style", "styles": ["z.css"], "skins": ["vector"]},
    {"id": "other.skin", "styles": ["z.css"], "skins": ["minerva"]},
    {"id": "edit", "scripts": ["e.js"], "actions": ["edit"]},
    {"id": "nothing"},
]


@QUERIES.add("""
WITH d AS (SELECT doc_id, doc_id % 4 AS ns, CASE WHEN source <> 'src0' THEN source ELSE 'wikitext' END AS model, lang FROM documents)
SELECT doc_id, 'css' AS kind, unnest(['ext.gadget.peer.a', 'ext.gadget.peer.b']) AS module FROM d WHERE ns IN (0, 2)
UNION ALL SELECT doc_id, 'js', 'ext.gadget.peers' FROM d WHERE ns IN (0, 2)
UNION ALL SELECT doc_id, 'js', 'ext.gadget.script' FROM d WHERE model IN ('wikitext', 'src3')
UNION ALL SELECT doc_id, 'js', 'ext.gadget.deps' FROM d WHERE lang IN ('fr', 'de')
UNION ALL SELECT doc_id, 'css', 'ext.gadget.style' FROM d""")
def gadget_match(spark, sf_dir):
    pages = views.documents(spark, sf_dir).select(
        "doc_id", F.when(F.col("ns") != 0, F.col("ns")).alias("ns"), F.when(F.col("contentmodel") != "src0", F.col("contentmodel")).alias("contentmodel"), F.array("lang").alias("categories"))
    return ops.active_gadgets(pages, GADGETS, "doc_id", skin="vector")


@QUERIES.add("""
WITH m AS (SELECT c_nationkey || '/' || c_mktsegment AS category, count(*) AS size, count(*) FILTER (c_acctbal >= 5000) AS files, min(c_nationkey) % 2 = 0 AS nogallery FROM customer GROUP BY 1)
SELECT category, 'css' AS kind, 'mediawiki.action.styles' AS module FROM m
UNION ALL SELECT category, 'css', 'mediawiki.page.gallery.styles' FROM m WHERE files > 0 AND NOT nogallery""")
def category_styles(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer").groupBy(F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("category")).agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("c_acctbal") >= 5000).alias("files"), (F.min("c_nationkey") % 2 == 0).alias("nogallery"))
    return ops.category_styles(customers, "category")


@QUERIES.add("SELECT p_partkey AS page, p_size % 3 = 0 OR p_size % 5 = 0 AS math FROM part")
def math_flag(spark, sf_dir):
    size = F.col("p_size")
    modules = F.array_compact(F.array(F.lit("jquery"), F.when(size % 3 == 0, F.lit("ext.math.MathJax")), F.when(size % 5 == 0, F.lit("ext.mathjax.loader")), F.lit("ext.math.styles")))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), ops.needs_math(modules).alias("math"))
