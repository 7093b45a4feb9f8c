"""Link queries. ``link_fanin`` is the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.functions.text import link_href, relative_href
from corpusweave.functions.urls import geo_href, href_title
from corpusweave.operators import links as ops
from corpusweave.queries import Family
from corpusweave.session import new_table_path
from corpusweave.sources import html_tokens, views
from corpusweave.sources.views import with_views
from corpusweave.sources.wiki_html import EXTRAS, wiki_pages, wiki_sql

QUERIES = Family()
SITE = views.SITE


def known(spark, sf_dir):
    titles = views.page_titles(spark, sf_dir)
    return ops.known_titles(titles, titles.select(F.concat("title", F.lit(",")).alias("from_title")))


_KNOWN_SQL = """
kn AS (SELECT title, min(state) AS state FROM (SELECT title, 'page' AS state FROM v_titles UNION ALL SELECT title || ',', 'redirect' FROM v_titles) GROUP BY title)"""


@QUERIES.add(with_views("pages", body="SELECT page_id, pos, '/' || target AS href, 'a' AS tag FROM v_links"))
def link_extract(spark, sf_dir):
    tokens = html_tokens.tokenize(views.table(spark, sf_dir, "pages"))
    return ops.anchors(tokens).select("page_id", "pos", "href", "tag")


_TITLE_SQL = r"""
CASE WHEN href LIKE '/w/index.php%' THEN nullif(replace(regexp_extract(href, '[?&]title=([^&#]*)', 1), '+', ' '), '')
  WHEN href LIKE './%' THEN regexp_extract(href, '^\./([^?#]*)', 1)
  WHEN href LIKE '/wiki/%' THEN regexp_extract(href, '^/wiki/([^?#]*)', 1)
  WHEN href LIKE 'https://wiki.example.org/wiki/%' THEN regexp_extract(href, '^https://wiki.example.org/wiki/([^?#]*)', 1)
  WHEN href LIKE '/archive/%' THEN regexp_extract(href, '^/(archive/[0-9]+)[.]html$', 1)
  WHEN href LIKE '../../%' THEN regexp_replace(regexp_extract(href, '([^/]*)$', 1), '(.)[.][^.]*$', '\1') END"""


@QUERIES.add(with_views("pages", "hrefs", body=f"SELECT page_id, pos, href, replace(url_decode({_TITLE_SQL}), '_', ' ') AS title FROM v_hrefs"))
def href_titles(spark, sf_dir):
    return views.page_hrefs(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "href", href_title("href", SITE).alias("title"))


QUERIES["href_title"] = QUERIES.pop("href_titles")

_ENCODE = """replace(replace(replace(replace(replace(replace(url_encode(replace({t}, ' ', '_')), '%2F', '/'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"""

_CLASSIFY_SQL = with_views("pages", "hrefs", body=f"""
t AS (SELECT *, replace(url_decode({_TITLE_SQL}), '_', ' ') AS wt, rel = 'mw:WikiLink' AS iswiki,
  CASE WHEN href LIKE '//%' THEN 'https:' || href ELSE href END AS u FROM v_hrefs),
g AS (SELECT *, CASE WHEN u LIKE '%geohack.php%' THEN 'geo:' || regexp_replace(CAST(CAST(regexp_extract(u, 'params=([0-9]+)_30', 1) AS DOUBLE) + 0.5 AS VARCHAR), '[.]0$', '')
    || ',' || regexp_replace(CAST(CAST(regexp_extract(u, '_N_([0-9]+)_W', 1) AS DOUBLE) * -1 AS VARCHAR), '[.]0$', '')
  WHEN u LIKE '%Special:Map%' THEN 'geo:' || split_part(u, '/', 5) || ',' || split_part(u, '/', 6) END AS geo FROM t),
a AS (SELECT *, CASE WHEN class = 'mwo-norewrite' THEN 'keep' WHEN class LIKE '%mw-selflink%' AND href = '' THEN 'keep'
  WHEN class = 'new' THEN 'unwrap' WHEN href LIKE 'mailto:%' THEN 'keep' WHEN rel = 'mwo:NoRewrite' THEN 'keep' WHEN u = '' THEN 'delete'
  WHEN u LIKE '#%' THEN 'keep' WHEN geo IS NOT NULL AND NOT iswiki THEN 'geo' WHEN resource IS NOT NULL AND (u LIKE '%.pdf%' OR u LIKE '%.ogg%') THEN 'media'
  WHEN resource IS NOT NULL THEN 'unwrap'
  WHEN class = 'mirror-link' OR u LIKE 'https://wiki.example.org/wiki/%' THEN 'wiki'
  WHEN class = 'external' AND u LIKE './%' THEN 'unwrap' WHEN class = 'extiw' OR rel = 'nofollow' OR u LIKE 'http%' THEN 'external'
  WHEN wt IS NOT NULL THEN 'wiki' ELSE 'external' END AS action FROM g)
SELECT page_id, pos, action, CASE WHEN action = 'wiki' THEN wt END AS title,
  CASE action WHEN 'geo' THEN geo WHEN 'wiki' THEN {_ENCODE.format(t="wt")} || regexp_extract(u, '(#[^#]*)$', 1)
    WHEN 'external' THEN CASE WHEN u LIKE '/%' THEN 'https://wiki.example.org' || u ELSE u END WHEN 'keep' THEN u
    WHEN 'media' THEN CASE WHEN page_path LIKE '%/%' THEN '../' ELSE './' END || '_assets_/' || md5('https://upload.example.org/commons/') || '/'
      || {_ENCODE.format(t="url_decode(regexp_extract(u, '([^/]*)$', 1))").replace("replace(url_decode", "(url_decode").replace("1)), ' ', '_')", "1)))")}
  END AS new_href,
  action = 'external' AND rel <> 'nofollow' AS mark_external FROM a""")


@QUERIES.add(_CLASSIFY_SQL)
def link_classify(spark, sf_dir):
    decided = ops.classify(views.page_hrefs(spark, sf_dir), SITE)
    return decided.select("page_id", F.col("pos").cast("long").alias("pos"), "action", "title", "new_href", "mark_external")


@QUERIES.add("""
WITH c AS (SELECT c_custkey, c_custkey % 90 AS d, c_custkey % 59 AS m, c_custkey % 47 AS s, c_custkey % 179 AS lo FROM customer)
SELECT c_custkey, CASE c_custkey % 5
  WHEN 0 THEN 'geo:' || regexp_replace(CAST((0.0::DOUBLE + d / 1.0::DOUBLE + m / 60.0::DOUBLE + s / 3600.0::DOUBLE) * (CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END) AS VARCHAR), '[.]0$', '') || ',' ||
     regexp_replace(CAST((0.0::DOUBLE + lo / 1.0::DOUBLE + s / 60.0::DOUBLE) * (CASE WHEN s % 2 = 0 THEN 1 ELSE -1 END) AS VARCHAR), '[.]0$', '')
  WHEN 1 THEN 'geo:' || d || '.25;'[1:3] || ',-' || lo || '.75'
  WHEN 2 THEN 'geo:' || d || '.5,' || lo
  WHEN 3 THEN 'geo:' || d || '.125,-' || lo || '.5' END AS geo FROM c""")
def geo_links(spark, sf_dir):
    k = F.col("c_custkey")
    d, m, s, lo = k % 90, k % 59, k % 47, k % 179

    def cat(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    ns, ew = F.when(m % 2 == 0, "_N_").otherwise("_S_"), F.when(s % 2 == 0, "_E_").otherwise("_W_")
    href = (
        F.when(k % 5 == 0, cat("//tools.example.org/geohack/geohack.php?params=", d, "_", m, "_", s, ns, lo, "_", s, ew, "type:city"))
        .when(k % 5 == 1, cat("http://tools.example.org/geohack.php?pagename=x&params=", d, ".25;-", lo, ".75_type:x"))
        .when(k % 5 == 2, cat("http://maps.example.org/w/poimap2.php?lat=", d, ".5&lon=", lo, "&zoom=15"))
        .when(k % 5 == 3, cat("/wiki/Special:Map/9/", d, ".125/-", lo, ".5/en"))
        .otherwise(cat("http://tools.example.org/geohack.php?pagename=", k))
    )
    return views.table(spark, sf_dir, "customer").select("c_custkey", geo_href(href).alias("geo"))


@QUERIES.add(with_views("pages", body=_KNOWN_SQL + """
SELECT page_id, pos, target AS title, coalesce(state, 'unwrap') AS state FROM v_links LEFT JOIN kn ON kn.title = target"""))
def link_resolve(spark, sf_dir):
    links = views.page_links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("target").alias("title"))
    return ops.resolve(links, known(spark, sf_dir)).select("page_id", "pos", "title", "state")


@QUERIES.add(wiki_sql({
    0: EXTRAS[0].replace("./Doc_{k}", "../Doc_{k}"), 6: EXTRAS[6].replace('href="/edit"', 'href="https://wiki.example.org/edit" class="external"')}))
def link_rewrite(spark, sf_dir):
    # the tokens are read for the links and for the rewriting
    path = new_table_path(spark, "tokens")
    html_tokens.tokenize(wiki_pages(spark, sf_dir)).write.parquet(path)
    tokens = spark.read.parquet(path)
    anchors = ops.anchors(tokens).withColumn("page_path", F.concat(F.lit("Doc_"), "page_id", F.lit("/x")))
    linked = views.sections(spark, sf_dir).select(F.concat(F.lit("Doc "), F.col("doc_id") + F.col("section")).alias("title")).distinct()
    known = ops.known_titles(linked, linked.select(F.lower("title").alias("from_title")))
    return html_tokens.serialise(ops.rewrite_links(tokens, ops.classify(anchors, SITE), known)).select("page_id", F.md5("html").alias("html_md5"))


@QUERIES.add(with_views("pages", "hrefs", body="""
SELECT page_id, pos, CASE WHEN page_path LIKE '%/%' THEN '../' ELSE './' END || target AS href,
  repeat('../', CASE WHEN page_path LIKE '%/%' THEN 3 ELSE 2 END) || target AS deep_href
FROM v_hrefs JOIN v_links USING (page_id, pos)"""))
def link_relative(spark, sf_dir):
    links = views.page_links(spark, sf_dir)
    path = F.concat("title", F.when(F.col("page_id") % 3 == 0, F.lit("/sub")).otherwise(F.lit("")))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), relative_href(path, "target").alias("href"),
                        relative_href(F.concat(F.lit("//a///"), path, F.lit("/b")), "target").alias("deep_href"))


@QUERIES.add(with_views("pages", body=f"SELECT page_id, {_ENCODE.format(t='heading')} AS href FROM v_pages"))
def link_encode(spark, sf_dir):
    return views.pages(spark, sf_dir).select("page_id", link_href("heading").alias("href"))


@QUERIES.add(with_views("pages", "hrefs", body="""
SELECT page_id, pos, f.variant, CASE WHEN (k = 15 AND f.variant <> 'nopdf') OR (k = 16 AND f.variant <> 'nopic') THEN 'media' ELSE 'unwrap' END AS action,
  CASE WHEN (k = 15 AND f.variant <> 'nopdf') OR (k = 16 AND f.variant <> 'nopic') THEN 'https://upload.example.org/commons/a/ab/' || target
    || CASE k WHEN 15 THEN '.pdf' ELSE '.ogg' END END AS asset_url
FROM v_hk, (VALUES ('full'), ('nopdf'), ('nopic')) f(variant) WHERE k IN (15, 16, 17)"""))
def link_media(spark, sf_dir):
    links = views.page_hrefs(spark, sf_dir).filter("resource IS NOT NULL")
    variants = F.array(*[F.struct(F.lit(name).alias("variant"), F.lit(name == "nopdf").alias("nopdf"), F.lit(name == "nopic").alias("nopic")) for name in ("full", "nopdf", "nopic")])
    flags = ops.Flags(nopdf=F.col("nopdf"), nopic=F.col("nopic"))
    return ops.classify(links.select("*", F.inline(variants)), SITE, flags).select("page_id", F.col("pos").cast("long").alias("pos"), "variant", "action", "asset_url")


@QUERIES.add(with_views("pages", body=_KNOWN_SQL + """
, c AS (SELECT target AS title, count(*) AS links, count(DISTINCT page_id) AS pages FROM v_links GROUP BY target)
SELECT title, links, pages, coalesce(state, 'unwrap') AS state FROM c LEFT JOIN kn USING (title)"""))
def link_fanin(spark, sf_dir):
    links = views.page_links(spark, sf_dir).select("page_id", F.col("target").alias("title"))
    return ops.fan_in(links, known(spark, sf_dir))


@QUERIES.add(with_views("pages", body=f"""
w AS (SELECT page_id, lang, string_split(heading, ' ') AS arr FROM v_pages),
cat AS (SELECT title FROM v_titles UNION SELECT array_to_string(arr[1:2], '/') FROM w WHERE lang = 'en' AND len(arr) > 1),
b AS (SELECT page_id, arr, unnest(range(1, len(arr))) AS level FROM w WHERE len(arr) > 1),
p AS (SELECT page_id, arr, level, array_to_string(arr[1:level], '/') AS parent, replace(arr[level], '_', ' ') AS label FROM b)
SELECT page_id, level, parent, label, CASE WHEN parent IN (SELECT title FROM cat) THEN repeat('../', len(arr) - 1) || {_ENCODE.format(t='parent')} END AS href FROM p"""))
def breadcrumbs(spark, sf_dir):
    words = F.split("heading", " ")
    pages = views.pages(spark, sf_dir).select("page_id", "lang", F.array_join(words, "/").alias("title"), words.alias("words"))
    catalogue = views.page_titles(spark, sf_dir).select("title").unionByName(
        pages.filter((F.col("lang") == "en") & (F.size("words") > 1)).select(F.array_join(F.slice("words", 1, 2), "/").alias("title")))
    return ops.breadcrumbs(pages.drop("words"), catalogue, "page_id")
