"""Asset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.functions.assets import asset_path as path_of
from corpusweave.functions.assets import url_multiplier, url_width
from corpusweave.functions.urls import absolute_url
from corpusweave.operators import assets as ops
from corpusweave.operators.links import Flags
from corpusweave.queries import Family
from corpusweave.session import new_table_path
from corpusweave.sources import html_tokens, views
from corpusweave.sources.views import with_views
from corpusweave.sources.wiki_html import wiki_pages

QUERIES = Family()


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@QUERIES.add(with_views("assets", body="SELECT page, url, 'image' AS kind, min(seq) AS seq FROM v_assets GROUP BY page, url"))
def asset_refs(spark, sf_dir):
    refs = views.asset_uses(spark, sf_dir).select("page", "url", F.lit("image").alias("kind"), "seq")
    return ops.first_uses(refs, "page", "seq")


@QUERIES.add(with_views("sections", body="""
s AS (SELECT doc_id AS page_id, doc_id + section AS k FROM v_sections WHERE len(string_split(body, ' ')) >= 4),
r AS (SELECT page_id, 'https://img.example.org/a/ab/P' || k || '.png' AS url, 'image' AS kind, 120 AS width FROM s WHERE k % 20 = 2
  UNION SELECT page_id, 'https://wiki.example.org/im/i.png', 'image', NULL FROM s WHERE k % 20 = 9
  UNION SELECT page_id, 'https://img.example.org/a/ab/V' || k || '.jpg', 'image', NULL FROM s WHERE k % 20 = 10
  UNION SELECT page_id, 'https://wiki.example.org/v/' || k || '.webm', 'video', NULL FROM s WHERE k % 20 IN (10, 14)
  UNION SELECT page_id, 'https://wiki.example.org/v/' || k || '.ogg', 'video', NULL FROM s WHERE k % 20 = 12
  UNION SELECT page_id, 'https://wiki.example.org/w/api.php?title=V' || k || '.webm&lang=en&trackformat=vtt', 'subtitle', NULL FROM s WHERE k % 20 = 14
  UNION SELECT page_id, 'https://wiki.example.org/im/n.png', 'image', NULL FROM s WHERE k % 20 = 15)
SELECT page_id, url, kind, CAST(width AS BIGINT) AS width FROM r"""))
def asset_refs_html(spark, sf_dir):
    # tokens and references have two readers each; of the tokens only those that name files are kept
    path = new_table_path(spark, "tokens")
    ops.file_elements(html_tokens.tokenize(wiki_pages(spark, sf_dir))).write.parquet(path)
    tokens = spark.read.parquet(path)
    refs = ops.token_refs(tokens, views.SITE).unionByName(ops.media_sources(tokens, views.SITE).drop("source_seq"))
    uses = ops.first_uses(refs, "page_id", "seq").drop("seq")
    return uses.join(ops.requested_widths(refs, "page_id"), ["page_id", "url"], "left").select("page_id", "url", "kind", "width")


@QUERIES.add(with_views("pages", body=r"""
b AS (SELECT page_id, title, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1) AS folder, url FROM v_pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example.org/' || title WHEN 1 THEN origin || '/img/' || title
  WHEN 2 THEN 'https://x.example.org/' || title || '.png' WHEN 3 THEN origin || regexp_replace(folder, '^(/|.*/)[^/]+/$', '\1') || 'x/' || title
  WHEN 4 THEN origin || folder || 'y.png?q=../1' ELSE 'data:image/png;base64,' || page_id END AS url FROM b"""))
def asset_url(spark, sf_dir):
    k, t = F.col("page_id") % 6, F.col("title")
    href = (F.when(k == 0, _cat("//cdn.example.org/", t)).when(k == 1, _cat("/img/./", t)).when(k == 2, _cat("https://x.example.org/a/../", t, ".png"))
            .when(k == 3, _cat("../x/", t)).when(k == 4, F.lit("./y.png?q=../1")).otherwise(_cat("data:image/png;base64,", F.col("page_id"))))
    return views.pages(spark, sf_dir).select("page_id", absolute_url(href, F.col("url")).alias("url"))


@QUERIES.add("""
SELECT p_partkey, '_assets_/' || CASE p_partkey % 6
  WHEN 0 THEN md5('https://up.example.org/commons/') || '/P_' || p_partkey || '%20(x).svg.png' WHEN 1 THEN md5('https://up.example.org/commons/') || '/P' || p_partkey || '.jpg'
  WHEN 2 THEN md5('https://up.example.org/math/render/svg/') || '/ab' || p_partkey || '.svg'
  WHEN 3 THEN md5('https://static.example.org/wiki/images/') || '/' || url_encode(p_name) || '.png'
  WHEN 4 THEN md5('https://en.example.org/w/load.php?modules=m' || p_size || '&image=i&variant=v') || '_load.php_m' || p_size || '_i_v.svg'
  ELSE md5('https://maps.example.org/img/osm,' || p_size || ',9') || '_osm%2C' || p_size || '%2C9' END AS path FROM part""")
def asset_path(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    k = key % 6
    url = (
        F.when(k == 0, _cat("https://up.example.org/commons/thumb/3/39/P_", key, "%20%28x%29.svg/120px-P_", key, "%20%28x%29.svg.png?utm_source=x"))
        .when(k == 1, _cat("https://up.example.org/commons/3/39/P", key, ".jpg")).when(k == 2, _cat("https://up.example.org/math/render/svg/ab", key))
        .when(k == 3, _cat("https://static.example.org/wiki/images/e/ee/", F.replace("p_name", F.lit(" "), F.lit("%20")), ".png/revision/latest?cb=1"))
        .when(k == 4, _cat("https://en.example.org/w/load.php?modules=m", size, "&image=i&variant=v")).otherwise(_cat("https://maps.example.org/img/osm,", size, ",9")))
    return views.table(spark, sf_dir, "part").select("p_partkey", path_of(url, escape=True).alias("path"))


@QUERIES.add("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END AS width, CASE WHEN p_partkey % 3 = 1 THEN p_size / 2 END AS mult FROM part""")
def asset_size(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    url = (F.when(key % 3 == 0, _cat("https://x.org/thumb/9px-P.png/", size, "px-9px.png")).when(key % 3 == 1, _cat("https://x.org/12x-P-", size / 2, "x.png"))
           .otherwise(_cat("https://x.org/P", key, ".png")))
    return views.table(spark, sf_dir, "part").select("p_partkey", url_width(url).alias("width"), url_multiplier(url).alias("mult"))


@QUERIES.add(with_views("assets", body="SELECT page, url, max(width) AS width FROM v_assets WHERE width > 0 GROUP BY page, url"))
def asset_req_width(spark, sf_dir):
    return ops.requested_widths(views.asset_uses(spark, sf_dir), "page")


@QUERIES.add(with_views("assets", body="""
p AS (SELECT *, '_assets_/' || md5('https://img.example.org/wiki/commons/') || '/P' || image || '.png' AS path, coalesce(width, quantity * 10) AS w FROM v_assets),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY w DESC, seq) AS rn FROM p)
SELECT path, url, w AS width, CAST(NULL AS DOUBLE) AS mult, page FROM r WHERE rn = 1"""))
def asset_dedup(spark, sf_dir):
    uses = ops.with_paths(views.asset_uses(spark, sf_dir))
    return ops.best_resolution(uses, [F.col(x).cast("long") for x in ("page", "pos", "image", "supplier")], ["page"])


_SOURCES_SQL = """
src AS (SELECT page AS video, CAST(pos AS BIGINT) * 1000000000 + image * 10000 + supplier AS pos, 'https://v.example.org/' || image || CASE flag WHEN 'A' THEN '.vp9.webm' WHEN 'N' THEN '.webm' ELSE '.ogv' END AS src,
  quantity * 20 AS width, (page % 5) * 200 AS display_width, flag = 'A' AS vp9 FROM v_assets)"""


def _sources(spark, sf_dir):
    flag = F.col("flag")
    return views.asset_uses(spark, sf_dir).select(
        F.col("page").alias("video"), (F.col("pos") * F.lit(1000000000).cast("long") + F.col("image") * 10000 + F.col("supplier")).alias("pos"),
        _cat("https://v.example.org/", F.col("image"), F.when(flag == "A", ".vp9.webm").when(flag == "N", ".webm").otherwise(".ogv")).alias("src"),
        (F.col("quantity") * 20).alias("width"), (F.col("page") % 5 * 200).alias("display_width"),
        F.when(flag == "R", "audio/ogg; codecs=x").otherwise("audio/mpeg").alias("type"))


@QUERIES.add(with_views("assets", body=_SOURCES_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN display_width > 0 AND width < display_width THEN 1 ELSE 0 END,
  CASE WHEN display_width > 0 THEN abs(width - display_width) ELSE -width END, vp9 DESC, CASE WHEN display_width > 0 AND vp9 THEN -pos ELSE pos END) AS rn FROM src WHERE flag_ok)
SELECT video, pos, src, width FROM r WHERE rn = 1""".replace("flag_ok", "src LIKE '%.webm'")))
def video_source(spark, sf_dir):
    return ops.choose_video_source(_sources(spark, sf_dir), "video").select("video", "pos", "src", "width")


@QUERIES.add(with_views("assets", body=_SOURCES_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY src LIKE '%.ogv' DESC, pos) AS rn FROM src)
SELECT video AS audio, pos, src FROM r WHERE rn = 1"""))
def audio_source(spark, sf_dir):
    return ops.choose_audio_source(_sources(spark, sf_dir).withColumnRenamed("video", "audio"), "audio").select("audio", "pos", "src")


@QUERIES.add("""
WITH t AS (SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS lang FROM part)
SELECT p_partkey, 'https://wiki.example.org/w/api.php?title=File:' || replace(p_name, ' ', '%20') || '&lang=' || lang || CASE WHEN p_partkey % 2 = 0 THEN '&trackformat=vtt' ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN '&x=1' ELSE '&trackformat=vtt' END AS url, 'File:' || p_name || '-' || lang || '.vtt' AS path,
  '../File:' || p_name || '-' || lang || '.vtt' AS new_src FROM t""")
def subtitle_refs(spark, sf_dir):
    size = F.col("p_size") % 3
    lang = F.when(size == 0, "en").when(size == 1, "fr").otherwise("de")
    src = _cat("/w/api.php?title=File:", F.replace("p_name", F.lit(" "), F.lit("%20")), "&lang=", lang, F.when(F.col("p_partkey") % 2 == 0, "&trackformat=srt&x=1").otherwise(""))
    tracks = views.table(spark, sf_dir, "part").select("p_partkey", F.lit("Video/Page").alias("page_path"), src.alias("src"))
    return ops.subtitle_refs(tracks, views.SITE).select("p_partkey", "url", "path", "new_src")


@QUERIES.add(with_views("assets", body="""
m AS (SELECT seq, CASE flag WHEN 'A' THEN 'img' WHEN 'N' THEN 'video' ELSE 'audio' END AS tag, CASE quantity % 4 WHEN 0 THEN './Special:FilePath/' || image WHEN 1 THEN 'data:image/png,x' ELSE url END AS src,
  quantity % 5 = 0 AS formula FROM v_assets)
SELECT seq, v.variant, CASE WHEN tag <> 'img' THEN CASE WHEN v.variant = 'full' THEN 'fetch' ELSE 'drop' END WHEN src LIKE './Special:%' THEN 'drop' WHEN src LIKE 'data:%' THEN 'keep'
  WHEN v.variant = 'nopic' AND NOT formula THEN 'placeholder' ELSE 'fetch' END AS decision FROM m, (VALUES ('full'), ('nopic'), ('nodet')) v(variant)"""))
def media_drop(spark, sf_dir):
    q, flag = F.col("quantity"), F.col("flag")
    uses = views.asset_uses(spark, sf_dir).select(
        "seq", F.when(flag == "A", "img").when(flag == "N", "video").otherwise("audio").alias("tag"),
        F.when(q % 4 == 0, _cat("./Special:FilePath/", F.col("image"))).when(q % 4 == 1, F.lit("data:image/png,x")).otherwise(F.col("url")).alias("src"),
        (q % 5 == 0).alias("formula"))
    decisions = F.array(*[
        F.struct(F.lit(name).alias("variant"), ops.media_decision(F.col("tag"), F.col("src"), F.col("formula"), flags).alias("decision"))
        for name, flags in (("full", Flags()), ("nopic", Flags(nopic=True)), ("nodet", Flags(nodet=True)))])
    return uses.select("seq", F.inline(decisions))


@QUERIES.add("""
SELECT p_partkey, CASE WHEN p_size < 15 OR p_size % 7 = 0 OR p_partkey % 11 = 0 THEN 'miss' WHEN p_partkey % 5 > 2 THEN 'stale' WHEN p_partkey % 2 = 0 THEN 'hit' ELSE 'revalidate' END AS state,
  CASE WHEN NOT (p_size < 15 OR p_size % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 5 > 2) THEN '"e' || p_partkey || '"' END AS if_none_match FROM part""")
def cache_reconcile(spark, sf_dir):
    key, part = F.col("p_partkey"), views.table(spark, sf_dir, "part")
    version = ops.cache_version(F.col("p_size"), webp=True)
    wanted = part.select("p_partkey", _cat("https://img.example.org/P", key, ".png").alias("url"), version.alias("version"),
                         F.when(key % 2 == 0, _cat('"e', key, '"')).when(key % 4 == 1, F.lit('"other"')).alias("upstream_etag"))
    cache = part.filter("p_size >= 15").select(
        _cat("img.example.org/P", key, ".png").alias("cache_key"), F.when(key % 5 <= 2, version).otherwise(F.lit("1")).alias("cached_version"),
        F.when(key % 11 != 0, _cat(F.when(key % 4 == 0, "W/").otherwise(""), '"e', key, '"')).alias("cached_etag"), (F.col("p_size") % 7 * 10).alias("length"))
    return ops.reconcile_cache(wanted, cache).select("p_partkey", "state", "if_none_match")


@QUERIES.add(with_views("assets", body="""
SELECT seq, 'webp' || CASE WHEN width > 0 THEN '-w' || width ELSE '' END AS webp_version, '1' || CASE WHEN width > 0 THEN '-w' || width ELSE '' END AS plain_version FROM v_assets"""))
def cache_version(spark, sf_dir):
    width = F.col("width")
    return views.asset_uses(spark, sf_dir).select("seq", ops.cache_version(width, True).alias("webp_version"), ops.cache_version(width, False).alias("plain_version"))


@QUERIES.add(with_views("pages", body="""
m AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'text/javascript' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/svg+xml' WHEN 3 THEN 'font/woff2' WHEN 4 THEN 'image/jpeg' WHEN 5 THEN 'text/css' WHEN 6 THEN 'image/gif' END AS mime FROM v_pages)
SELECT page_id, mime, mime LIKE 'image/%' AND mime NOT LIKE '%+%' AS is_image, mime IN ('image/png', 'image/jpeg', 'image/gif') AS is_bitmap, mime IN ('image/png', 'image/jpeg', 'image/gif') AS is_webp_candidate FROM m"""))
def mime_class(spark, sf_dir):
    # the host may hold dots, the name may not have an extension
    names = F.element_at(F.array(*[F.lit(x) for x in ("a.min.js", "b.PNG", "c.svg", "d.woff2", "e.jpeg", "f.css", "g.gif", "noext")]), (F.col("page_id") % 8 + 1).cast("int"))
    rows = views.pages(spark, sf_dir).select("page_id", ops.mime_of(F.concat("host", F.lit("/"), names)).alias("mime"))
    return rows.select("page_id", "mime", ops.mime_flags(F.col("mime")).alias("f")).select("page_id", "mime", "f.*")


@QUERIES.add(with_views("pages", body="SELECT host, count(*) AS assets, count(*) FILTER (page_id % 7 <> 0) AS success, count(*) FILTER (page_id % 7 = 0) AS fail FROM v_pages GROUP BY host"))
def host_rollup(spark, sf_dir):
    return ops.host_rollup(views.table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 7 != 0).alias("ok")))


@QUERIES.add("""
WITH l AS (SELECT doc_id, doc_id % 50 * 10 + 20 AS w FROM documents WHERE doc_id % 3 = 0 ORDER BY doc_id LIMIT 100)
SELECT doc_id, 'https://up.example.org/commons/thumb/3/39/D' || doc_id || '.jpg/500px-D' || doc_id || '.jpg' AS url,
  '_assets_/' || md5('https://up.example.org/commons/') || '/D' || doc_id || '.jpg' AS path, CAST(500 AS BIGINT) AS width FROM l""")
def thumbnails(spark, sf_dir):
    d = F.col("doc_id")
    listed = views.table(spark, sf_dir, "documents").select(
        "doc_id", d.alias("pos"), F.when(d % 3 == 0, _cat("https://up.example.org/commons/thumb/3/39/D", d, ".jpg/", d % 50 * 10 + 20, "px-D", d, ".jpg")).alias("source"))
    return ops.listed_thumbnails(listed).select("doc_id", "url", "path", "width")
