"""Wiki-shaped views of the benchmark tables, each with its SQL twin in ``SQL``.

The benchmark tables hold no namespaces, images or categories; these views derive them row by row, so
that every view grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.urls import Site
from corpusweave.plans.keyed import lookup
from corpusweave.plans.layout import spread
from corpusweave.session import cut

SITE = Site(origin="https://wiki.example.org", article_path="/wiki/", script_path="/w/index.php")

LINK_PATTERN = '<a href="/([^"]*)"'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html, heading, title (first word of the heading), host, lang, path."""
    heading = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    return spread(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "html", heading.alias("heading"),
        F.split(heading, " ")[0].alias("title"),
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1).alias("lang"),
    )


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of ``pages``: one row per title, the lowest page id.

    Links in these pages name single words, so a page's key is the first word of its heading; pages that share it are one entry, as pages of
    one title are in a wiki.
    """
    return pages(spark, sf_dir).groupBy("title").agg(F.min("page_id").alias("page_id"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, target: the links of each page in document order."""
    targets = F.regexp_extract_all("html", F.lit(LINK_PATTERN), F.lit(1))
    return pages(spark, sf_dir).select("page_id", "title", F.posexplode(targets).alias("pos", "target"))


def page_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors in every shape the link rules know, built from the links of ``pages``."""
    links = page_links(spark, sf_dir)
    k = (F.col("page_id") * 7 + F.col("pos")) % 26
    w = F.col("target")

    def cat(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    href = F.coalesce(*[F.when(k == i, h) for i, h in {
        0: cat("/wiki/", w), 1: cat("/wiki/", w, "#sec"), 2: cat("./", w), 3: cat("https://wiki.example.org/wiki/", w),
        4: cat("https://other.example.com/", w), 5: cat("//cdn.example.com/", w), 6: cat("#cite_", F.col("pos")),
        7: F.lit(""), 8: F.lit(""), 9: cat("/wiki/", w), 10: cat("mailto:", w, "@example.org"),
        11: cat("/w/index.php?title=", w, "&action=edit"), 12: cat("/w/index.php?diff=", F.col("page_id")),
        13: cat("//tools.example.org/geohack/geohack.php?params=", F.col("page_id") % 90, "_30_N_", F.col("pos") % 180, "_W"),
        14: cat("/wiki/Special:Map/9/", F.col("page_id") % 90, ".5/-", F.col("pos"), ".25/en"),
        15: cat("//upload.example.org/commons/a/ab/", w, ".pdf"), 16: cat("//upload.example.org/commons/a/ab/", w, ".ogg"),
        17: cat("//upload.example.org/commons/a/ab/", w, ".txt"), 18: cat("./", w), 19: cat("/wiki/", w),
        20: cat("/about/", w), 21: cat("/wiki/", w), 22: cat("/wiki/", w), 23: cat("../../", w), 24: cat("/wiki/", w),
        25: cat("/archive/", F.col("page_id"), ".html"),
    }.items()])
    rel = F.coalesce(*[F.when(k == i, F.lit(r)) for i, r in {
        1: "mw:WikiLink", 2: "mw:WikiLink", 13: "mw:ExtLink", 19: "nofollow", 20: "nofollow", 22: "mwo:NoRewrite",
        24: "mw:WikiLink/Interwiki",
    }.items()], F.lit(""))
    css = F.coalesce(*[F.when(k == i, F.lit(c)) for i, c in {
        8: "selflink mw-selflink", 9: "new", 18: "external", 19: "mirror-link", 21: "mwo-norewrite", 24: "extiw",
    }.items()], F.lit(""))
    page_path = F.concat("title", F.when(F.col("page_id") % 3 == 0, F.lit("/sub")).otherwise(F.lit("")))
    return links.select(
        "page_id", "pos", page_path.alias("page_path"), href.alias("href"), rel.alias("rel"), css.alias("class"),
        F.when(k.isin(15, 16, 17), F.lit("./Media:x")).alias("resource"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, ns, contentmodel, revid, lang, first_id (lowest doc with the same text)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.concat(F.lit("Doc "), F.col("doc_id")).alias("title"), (F.col("doc_id") % 4).alias("ns"),
        F.col("source").alias("contentmodel"), F.col("n_chars").alias("revid"), "lang", "text",
    )


def text_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``first_id``, the lowest id among exact copies of the text.

    The texts are hashed once and the result, without them, is kept in the shared folder: its readers in one query take it as an argument.
    """
    docs = documents(spark, sf_dir).withColumn("digest", F.sha2("text", 256)).drop("text")
    firsts = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return cut(lookup(docs, firsts, ["digest"], "inner").drop("digest"))


def redirect_refs(copies: DataFrame) -> DataFrame:
    """Redirects of ``documents``: a later copy of a text leads to its first document, odd ids with a fragment."""
    return copies.filter("doc_id > first_id").select(
        "doc_id", F.col("title").alias("from_title"), F.concat(F.lit("Doc "), F.col("first_id")).alias("to_title"),
        "first_id", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("Part "), F.col("doc_id") % 7)).otherwise(F.lit("")).alias("fragment"),
        "ns", (F.col("first_id") % 4).alias("to_ns"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, section, body: the lines of each text; line 0 is the lead."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("section", "body"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category members: category, parent, member, title, sortkeyprefix, type."""
    kind = F.when(F.col("p_size") % 3 == 0, F.lit("subcat")).when(F.col("p_size") % 3 == 1, F.lit("page")).otherwise(F.lit("file"))
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"), F.col("p_brand").alias("parent"), F.col("p_partkey").alias("member"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("title"), F.col("p_name").alias("sortkeyprefix"), kind.alias("type"),
        F.col("p_size").alias("size"),
    )


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child to parent edges customer -> nation -> region -> root, and root -> region 0 to close a cycle."""
    def edge(df: DataFrame, src: Column, dst: Column) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"))

    def tag(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix), F.col(key))

    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        edge(customer, tag("C", "c_custkey"), tag("N", "c_nationkey"))
        .unionByName(edge(nation, tag("N", "n_nationkey"), tag("R", "n_regionkey")))
        .unionByName(edge(region, tag("R", "r_regionkey"), F.lit("root")))
        .unionByName(edge(region.filter("r_regionkey = 0"), F.lit("root"), tag("R", "r_regionkey")))
    )


def asset_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image uses: page, image, url, width (requested, may be null), seq (unique order)."""
    h = F.md5(F.col("l_partkey").cast("string"))
    quantity = F.col("l_quantity").cast("long")
    px = quantity * 10
    url = F.concat(
        F.lit("https://img.example.org/wiki/commons/thumb/"), F.substring(h, 1, 1), F.lit("/"), F.substring(h, 1, 2),
        F.lit("/P"), F.col("l_partkey"), F.lit(".png/"), px, F.lit("px-P"), F.col("l_partkey"), F.lit(".png"),
    )
    seq = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    uses = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"))
    return uses.select(
        F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("image"), url.alias("url"),
        F.when(quantity >= 5, quantity * 20).alias("width"), seq.alias("seq"), F.col("l_linenumber").alias("pos"),
        F.col("l_suppkey").alias("supplier"), quantity.alias("quantity"), F.col("l_returnflag").alias("flag"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts: event_id, ts, source, kind, k, duration and the response fields the error rules look at."""
    k = F.get_json_object("props", "$.k").cast("long")
    shape = k % 20
    failed = F.col("event_type") == "error"
    codes = {0: 404, 2: 200, 3: 200, 5: 504, 6: 503, 7: 200, 8: 200, 9: 200, 10: 200, 11: 200, 12: 200, 13: 200, 14: 200,
             15: 500, 16: 429, 17: 502, 18: 403, 19: 200}
    api = {2: "missingtitle", 3: "permissiondenied", 5: "internal_api_error_Wikimedia\\RequestTimeout\\RequestTimeoutException",
           7: "internal_api_error_MediaWiki\\Revision\\BadRevisionException",
           8: "internal_api_error_Wikimedia\\Assert\\UnreachableException",
           9: "internal_api_error_Wikimedia\\Assert\\InvariantException",
           10: "internal_api_error_Wikimedia\\Parsoid\\Core\\ResourceLimitExceededException",
           11: "internal_api_error_Error", 12: "internal_api_error_InvalidArgumentException", 13: "internal_api_error_TypeError",
           14: "maxlag", 19: "categorylockdown"}

    def pick(values: dict[int, object]) -> Column:
        table = F.create_map(*[F.lit(x).cast("bigint") if n % 2 == 0 else F.lit(x) for kv in values.items() for n, x in enumerate(kv)])
        return F.when(failed, F.try_element_at(table, shape))

    raw = pick({1: "Page has been deleted.", 6: "Our servers are currently under maintenance or experiencing a technical problem",
                15: "", 16: "slow down", 17: "bad gateway", 18: "forbidden", 0: "not found"})
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("source"), F.col("event_type").alias("kind"),
        k.alias("k"), F.col("value").alias("duration"), failed.alias("failed"),
        F.concat(F.lit("https://wiki.example.org/w/api.php?action=parse&format=json&page=P"), F.col("event_id")).alias("url"),
        pick({4: "ERR_CANCELED"}).alias("error_code"),
        F.when(failed, pick(codes)).otherwise(F.lit(200)).cast("long").alias("http"),
        F.when(failed, F.when(shape.isin(1, 6, 15, 16, 17, 18, 0), F.lit("text/html; charset=utf-8"))
               .when(shape == 4, F.lit(None)).otherwise(F.lit("application/json; charset=utf-8")))
        .otherwise(F.lit("application/json")).alias("content_type"),
        raw.alias("raw_body"), F.when(raw.isNull() & pick(api).isNotNull(), F.to_json(F.struct(F.struct(pick(api).alias("code")).alias("error")))).alias("json_body"),
    )


def fetch_sql() -> str:
    api = ("CASE k % 20 WHEN 2 THEN 'missingtitle' WHEN 3 THEN 'permissiondenied' "
           r"WHEN 5 THEN 'internal_api_error_Wikimedia\RequestTimeout\RequestTimeoutException' "
           r"WHEN 7 THEN 'internal_api_error_MediaWiki\Revision\BadRevisionException' "
           r"WHEN 8 THEN 'internal_api_error_Wikimedia\Assert\UnreachableException' "
           r"WHEN 9 THEN 'internal_api_error_Wikimedia\Assert\InvariantException' "
           r"WHEN 10 THEN 'internal_api_error_Wikimedia\Parsoid\Core\ResourceLimitExceededException' "
           "WHEN 11 THEN 'internal_api_error_Error' WHEN 12 THEN 'internal_api_error_InvalidArgumentException' "
           "WHEN 13 THEN 'internal_api_error_TypeError' WHEN 14 THEN 'maxlag' WHEN 19 THEN 'categorylockdown' END")
    return f"""
v_ev AS (SELECT event_id, ts, user_id AS source, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                value AS duration, event_type = 'error' AS failed FROM events),
v_fetch AS (
  SELECT *, 'https://wiki.example.org/w/api.php?action=parse&format=json&page=P' || event_id AS url,
    CASE WHEN failed AND k % 20 = 4 THEN 'ERR_CANCELED' END AS error_code,
    CASE WHEN failed THEN CASE k % 20 WHEN 0 THEN 404 WHEN 5 THEN 504 WHEN 6 THEN 503 WHEN 15 THEN 500 WHEN 16 THEN 429
      WHEN 17 THEN 502 WHEN 18 THEN 403 WHEN 1 THEN NULL WHEN 4 THEN NULL ELSE 200 END ELSE 200 END AS http,
    CASE WHEN failed THEN CASE WHEN k % 20 IN (1, 6, 15, 16, 17, 18, 0) THEN 'text/html; charset=utf-8'
      WHEN k % 20 = 4 THEN NULL ELSE 'application/json; charset=utf-8' END ELSE 'application/json' END AS content_type,
    CASE WHEN failed THEN CASE k % 20 WHEN 1 THEN 'Page has been deleted.'
      WHEN 6 THEN 'Our servers are currently under maintenance or experiencing a technical problem' WHEN 15 THEN ''
      WHEN 16 THEN 'slow down' WHEN 17 THEN 'bad gateway' WHEN 18 THEN 'forbidden' WHEN 0 THEN 'not found' END END AS raw_body,
    CASE WHEN failed THEN {api} END AS api_code
  FROM v_ev)"""


# DuckDB twins of the views above, as common table expressions.
SQL = {
    "pages": r"""
v_p0 AS (SELECT *, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading,
                regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
                regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS lang FROM pages),
v_pages AS (SELECT *, split_part(heading, ' ', 1) AS title FROM v_p0),
v_titles AS (SELECT title, min(page_id) AS page_id FROM v_pages GROUP BY title),
v_arr AS (SELECT page_id, title, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS arr FROM v_pages),
v_links AS (SELECT page_id, title, unnest(arr) AS target, unnest(range(len(arr))) AS pos FROM v_arr)""",
    "hrefs": r"""
v_hk AS (SELECT *, (page_id * 7 + pos) % 26 AS k FROM v_links),
v_hrefs AS (SELECT page_id, pos, title || CASE WHEN page_id % 3 = 0 THEN '/sub' ELSE '' END AS page_path,
  CASE k WHEN 0 THEN '/wiki/' || target WHEN 1 THEN '/wiki/' || target || '#sec' WHEN 2 THEN './' || target
    WHEN 3 THEN 'https://wiki.example.org/wiki/' || target WHEN 4 THEN 'https://other.example.com/' || target
    WHEN 5 THEN '//cdn.example.com/' || target WHEN 6 THEN '#cite_' || pos WHEN 7 THEN '' WHEN 8 THEN ''
    WHEN 9 THEN '/wiki/' || target WHEN 10 THEN 'mailto:' || target || '@example.org'
    WHEN 11 THEN '/w/index.php?title=' || target || '&action=edit' WHEN 12 THEN '/w/index.php?diff=' || page_id
    WHEN 13 THEN '//tools.example.org/geohack/geohack.php?params=' || (page_id % 90) || '_30_N_' || (pos % 180) || '_W'
    WHEN 14 THEN '/wiki/Special:Map/9/' || (page_id % 90) || '.5/-' || pos || '.25/en'
    WHEN 15 THEN '//upload.example.org/commons/a/ab/' || target || '.pdf'
    WHEN 16 THEN '//upload.example.org/commons/a/ab/' || target || '.ogg'
    WHEN 17 THEN '//upload.example.org/commons/a/ab/' || target || '.txt' WHEN 18 THEN './' || target
    WHEN 20 THEN '/about/' || target WHEN 23 THEN '../../' || target WHEN 25 THEN '/archive/' || page_id || '.html'
    ELSE '/wiki/' || target END AS href,
  CASE k WHEN 1 THEN 'mw:WikiLink' WHEN 2 THEN 'mw:WikiLink' WHEN 13 THEN 'mw:ExtLink' WHEN 19 THEN 'nofollow'
    WHEN 20 THEN 'nofollow' WHEN 22 THEN 'mwo:NoRewrite' WHEN 24 THEN 'mw:WikiLink/Interwiki' ELSE '' END AS rel,
  CASE k WHEN 8 THEN 'selflink mw-selflink' WHEN 9 THEN 'new' WHEN 18 THEN 'external' WHEN 19 THEN 'mirror-link'
    WHEN 21 THEN 'mwo-norewrite' WHEN 24 THEN 'extiw' ELSE '' END AS class,
  CASE WHEN k IN (15, 16, 17) THEN './Media:x' END AS resource
  FROM v_hk)""",
    "docs": """
v_docs AS (SELECT doc_id, 'Doc ' || doc_id AS title, doc_id % 4 AS ns, source AS contentmodel, n_chars AS revid, lang,
                  min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents),
v_refs AS (SELECT doc_id, title AS from_title, 'Doc ' || first_id AS to_title, first_id, ns, first_id % 4 AS to_ns,
                  CASE WHEN doc_id % 2 = 1 THEN 'Part ' || (doc_id % 7) ELSE '' END AS fragment
           FROM v_docs WHERE doc_id > first_id)""",
    "sections": """
v_lines AS (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents),
v_sections AS (SELECT doc_id, unnest(arr) AS body, unnest(range(len(arr))) AS section FROM v_lines)""",
    "parts": """
v_parts AS (SELECT p_type AS category, p_brand AS parent, p_partkey AS member, p_name || ' ' || p_partkey AS title,
  p_name AS sortkeyprefix, CASE p_size % 3 WHEN 0 THEN 'subcat' WHEN 1 THEN 'page' ELSE 'file' END AS type, p_size AS size
  FROM part)""",
    "tree": """
v_tree AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'root' FROM region
  UNION ALL SELECT 'root', 'R' || r_regionkey FROM region WHERE r_regionkey = 0)""",
    "assets": """
v_a0 AS (SELECT *, md5(CAST(l_partkey AS VARCHAR)) AS h, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem),
v_assets AS (SELECT l_orderkey AS page, l_partkey AS image,
  'https://img.example.org/wiki/commons/thumb/' || substr(h, 1, 1) || '/' || substr(h, 1, 2) || '/P' || l_partkey || '.png/'
    || (quantity * 10) || 'px-P' || l_partkey || '.png' AS url,
  CASE WHEN quantity >= 5 THEN quantity * 20 END AS width,
  lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 12, '0') || '-'
    || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS seq,
  l_linenumber AS pos, l_suppkey AS supplier, quantity, l_returnflag AS flag FROM v_a0)""",
    "fetch": fetch_sql(),
}


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    head = ", ".join(SQL[n].strip() for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if body.lstrip().upper().startswith("SELECT") \
        else f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body.lstrip()}"
