"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.operators import catalogue as ops
from corpusweave.queries import Family
from corpusweave.session import new_table_path, small_table
from corpusweave.sources import batches, page_list, views
from corpusweave.sources.views import with_views

QUERIES = Family()


def _responses(spark, sf_dir):
    """Land ``documents`` as response files, two pages' worth of fields per response, then read them back."""
    record = F.struct(
        F.concat(F.lit("Doc "), "doc_id").alias("title"), (F.col("doc_id") % 4).cast("int").alias("ns"),
        F.col("source").alias("contentmodel"),
        F.array(F.struct(F.col("n_chars").alias("revid"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))).alias("revisions"),
    )
    twin = record.withField("title", F.concat(F.lit("Doc "), "doc_id", F.lit(" b")))
    landed = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.struct(F.array(record, twin).alias("pages")).alias("query"),
        F.when(F.col("doc_id") % 10 == 0, F.create_map(F.lit("main"), F.create_map(F.lit("warnings"), F.concat(F.lit("Unrecognized value "), "lang")))).alias("warnings"),
        F.when(F.col("doc_id") % 25 == 0, F.struct(F.when(F.col("doc_id") % 2 == 0, F.lit("internal_api_error_DBQueryError")).otherwise(F.lit("maxlag")).alias("code"))).alias("error"),
    )
    path = new_table_path(spark, "responses")
    landed.write.json(path)
    return batches.read_responses(spark, path)


@QUERIES.add("""
SELECT doc_id AS seq, 'Doc ' || doc_id || s AS title, CAST(doc_id % 4 AS INTEGER) AS ns, source AS contentmodel, n_chars AS revid
FROM documents, (VALUES (''), (' b')) v(s)""")
def scan_page_batches(spark, sf_dir):
    records = batches.page_records(_responses(spark, sf_dir))
    return records.select("seq", "title", "ns", "contentmodel", F.get("revisions", F.lit(0))["revid"].alias("revid"))


@QUERIES.add("""
SELECT level, module, text, count(*) AS times, level = 'error' AND text = 'internal_api_error_DBQueryError' AS fatal FROM (
  SELECT 'warning' AS level, 'main' AS module, 'Unrecognized value ' || lang AS text FROM documents WHERE doc_id % 10 = 0
  UNION ALL SELECT 'error', 'api', CASE WHEN doc_id % 2 = 0 THEN 'internal_api_error_DBQueryError' ELSE 'maxlag' END
  FROM documents WHERE doc_id % 25 = 0) GROUP BY level, module, text""")
def warning_census(spark, sf_dir):
    return batches.warning_census(_responses(spark, sf_dir))


@QUERIES.add("""
SELECT 'good' AS reason, count(*) AS lines, sum(doc_id)::BIGINT AS seqs FROM documents WHERE doc_id % 6 NOT IN (1, 2, 3)
UNION ALL SELECT CASE doc_id % 6 WHEN 1 THEN 'not json' WHEN 2 THEN 'other shape' ELSE 'empty' END, count(*), NULL FROM documents WHERE doc_id % 6 IN (1, 2, 3) GROUP BY 1""")
def quarantine(spark, sf_dir):
    """Every sixth landed line is cut off in its middle, every sixth has a list for a number, every sixth nothing in it."""
    k = F.col("doc_id")
    whole = F.to_json(F.struct(k.alias("seq"), F.struct(F.array(F.struct(F.col("text").alias("title"))).alias("pages")).alias("query")))
    line = F.when(k % 6 == 1, F.substring(whole, 1, 20)).when(k % 6 == 2, F.regexp_replace(whole, '"seq":([0-9]+)', '"seq":[$1]')).when(k % 6 == 3, "{}").otherwise(whole)
    path = new_table_path(spark, "landed")
    views.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    good, malformed = batches.read_quarantined(spark, path)
    return good.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("lines"), F.sum("seq").alias("seqs")).union(
        malformed.groupBy("reason").agg(F.count(F.lit(1)), F.lit(None).cast("long")))


def _continuations(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", F.col("text")).alias("answer"),
        F.col("role").alias("kind"), F.split("text", "\n").alias("parts"), F.create_map("role", "text").alias("props"),
    )


@QUERIES.add("""
SELECT conv_id AS page, arg_max(role, turn) AS kind, arg_max(text, turn) FILTER (role = 'assistant') AS answer
FROM conversations GROUP BY conv_id""")
def merge_continuations(spark, sf_dir):
    return batches.merge_scalars(_continuations(spark, sf_dir), "page", "seq", ["kind", "answer"])


@QUERIES.add("""
WITH a AS (SELECT conv_id AS page, turn, string_split(text, chr(10)) AS arr FROM conversations),
b AS (SELECT page, turn, unnest(arr) AS item, unnest(range(len(arr))) AS pos FROM a)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY turn, pos) AS ordinal, item FROM b""")
def merge_continuation_items(spark, sf_dir):
    return batches.merge_items(_continuations(spark, sf_dir), "page", "seq", "parts")


@QUERIES.add("SELECT conv_id AS page, role AS field, arg_max(text, turn) AS value FROM conversations GROUP BY conv_id, role")
def merge_continuation_objects(spark, sf_dir):
    return batches.merge_entries(_continuations(spark, sf_dir), "page", "seq", "props")


# "mixed" is an object, an array or a number, by turn: what comes before a change of its kind is gone
@QUERIES.add("""
WITH c AS (SELECT conv_id AS page, turn, role, text, 'props.' || role AS props, turn % 3 AS kind, string_split(text, chr(10)) AS arr FROM conversations),
k AS (SELECT page, arg_max(kind, turn) AS kind FROM c GROUP BY page),
since AS (SELECT k.page, k.kind, coalesce(max(turn) FILTER (c.kind <> k.kind), -1) AS turn FROM k JOIN c USING (page) GROUP BY k.page, k.kind),
mixed AS (SELECT c.page, c.turn, c.kind FROM c JOIN since s ON s.page = c.page AND c.turn > s.turn),
parts AS (SELECT page, turn, unnest(arr) AS item, unnest(range(len(arr))) AS pos FROM c)
SELECT page, path, ordinal, CAST(value AS VARCHAR) AS value FROM (SELECT page, 'kind' AS path, CAST(1 AS BIGINT) AS ordinal, to_json(arg_max(role, turn)) AS value FROM c GROUP BY page
UNION ALL SELECT page, props || '.n', 1, CAST(arg_max(length(text), turn) AS VARCHAR) FROM c GROUP BY page, props
UNION ALL SELECT page, props || '.t' || (turn % 2), 1, CAST(max(turn) AS VARCHAR) FROM c GROUP BY page, props, turn % 2
UNION ALL SELECT page, 'parts', row_number() OVER (PARTITION BY page ORDER BY turn, pos), to_json(item) FROM parts
UNION ALL SELECT page, 'mixed.x', 1, CAST(max(turn) AS VARCHAR) FROM mixed WHERE kind = 0 GROUP BY page
UNION ALL SELECT page, 'mixed', row_number() OVER (PARTITION BY page ORDER BY turn), CAST(turn AS VARCHAR) FROM mixed WHERE kind = 1
UNION ALL SELECT page, 'mixed', 1, CAST(max(turn) AS VARCHAR) FROM mixed WHERE kind = 2 GROUP BY page)""")
def merge_nested(spark, sf_dir):
    turn = F.col("turn")
    props = F.create_map("role", F.create_map(F.lit("n"), F.length("text").cast("long"), F.concat(F.lit("t"), (turn % 2).cast("string")), turn))
    body = F.to_json(F.struct(F.col("role").alias("kind"), props.alias("props"), F.split("text", "\n").alias("parts")))
    mixed = F.when(turn % 3 == 0, F.concat(F.lit('{"x":'), turn, F.lit("}"))).when(turn % 3 == 1, F.concat(F.lit("["), turn, F.lit("]"))).otherwise(turn.cast("string"))
    landed = views.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page"), F.col("turn").alias("seq"), F.parse_json(F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"mixed":'), mixed, F.lit("}"))).alias("doc"))
    leaves = batches.merge_nested(landed, "page", "seq", "doc")
    return leaves.select("page", F.array_join("path", ".").alias("path"), "ordinal", "value")


@QUERIES.add(r"""
WITH f0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: replace(x, chr(13), '')), lambda x: x <> '') AS arr FROM documents),
i0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS arr FROM documents),
u AS (SELECT 'file' AS kind, doc_id, unnest(arr) AS t, unnest(range(len(arr))) AS pos FROM f0
  UNION ALL SELECT 'inline', doc_id, unnest(arr), unnest(range(len(arr))) FROM i0)
SELECT kind, doc_id, pos, replace(t, '_', ' ') AS title FROM u""")
def page_list_intake(spark, sf_dir):
    def rows(kind, titles):
        return F.transform(titles, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("pos"), t.alias("title")))

    both = F.concat(rows("file", page_list.line_titles("text")), rows("inline", page_list.inline_titles("text")))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.inline(both))


@QUERIES.add(with_views("pages", body="""
SELECT title, page_id FROM v_titles WHERE title IN (SELECT target FROM v_links WHERE pos = 0) OR title = 'The'"""))
def select_by_title(spark, sf_dir):
    listed = views.page_links(spark, sf_dir).filter("pos = 0").select(F.col("target").alias("title"))
    return ops.select_titles(views.page_titles(spark, sf_dir), listed, main_page="The")


@QUERIES.add(with_views("docs", body="SELECT doc_id, title, ns FROM v_docs WHERE ns IN (0, 2) AND doc_id = first_id"))
def select_by_namespace(spark, sf_dir):
    originals = views.text_copies(spark, sf_dir).filter("doc_id = first_id")
    return ops.select_namespaces(originals, [0, 2]).select("doc_id", "title", "ns")


@QUERIES.add("""
WITH e AS (
  SELECT s_suppkey AS num, CASE WHEN s_suppkey = 8 THEN 'Story' ELSE 'space ' || s_suppkey END AS name,
         CASE WHEN s_suppkey % 2 = 0 THEN 'Canon ' || s_suppkey END AS canonical, s_suppkey % 5 = 0 AS subpages,
         s_suppkey % 4 = 0 AS content, FALSE AS is_alias FROM supplier
  UNION ALL SELECT s_suppkey, 'alias ' || s_suppkey, NULL, s_suppkey % 5 = 0, s_suppkey % 4 = 0, TRUE FROM supplier WHERE s_suppkey % 3 = 0),
m AS (SELECT DISTINCT num FROM e WHERE ((content AND NOT is_alias) OR num IN (3, 7)) AND name <> 'Story'),
s AS (SELECT num, subpages, name AS base FROM e UNION ALL SELECT num, subpages, canonical FROM e WHERE canonical IS NOT NULL),
v AS (SELECT num, subpages, lower(substr(base, 1, 1)) || substr(base, 2) AS name FROM s
  UNION SELECT num, subpages, upper(substr(base, 1, 1)) || substr(base, 2) FROM s)
SELECT num, name, subpages AS allowed_subpages, num IN (SELECT num FROM m) AS mirrored FROM v""")
def namespace_dim(spark, sf_dir):
    supplier = views.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    shared = [key.alias("num"), (key % 5 == 0).alias("subpages"), (key % 4 == 0).alias("content")]
    names = supplier.select(
        *shared, (key * 2).alias("seq"), F.lit(False).alias("is_alias"),
        F.when(key == 8, F.lit("Story")).otherwise(F.concat(F.lit("space "), key)).alias("name"),
        F.when(key % 2 == 0, F.concat(F.lit("Canon "), key)).alias("canonical"),
    )
    aliases = supplier.filter(key % 3 == 0).select(
        *shared, (key * 2 + 1).alias("seq"), F.lit(True).alias("is_alias"), F.concat(F.lit("alias "), key).alias("name"),
        F.lit(None).cast("string").alias("canonical"),
    )
    return ops.namespace_dimension(names.unionByName(aliases), add=[3, 7])


@QUERIES.add("SELECT doc_id, source AS contentmodel FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filter_no_revision(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pages = views.table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn(
        "revisions", F.when(F.col("quality").isNotNull(), F.array(F.struct(F.col("n_chars").alias("revid")))).otherwise(F.array()))
    return ops.with_revision(pages).select("doc_id", F.col("source").alias("contentmodel"))


@QUERIES.add("SELECT doc_id, contentmodel FROM (SELECT doc_id, CASE WHEN source = 'src0' THEN 'wikitext' ELSE source END AS contentmodel FROM documents) "
             "WHERE contentmodel IN ('wikitext', 'src3', 'src5')")
def filter_content_model(spark, sf_dir):
    pages = views.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("source") == "src0", F.lit("wikitext")).otherwise(F.col("source")).alias("contentmodel"))
    return ops.with_content_model(pages, ["src3", "src5"])


@QUERIES.add(with_views("pages", body="""
ig AS (SELECT replace(heading, ' ', '_') AS t FROM v_pages WHERE lang = 'de' UNION SELECT heading FROM v_pages WHERE lang = 'es')
SELECT page_id, heading AS title FROM v_pages WHERE heading NOT IN (SELECT t FROM ig) AND replace(heading, ' ', '_') NOT IN (SELECT t FROM ig)"""))
def filter_ignored(spark, sf_dir):
    pages = views.pages(spark, sf_dir).select("page_id", "lang", F.col("heading").alias("title"))
    ignored = pages.filter("lang = 'de'").select(F.replace("title", F.lit(" "), F.lit("_")).alias("title")).unionByName(
        pages.filter("lang = 'es'").select("title"))
    return ops.without_ignored(pages, ignored).drop("lang")


@QUERIES.add("""
WITH r AS (SELECT doc_id, doc_id % 4 AS ns, 'Alias ' || i || ' of ' || doc_id AS ref, (doc_id + i) % 5 AS ref_ns FROM documents, range(3) t(i))
SELECT doc_id, ref, ref_ns FROM r WHERE ref_ns = ns OR ref_ns IN (0, 2)""")
def redirect_scope(spark, sf_dir):
    refs = F.array(*[F.struct(F.concat(F.lit(f"Alias {i} of "), "doc_id").alias("title"), ((F.col("doc_id") + i) % 5).alias("ns")) for i in range(3)])
    pages = views.documents(spark, sf_dir).select("doc_id", "ns", refs.alias("redirects"))
    kept = pages.select("doc_id", F.inline(ops.scoped_redirects(F.col("redirects"), F.col("ns"), [0, 2])))
    return kept.select("doc_id", F.col("title").alias("ref"), F.col("ns").alias("ref_ns"))


def _records(spark, sf_dir):
    d = F.col("doc_id")
    return views.documents(spark, sf_dir).select(
        "title", "ns", F.when(F.col("contentmodel") == "src0", F.lit("wikitext")).otherwise(F.col("contentmodel")).alias("contentmodel"),
        F.array(F.struct(F.col("revid"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))).alias("revisions"),
        F.when(d % 3 == 0, F.array(F.struct((d % 90 + 0.5).alias("lat"), (d % 180).cast("double").alias("lon")))).alias("coordinates"),
        F.array(F.struct(F.concat(F.lit("Category:Lang:"), "lang").alias("title")), F.struct(F.concat(F.lit("Category:"), "contentmodel").alias("title"))).alias("categories"),
        F.when(d % 2 == 0, F.struct(F.concat(F.lit("https://img.example.org/a/ab/"), d, F.lit(".png")).alias("source"))).alias("thumbnail"),
        F.when(d % 5 == 0, F.struct(F.col("revid").cast("int").alias("size"))).alias("categoryinfo"),
        F.when(d % 10 == 0, F.create_map(F.lit("nogallery"), F.lit(""))).alias("pageprops"),
        F.struct(F.when(d % 7 == 0, d).alias("stable_revid")).alias("flagged"),
        F.lit(None).cast("boolean").alias("missing"), F.col("lang").alias("pagelanguagehtmlcode"), F.lit("ltr").alias("pagelanguagedir"),
    )


@QUERIES.add("""
SELECT 'Doc ' || doc_id AS title, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 4 END AS ns, CASE WHEN source <> 'src0' THEN source END AS contentmodel,
  n_chars AS revision_id, CASE WHEN doc_id % 7 = 0 AND doc_id <> 0 THEN doc_id END AS stable_revision_id,
  CASE WHEN doc_id % 3 = 0 THEN (doc_id % 90) || '.5;' || (doc_id % 180) END AS coordinates, 'Lang:' || lang || '|' || source AS categories,
  CASE WHEN doc_id % 2 = 0 THEN 'https://img.example.org/a/ab/' || doc_id || '.png' END AS thumbnail,
  CASE WHEN doc_id % 5 = 0 THEN doc_id % 10 = 0 END AS nogallery, lang AS pagelang FROM documents""")
def catalogue_project(spark, sf_dir):
    return ops.catalogue_rows(_records(spark, sf_dir)).select(
        "title", "ns", "contentmodel", "revision_id", "stable_revision_id", "coordinates", F.array_join("categories", "|").alias("categories"),
        F.col("thumbnail.source").alias("thumbnail"), F.col("categoryinfo.nogallery").alias("nogallery"), "pagelang")


@QUERIES.add("""
SELECT 'Doc ' || doc_id AS title, CASE WHEN doc_id % 7 = 0 AND doc_id <> 0 THEN doc_id END AS oldid,
  CASE WHEN source = 'src0' THEN '0' ELSE '' END AS section_id FROM documents""")
def stable_revision(spark, sf_dir):
    return ops.render_request(ops.catalogue_rows(_records(spark, sf_dir)), stable=True, lead_only=True).select("title", "oldid", "section_id")


@QUERIES.add("""
SELECT user_id AS source, max(event_id) AS event_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS duration
FROM events GROUP BY user_id""")
def catalogue_upsert(spark, sf_dir):
    return ops.upsert(views.fetch_log(spark, sf_dir).select("source", "event_id", "kind", "duration"), "source", "event_id")


@QUERIES.add(with_views("pages", body="""
SELECT DISTINCT target AS title FROM v_links
WHERE target NOT IN (SELECT title FROM v_titles) AND target NOT IN (SELECT lower(title) FROM v_titles)"""))
def main_page_check(spark, sf_dir):
    pages = views.page_titles(spark, sf_dir)
    redirects = pages.select(F.lower("title").alias("from_title"))
    required = views.page_links(spark, sf_dir).select(F.col("target").alias("title"))
    return ops.missing_titles(required, pages, redirects)


@QUERIES.add(with_views("pages", body="""
t AS (SELECT page_id, page_id % 3 AS ns, CASE page_id % 4 WHEN 0 THEN 'Talk:' || title || '/x' WHEN 1 THEN 'User:' || title || '/x'
  WHEN 2 THEN title || '/x' ELSE 'Foo:' || title END AS title FROM v_pages)
SELECT page_id, title, title LIKE '%/%' AND title LIKE 'Talk:%' AS is_subpage, CASE ns WHEN 0 THEN '' WHEN 1 THEN 'Talk' ELSE 'User' END AS ns_name FROM t"""))
def subpage_flag(spark, sf_dir):
    word = F.col("title")
    k = F.col("page_id") % 4
    pages = views.pages(spark, sf_dir).select("page_id", (F.col("page_id") % 3).cast("int").alias("num"), F.when(k == 0, F.concat(F.lit("Talk:"), word, F.lit("/x")))
                                              .when(k == 1, F.concat(F.lit("User:"), word, F.lit("/x")))
                                              .when(k == 2, F.concat(word, F.lit("/x"))).otherwise(F.concat(F.lit("Foo:"), word)).alias("title"))
    spaces = small_table(spark, ["name", "num", "allowed_subpages"], [("", 0, False), ("Talk", 1, True), ("User", 2, False)])
    return ops.subpage_flags(pages, spaces).join(ops.namespace_names(spaces), "num", "left").drop("num")
