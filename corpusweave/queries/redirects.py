"""Redirect queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.functions.text import truncate_words
from corpusweave.operators import redirects as ops
from corpusweave.queries import Family
from corpusweave.sources import views
from corpusweave.sources.views import with_views

QUERIES = Family()


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@QUERIES.add("""
WITH r AS (SELECT doc_id, i, 'Alias ' || (doc_id // 2 * (i + 1)) AS from_title, 'Doc ' || doc_id AS to_title,
             CASE WHEN i = 1 THEN 'Part ' || (doc_id % 7) ELSE '' END AS fragment FROM documents, range(2) t(i))
SELECT from_title, arg_max(to_title, doc_id * 2 + i) AS to_title, arg_max(fragment, doc_id * 2 + i) AS fragment FROM r GROUP BY from_title""")
def redirect_explode(spark, sf_dir):
    d = F.col("doc_id")
    half = F.floor(d / 2)
    refs = F.array(
        F.struct(_cat("Alias ", half).alias("title"), F.lit(None).cast("string").alias("fragment")),
        F.struct(_cat("Alias ", half * 2).alias("title"), _cat("Part ", d % 7).alias("fragment")),
    )
    return ops.explode_redirects(views.documents(spark, sf_dir).select("doc_id", "title", refs.alias("redirects")), "doc_id")


@QUERIES.add("""
WITH r AS (SELECT doc_id, 'Doc ' || doc_id AS page, CASE WHEN doc_id % 10 = 5 THEN 'Doc ' || (doc_id - 1) ELSE 'Alias ' || (doc_id // 3) END AS ref,
             'Part ' || (doc_id % 7) AS fragment FROM documents),
m AS (SELECT *, ref IN (SELECT page FROM r) AS clash FROM r),
t AS (SELECT doc_id, CASE WHEN clash THEN page ELSE ref END AS f, CASE WHEN clash THEN ref ELSE page END AS t, CASE WHEN clash THEN '' ELSE fragment END AS g FROM m)
SELECT 'redirect' AS kind, f AS from_title, arg_max(t, doc_id) AS to_title, arg_max(g, doc_id) AS fragment FROM t GROUP BY f
UNION ALL SELECT DISTINCT 'removed', page, '', '' FROM m WHERE clash""")
def redirect_conflict(spark, sf_dir):
    d = F.col("doc_id")
    ref = F.when(d % 10 == 5, _cat("Doc ", d - 1)).otherwise(_cat("Alias ", F.floor(d / 3)))
    pages = views.documents(spark, sf_dir).select(
        "doc_id", "title", F.array(F.struct(ref.alias("title"), _cat("Part ", d % 7).alias("fragment"))).alias("redirects"))
    redirects, removed = ops.swap_conflicts(pages, "doc_id")
    gone = removed.select(F.lit("removed").alias("kind"), F.col("title").alias("from_title"), F.lit("").alias("to_title"), F.lit("").alias("fragment"))
    return redirects.select(F.lit("redirect").alias("kind"), "from_title", "to_title", "fragment").unionByName(gone)


@QUERIES.add(with_views("docs", body="""
f AS (SELECT doc_id, title AS from_title, CASE WHEN doc_id % 3 = 0 THEN 'Doc ' || (doc_id + 1) ELSE 'Moved ' || (doc_id // 2) END AS to_title FROM v_docs)
SELECT to_title AS from_title, arg_min(from_title, doc_id) AS to_title, '' AS fragment FROM f
WHERE to_title NOT IN (SELECT title FROM v_docs WHERE doc_id = first_id) AND to_title NOT IN (SELECT from_title FROM v_refs) GROUP BY to_title"""))
def redirect_moved(spark, sf_dir):
    d = F.col("doc_id")
    copies = views.text_copies(spark, sf_dir)
    fetched = copies.select("doc_id", F.col("title").alias("from_title"),
                            F.when(d % 3 == 0, _cat("Doc ", d + 1)).otherwise(_cat("Moved ", F.floor(d / 2))).alias("to_title"))
    return ops.moved_back(fetched, copies.filter("doc_id = first_id"), views.redirect_refs(copies), "doc_id")


@QUERIES.add(with_views("fetch", body="""
n AS (SELECT source, arg_max(event_id, event_id) AS event_id, arg_max(k, event_id) AS k FROM v_fetch GROUP BY source)
SELECT 'User ' || source AS title, 'Target ' || event_id AS target FROM n WHERE k % 3 <> 0 AND k % 2 = 0"""))
def move_log_lookup(spark, sf_dir):
    target = F.when(F.col("k") % 3 != 0, F.create_map(F.lit("target_title"), _cat("Target ", F.col("event_id")))).otherwise(F.create_map().cast("map<string,string>"))
    flag = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("suppressredirect"), F.lit(""))).otherwise(F.create_map().cast("map<string,string>"))
    log = views.fetch_log(spark, sf_dir).select(_cat("User ", F.col("source")).alias("title"), "event_id", F.map_concat(target, flag).alias("params"))
    return ops.usable_moves(log, [F.col("event_id")])


_CASES_SQL = """
pg AS (SELECT title FROM v_docs WHERE doc_id = first_id AND ns IN (0, 2)),
rd AS (SELECT from_title, to_title, fragment FROM v_refs
  UNION ALL SELECT 'Loop ' || doc_id, 'Loop ' || doc_id, '' FROM v_docs
  UNION ALL SELECT title, 'Doc 0', '' FROM v_docs WHERE doc_id = first_id
  UNION ALL SELECT 'Alias ' || doc_id, title, CASE WHEN doc_id % 2 = 1 THEN 'My part' ELSE '' END FROM v_docs),
jd AS (SELECT *, CASE WHEN from_title IN (SELECT title FROM pg) THEN 'source is a page' WHEN from_title = to_title THEN 'points to itself'
  WHEN to_title NOT IN (SELECT title FROM pg) THEN 'target is not a page' ELSE 'written' END AS reason FROM rd)"""


def _cases(spark, sf_dir):
    """Pages, and redirects of every admissible and inadmissible kind."""
    d = F.col("doc_id")
    docs = views.text_copies(spark, sf_dir)
    pages = docs.filter("doc_id = first_id AND ns IN (0, 2)").select("title")
    shape = ["from_title", "to_title", "fragment"]
    title, first = F.col("title"), F.col("first_id")

    def case(source, target, fragment):
        return F.struct(*[value.alias(name) for name, value in zip(shape, (source, target, fragment), strict=True)])

    part = F.when(d % 2 == 1, _cat("Part ", d % 7)).otherwise(F.lit(""))
    cases = F.array_compact(F.array(
        F.when(d > first, case(title, _cat("Doc ", first), part)),
        case(_cat("Loop ", d), _cat("Loop ", d), F.lit("")),
        F.when(d == first, case(title, F.lit("Doc 0"), F.lit(""))),
        case(_cat("Alias ", d), title, F.when(d % 2 == 1, F.lit("My part")).otherwise(F.lit(""))),
    ))
    redirects = docs.select("doc_id", "first_id", "title").select(F.inline(cases))
    return pages, redirects


@QUERIES.add(with_views("docs", body=_CASES_SQL + " SELECT from_title, to_title, fragment FROM jd WHERE reason = 'written'"))
def redirect_admit(spark, sf_dir):
    pages, redirects = _cases(spark, sf_dir)
    return ops.admitted(redirects, pages)


@QUERIES.add(with_views("docs", body=_CASES_SQL + """
, v AS (SELECT * FROM (VALUES ('full', FALSE), ('lead', TRUE)) x(variant, lead))
SELECT variant, replace(from_title, ' ', '_') AS path, from_title AS title,
  CASE WHEN fragment <> '' AND lead THEN 'ignored' WHEN fragment <> '' THEN 'stub' ELSE 'redirect' END AS route,
  replace(to_title, ' ', '_') || CASE WHEN fragment <> '' THEN '#' || replace(fragment, ' ', '_') ELSE '' END AS target
FROM jd, v WHERE reason = 'written'"""))
def redirect_route(spark, sf_dir):
    pages, redirects = _cases(spark, sf_dir)
    written = ops.admitted(redirects, pages)
    variants = F.array(*[F.struct(F.lit(name).alias("variant"), F.lit(lead).alias("lead")) for name, lead in (("full", False), ("lead", True))])
    return ops.routed(written.select("*", F.inline(variants)), F.col("lead"), ["variant"])


@QUERIES.add(with_views("docs", body=_CASES_SQL + """
SELECT CASE WHEN reason = 'written' AND fragment <> '' THEN 'ignored' ELSE reason END AS reason, count(*) AS redirects FROM jd GROUP BY 1"""))
def redirect_report(spark, sf_dir):
    pages, redirects = _cases(spark, sf_dir)
    return ops.report(ops.judge(redirects, pages, lead_only=True))


@QUERIES.add(with_views("pages", body="""
w AS (SELECT page_id, repeat(replace(heading, ' ', ''), 8) || ' ' || heading AS t FROM v_pages),
p AS (SELECT page_id, t, string_split(t, ' ') AS arr FROM w),
c AS (SELECT page_id, list_transform(arr, lambda x: CASE WHEN strlen(x) <= 240 THEN x ELSE
  substr(x, 1, list_max(list_filter(range(0, 241), lambda n: strlen(substr(x, 1, n)) <= 240))) END) AS arr FROM p)
SELECT page_id, array_to_string(arr, ' ') AS title, strlen(arr[1]) AS first_bytes FROM c"""))
def title_truncate(spark, sf_dir):
    long = F.concat(F.repeat(F.replace("heading", F.lit(" "), F.lit("")), F.lit(8)), F.lit(" "), F.col("heading"))
    out = views.pages(spark, sf_dir).select("page_id", truncate_words(long).alias("title"))
    return out.withColumn("first_bytes", F.octet_length(F.split("title", " ")[0]).cast("long"))
