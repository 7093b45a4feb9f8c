"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.operators import quality as ops
from corpusweave.queries import Family
from corpusweave.sources import batches, views
from corpusweave.sources.views import with_views

QUERIES = Family()

_RULE_SQL = """
q AS (SELECT *, 'P' || event_id AS title, CASE k % 20 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 19 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 7 WHEN 6 THEN 8 WHEN 7 THEN 9 WHEN 8 THEN 10
  WHEN 9 THEN 11 WHEN 10 THEN 12 WHEN 11 THEN 13 WHEN 12 THEN 14 WHEN 13 THEN 15 WHEN 15 THEN 17 END AS rule_no FROM v_fetch WHERE failed),
rt AS (SELECT *, CASE WHEN rule_no IS NULL THEN 'fatal' WHEN rule_no <= 5 THEN 'soft' ELSE 'hard' END AS route FROM q)"""


def _failures(spark, sf_dir):
    return views.fetch_log(spark, sf_dir).filter("failed").withColumn("title", F.concat(F.lit("P"), "event_id"))


@QUERIES.add(with_views("fetch", body=_RULE_SQL + """
SELECT event_id, CAST(rule_no AS BIGINT) AS rule_no, rule_no > 5 AS hard, CASE rule_no WHEN 1 THEN 'DELETED_PAGE' WHEN 2 THEN 'DELETED_PAGE' WHEN 3 THEN 'DELETED_PAGE' WHEN 4 THEN 'PERMISSION_DENIED'
  WHEN 5 THEN 'CATEGORY_LOCKDOWN' WHEN 6 THEN 'CLIENT_SIDE_TIMEOUT' WHEN 7 THEN 'ACTION_PARSE_UPSTREAM_TIMEOUT' WHEN 8 THEN 'ACTION_PARSE_HTML_503_ERROR' WHEN 9 THEN 'ACTION_PARSE_BAD_REVISION_ERROR'
  WHEN 10 THEN 'ACTION_PARSE_UNREACHABLE_EXCEPTION_ERROR' WHEN 11 THEN 'ACTION_PARSE_INVARIANT_EXCEPTION_ERROR' WHEN 12 THEN 'ACTION_PARSE_PARSOID_RESOURCE_LIMIT_EXCEEDED'
  WHEN 13 THEN 'ACTION_PARSE_GENERIC_INTERNAL_API_ERROR' WHEN 14 THEN 'ACTION_PARSE_INVALID_ARGUMENT_EXCEPTION_ERROR' WHEN 15 THEN 'ACTION_PARSE_INTERNAL_API_TYPE_ERROR'
  WHEN 17 THEN 'ACTION_PARSE_EMPTY_500_RESPONSE' END AS message FROM q"""))
def error_first_rule(spark, sf_dir):
    return ops.with_first_rule(_failures(spark, sf_dir)).select("event_id", "rule_no", "message", "hard")


@QUERIES.add(with_views("fetch", body=_RULE_SQL + " SELECT title, route, CASE WHEN route <> 'fatal' THEN title END AS entry_path FROM rt"))
def failure_route(spark, sf_dir):
    return ops.route_failures(_failures(spark, sf_dir)).select("title", "route", "entry_path")


@QUERIES.add(with_views("fetch", body=_RULE_SQL + " SELECT 'P' || event_id AS title FROM v_fetch WHERE NOT failed OR event_id IN (SELECT event_id FROM rt WHERE route = 'fatal')"))
def failure_survivors(spark, sf_dir):
    pages = views.fetch_log(spark, sf_dir).select(F.concat(F.lit("P"), "event_id").alias("title"))
    return ops.surviving_pages(pages, ops.route_failures(_failures(spark, sf_dir)))


@QUERIES.add(with_views("fetch", body=_RULE_SQL + """
SELECT n AS pages, h AS hard, greatest(5, n // 100000) AS allowed, h > greatest(5, n // 100000) AS exceeded
FROM (SELECT (SELECT count(*) FROM events) AS n, (SELECT count(*) FROM rt WHERE route = 'hard') AS h)"""))
def page_budget(spark, sf_dir):
    return ops.page_budget(views.table(spark, sf_dir, "events").select("event_id"), ops.route_failures(_failures(spark, sf_dir)))


@QUERIES.add("""
SELECT user_id % 5 AS host, count(*) AS files, count(*) FILTER (event_type = 'error') AS fails,
  count(*) FILTER (event_type = 'error') > 50 AND count(*) FILTER (event_type = 'error') * 10000.0 / count(*) > 10 AS exceeded FROM events GROUP BY user_id % 5""")
def file_budget(spark, sf_dir):
    log = views.fetch_log(spark, sf_dir).select((F.col("source") % 5).alias("host"), "failed")
    return ops.file_budget(log, "failed", ["host"])


@QUERIES.add(with_views("fetch", body="""
SELECT event_id, CASE WHEN error_code = 'ERR_CANCELED' THEN 'transport' WHEN api_code = 'maxlag' THEN 'lag' WHEN http IN (429, 500, 502, 503, 504, 524) THEN 'http'
  WHEN k % 20 IN (5, 11, 12, 13, 19) THEN 'api' END AS reason FROM v_fetch WHERE failed"""))
def retry_class(spark, sf_dir):
    return _failures(spark, sf_dir).select("event_id", ops.retry_reason().alias("reason"))


@QUERIES.add(with_views("fetch", body="""
a AS (SELECT event_id, failed, http, error_code, row_number() OVER (PARTITION BY source ORDER BY event_id) AS attempt FROM v_fetch)
SELECT event_id, attempt, CASE WHEN NOT failed THEN 'done' WHEN (http IS NULL AND error_code IS NULL) OR coalesce(http = 404, FALSE) OR attempt > 5 THEN 'given up' ELSE 'retry' END AS outcome FROM a"""))
def attempt_outcome(spark, sf_dir):
    log = views.fetch_log(spark, sf_dir).select("event_id", "source", "failed", "http", "error_code")
    return ops.attempt_outcomes(log, "source", "event_id").select("event_id", "attempt", "outcome")


@QUERIES.add(with_views("fetch", body=_RULE_SQL + """
, p AS (SELECT source % 3 AS variant, count(*) FILTER (NOT failed) AS pages_ok FROM v_fetch GROUP BY 1),
s AS (SELECT source % 3 AS variant, count(*) FILTER (route = 'hard') AS pages_hard, count(*) FILTER (route = 'soft') AS pages_soft FROM rt GROUP BY 1),
f AS (SELECT source % 3 AS variant, count(*) FILTER (kind <> 'click') AS files_ok, count(*) FILTER (kind = 'click') AS files_fail FROM v_fetch GROUP BY 1),
r AS (SELECT source % 3 AS variant, count(*) FILTER (k % 2 = 0) AS redirects_written, count(*) FILTER (k % 2 <> 0) AS redirects_ignored FROM v_fetch WHERE kind = 'view' GROUP BY 1)
SELECT variant, pages_ok, pages_hard, pages_soft, files_ok, files_fail, redirects_written, redirects_ignored FROM p JOIN s USING (variant) JOIN f USING (variant) JOIN r USING (variant)"""))
def run_status(spark, sf_dir):
    log = views.fetch_log(spark, sf_dir).withColumn("variant", F.col("source") % 3).withColumn("title", F.concat(F.lit("P"), "event_id"))
    ok = log.filter("NOT failed").select("variant", F.lit(None).cast("string").alias("route"))
    pages = ok.unionByName(ops.route_failures(log.filter("failed")).select("variant", "route"))
    files = log.select("variant", (F.col("kind") != "click").alias("ok"))
    redirects = log.filter("kind = 'view'").select("variant", (F.col("k") % 2 == 0).alias("written"))
    return ops.run_status(pages, files, redirects)


@QUERIES.add("""
WITH r AS (SELECT event_type <> 'error' AS ok, row_number() OVER (ORDER BY event_id) AS done, count(*) OVER () AS total FROM events),
s AS (SELECT done, (done * 2000 + total) // (total * 2) AS tenths FROM r WHERE done % 10 = 0 AND done >= (SELECT min(done) FROM r WHERE ok)),
t AS (SELECT *, lag(tenths) OVER (ORDER BY done) AS before FROM s)
SELECT done, tenths / 10 AS percent FROM t WHERE before IS NULL OR before <> tenths""")
def progress_steps(spark, sf_dir):
    return ops.progress_steps(views.fetch_log(spark, sf_dir).select("event_id", (~F.col("failed")).alias("ok")), "event_id", "ok")


_META_SQL = """
m AS (SELECT p_partkey AS k, p_size AS z, CASE WHEN p_partkey % 17 <> 0 THEN repeat('e' || chr(769), p_size) END AS title, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE repeat('x', p_size * 2) END AS descr,
  CASE p_size % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'eng,fra' WHEN 2 THEN 'en' ELSE 'deu' END AS lang, CASE WHEN p_partkey % 13 = 0 THEN '2024-1-1' WHEN p_partkey % 13 = 1 THEN '2024-01-011' ELSE '2024-01-01' END AS dt,
  p_partkey % 11 = 0 AS badpng FROM part)"""


@QUERIES.add("WITH " + _META_SQL.strip() + r"""
SELECT k AS p_partkey, CASE WHEN title IS NULL THEN 'Metadata "Title" is required' WHEN descr = '' THEN 'Metadata "Description" is required' WHEN length_grapheme(descr) > 80 THEN 'MetaData Description: must NOT have more than 80 graphemes'
  WHEN lang = 'en' THEN 'MetaData Language: must match pattern "^\w{3}(,\w{3})*$"' WHEN length_grapheme(title) > 30 THEN 'MetaData Title: must NOT have more than 30 graphemes'
  WHEN length(dt) > 10 THEN 'MetaData Date: must NOT have more than 10 characters' WHEN length(dt) < 10 THEN 'Metadata "Date" is required'
  WHEN badpng THEN 'MetaData Illustration_48x48@1: must match regex pattern' END AS violation FROM m""")
def metadata_check(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    sets = views.table(spark, sf_dir, "part").select(
        "p_partkey", F.lit(None).cast("string").alias("Name"), F.lit("c").alias("Creator"),
        F.when(k % 19 == 0, F.lit("")).otherwise(F.repeat(F.lit("x"), z * 2)).alias("Description"),
        F.when(z % 4 == 0, "eng").when(z % 4 == 1, "eng,fra").when(z % 4 == 2, "en").otherwise("deu").alias("Language"), F.lit("p").alias("Publisher"),
        F.when(k % 17 != 0, F.repeat(F.lit("é"), z)).alias("Title"),
        F.when(k % 13 == 0, "2024-1-1").when(k % 13 == 1, "2024-01-011").otherwise("2024-01-01").alias("Date"),
        F.unhex(F.when(k % 11 == 0, F.lit("89504E470D0A1A0A")).otherwise(F.lit("89504E470D0A1A0A00"))).alias("Illustration_48x48@1"),
        F.lit(None).cast("string").alias("LongDescription"))
    return sets.select("p_partkey", ops.metadata_violation().alias("violation"))


@QUERIES.add(with_views("fetch", body="SELECT source, k AS cursor, count(*) AS times FROM v_fetch GROUP BY source, k HAVING count(*) > 1"))
def cursor_cycles(spark, sf_dir):
    return batches.repeated_cursors(views.fetch_log(spark, sf_dir).select("source", F.col("k").alias("cursor")), "source", "cursor")


@QUERIES.add("""
WITH e AS (SELECT user_id AS source, epoch_us(ts) AS us FROM events),
l AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY source ORDER BY us) > 43200000000 OR lag(us) OVER (PARTITION BY source ORDER BY us) IS NULL THEN 1 ELSE 0 END AS new FROM e),
n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY source ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l)
SELECT source, session, min(us) AS start, max(us) AS "end", count(*) AS events FROM n GROUP BY source, session""")
def stall_sessions(spark, sf_dir):
    log = views.fetch_log(spark, sf_dir).select("source", F.unix_micros("ts").alias("us"))
    return ops.silence_sessions(log, "source", "us", 12 * 3600 * 1_000_000)
