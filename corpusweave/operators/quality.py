"""Failures, retries, budgets, progress and metadata checks over a fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave import constants as c
from corpusweave.functions.text import title_path
from corpusweave.plans.keyed import missing_from
from corpusweave.plans.ranks import rank_in_group
from corpusweave.session import cut


# --- run checks ------------------------------------------------------------------------------------

def require_empty(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Stop the run if there is any violation; only a few rows are brought to the driver, for the message."""
    rows = violations.limit(shown).collect()
    if rows:
        raise ValueError(f"{message}: " + "; ".join(str(r.asDict()) for r in rows))


# --- first matching rule ---------------------------------------------------------------------------

def _json_at(body: Column, dotted: str) -> Column:
    """Value at a path of literal keys (a ``*`` is a key like any other)."""
    path = "$" + "".join(f"['{step}']" for step in dotted.split("."))
    # get_json_object would read ['*'] as a wildcard
    return F.try_variant_get(F.try_parse_json(body), path, "string") if "*" in dotted else F.get_json_object(body, path)


def _path_column(dotted: str) -> str:
    return f"__json {dotted}"


def _rule_holds(rule: c.ErrorRule) -> Column:
    holds = [F.lit(True)]
    if rule.url:
        holds.append(F.col("url").contains(rule.url))
    if rule.error_code:
        holds.append(F.col("error_code").contains(rule.error_code))
    if rule.http:
        holds.append(F.col("http").isin(*rule.http))
    if rule.content_type:
        holds.append(F.lower("content_type").contains(rule.content_type.lower()))
    if rule.empty_body:
        holds.append(F.col("raw_body") == "")
    if rule.raw_text:
        holds.append(F.col("raw_body").contains(rule.raw_text))
    if rule.json_path:
        holds.append(F.col(f"`{_path_column(rule.json_path)}`").contains(rule.json_text))
    out = holds[0]
    for h in holds[1:]:
        out = out & h
    return F.coalesce(out, F.lit(False))


def with_first_rule(failures: DataFrame) -> DataFrame:
    """Adds rule_no, message and hard of the first rule that holds (null: none). The rules compile to one CASE.

    ``failures``: url, error_code, http, content_type, raw_body (text responses), json_body (JSON responses).
    """
    number = F.coalesce(*[F.when(_rule_holds(rule), F.lit(n + 1)) for n, rule in enumerate(c.ERROR_RULES)])
    messages = F.array(*[F.lit(rule.message) for rule in c.ERROR_RULES])
    hard = F.array(*[F.lit(rule.hard) for rule in c.ERROR_RULES])
    # each JSON path is read once per row, however many rules look at it
    paths = sorted({rule.json_path for rule in c.ERROR_RULES if rule.json_path})
    read = failures.withColumns({_path_column(p): _json_at(F.col("json_body"), p) for p in paths})
    # a filter on the verdict must not be pushed below it, or every rule would be evaluated twice
    marked = read.select(*failures.columns, F.explode(F.array(number.cast("long"))).alias("rule_no"))
    at = (F.col("rule_no") - 1).cast("int")
    return marked.withColumns({"message": F.get(messages, at), "hard": F.get(hard, at)})


def route_failures(failures: DataFrame) -> DataFrame:
    """Adds route (fatal, hard, soft) and entry_path of the placeholder; ``title`` names the page. Fatal ends the run."""
    route = F.when(F.col("rule_no").isNull(), "fatal").when(F.col("hard"), "hard").otherwise("soft")
    return with_first_rule(failures).withColumn("route", route).withColumn(
        "entry_path", F.when(F.col("route") != "fatal", title_path("title")))


def surviving_pages(pages: DataFrame, routed: DataFrame) -> DataFrame:
    """Pages that still count as catalogued: failed ones go, so that no link leads to a placeholder."""
    return missing_from(pages, routed.filter("route <> 'fatal'"), ["title"])


# --- budgets and retries ---------------------------------------------------------------------------

def page_budget(pages: DataFrame, routed: DataFrame) -> DataFrame:
    """One row: pages, hard, allowed, exceeded."""
    counts = pages.select(F.lit(1).alias("page"), F.lit(0).alias("bad")).unionByName(
        routed.filter("route = 'hard'").select(F.lit(0).alias("page"), F.lit(1).alias("bad")))
    totals = counts.agg(F.coalesce(F.sum("page"), F.lit(0)).alias("pages"), F.coalesce(F.sum("bad"), F.lit(0)).alias("hard"))
    return pages_over_budget(totals)


def pages_over_budget(totals: DataFrame) -> DataFrame:
    """Adds allowed and exceeded to counts of pages and hard failures."""
    allowed = F.greatest(F.lit(c.PAGE_FAILURES_FLOOR).cast("long"), F.floor(F.col("pages") / c.PAGES_PER_ALLOWED_FAILURE).cast("long"))
    return totals.withColumn("allowed", allowed).withColumn("exceeded", F.col("hard") > F.col("allowed"))


def files_over_budget(total: Column, fails: Column) -> Column:
    return (total > 0) & (fails > c.FILE_FAILURES_BEFORE_CHECK) & (fails * 10000 / total > c.FILE_FAILURES_PER_TEN_THOUSAND)


def file_budget(attempts: DataFrame, failed: str, by: list[str] | None = None) -> DataFrame:
    totals = attempts.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("files"), F.count_if(failed).alias("fails"))
    return totals.withColumn("exceeded", files_over_budget(F.col("files"), F.col("fails")))


def retry_reason() -> Column:
    """Why a failed request is tried again (transport, lag, http, api), or null if it is not."""
    api = _json_at(F.col("json_body"), "error.code")
    return (
        F.when(F.col("error_code").isNotNull() & ~F.col("error_code").isin(*c.TRANSPORT_CODES_NOT_RETRIED), "transport")
        .when(api == "maxlag", "lag").when(F.col("http").isin(*c.RETRIED_HTTP_CODES), "http")
        .when(api.isNotNull() & ~api.isin(*c.API_CODES_NOT_RETRIED), "api")
    )


def attempt_outcomes(attempts: DataFrame, file: str, order: str) -> DataFrame:
    """Adds attempt (per file) and outcome: done, retry or given up. A file may have any number of attempts."""
    ranked = rank_in_group(attempts, [file], [order], rank="attempt")
    transport = F.col("http").isNotNull() | F.col("error_code").isNotNull()
    ends = ~transport | (F.col("http") == 404) | (F.col("attempt") > c.FILE_MAX_ATTEMPTS)
    return ranked.withColumn("outcome", F.when(~F.col("failed"), "done").when(F.coalesce(ends, F.lit(False)), "given up").otherwise("retry"))


# --- status and progress ---------------------------------------------------------------------------

def run_status(pages: DataFrame, files: DataFrame, redirects: DataFrame) -> DataFrame:
    """Counters per variant. ``pages``: variant, route (null = success); ``files``: variant, ok; ``redirects``: variant, written.

    The three logs are counted apart and then joined, so no log is multiplied by another. The names of
    failed pages stay rows of ``pages``; they are not gathered into one list.
    """
    p = pages.groupBy("variant").agg(
        F.count_if(F.col("route").isNull()).alias("pages_ok"), F.count_if(F.col("route") == "hard").alias("pages_hard"),
        F.count_if(F.col("route") == "soft").alias("pages_soft"))
    f = files.groupBy("variant").agg(F.count_if("ok").alias("files_ok"), F.count_if(~F.col("ok")).alias("files_fail"))
    r = redirects.groupBy("variant").agg(F.count_if("written").alias("redirects_written"), F.count_if(~F.col("written")).alias("redirects_ignored"))
    return p.join(f, "variant", "full").join(r, "variant", "full").fillna(0)


def progress_steps(work: DataFrame, order: str, ok: str, every: int = 10) -> DataFrame:
    """done, percent (one decimal) after every ``every`` finished items, only where the percentage moved.

    Nothing is reported before the first success.
    """
    ranked = cut(rank_in_group(work.select(order, ok), [], [order], rank="done", total="total"))
    first_ok = ranked.filter(F.col(ok)).agg(F.min("done")).first()[0]
    if first_ok is None:
        first_ok = (1 << 63) - 1

    def tenths(done: Column) -> Column:
        return F.floor((done * 2000 + F.col("total")) / (F.col("total") * 2))

    steps = ranked.filter(F.col("done") % every == 0).filter(F.col("done") >= F.lit(first_ok))
    moved = (F.col("done") - every < F.lit(first_ok)) | (tenths(F.col("done")) != tenths(F.col("done") - every))
    return steps.filter(moved).select("done", (tenths(F.col("done")) / 10).alias("percent"))


# --- metadata --------------------------------------------------------------------------------------

def metadata_violation(has: Column | None = None) -> Column:
    """First violated metadata rule as a message, null if all hold. Expects the metadata keys as columns.

    Missing keys come first, in the order of the required list; then the keys in schema order.
    """
    text = c.METADATA_MESSAGES
    required = [F.when(F.col(f"`{k}`").isNull(), F.lit(text["required"].format(key=k))) for k in c.METADATA_REQUIRED]
    checks: list[Column] = []
    for key in ("Name", "Creator", "Description", "Language", "Publisher", "Title", "Date", "Illustration_48x48@1", "LongDescription"):
        value = F.col(f"`{key}`")
        if key in c.METADATA_MIN_ONE:
            checks.append(F.when(value == "", F.lit(text["required"].format(key=key))))
        if key == "Language":
            checks.append(F.when(~value.rlike(c.METADATA_LANGUAGE_PATTERN), F.lit(text["language"].format(pattern=c.METADATA_LANGUAGE_PATTERN))))
        if key in c.METADATA_MAX_GRAPHEMES:
            most = c.METADATA_MAX_GRAPHEMES[key]
            checks.append(F.when(F.regexp_count(value, F.lit(r"\X")) > most, F.lit(text["graphemes"].format(key=key, most=most))))
        if key == "Date":
            n = c.METADATA_DATE_LENGTH
            checks.append(F.when(F.char_length(value) > n, F.lit(text["characters"].format(key=key, most=n))))
            checks.append(F.when(F.char_length(value) < n, F.lit(text["required"].format(key=key))))
        if key.startswith("Illustration"):
            image = F.hex(value)
            good = image.startswith(c.PNG_SIGNATURE_HEX) & (F.char_length(image) > 16) & ~F.substring(image, 17, 2).isin("0A", "0D")
            checks.append(F.when(~good, F.lit(text["image"].format(key=key))))
    return F.coalesce(*required, *checks)


# --- stalls ----------------------------------------------------------------------------------------

def silence_sessions(events: DataFrame, source: str, micros: str, gap_micros: int) -> DataFrame:
    """Activity sessions per source, split where it is silent for longer than the gap: session, start, end, events.

    Events in one slot of gap length can never be split, so they are counted per slot first; a source then
    has at most one row per slot, however many events it has.
    """
    slots = events.groupBy(source, F.floor(F.col(micros) / gap_micros).alias("__slot")).agg(
        F.min(micros).alias("__from"), F.max(micros).alias("__to"), F.count(F.lit(1)).alias("__n"))
    within = Window.partitionBy(source).orderBy("__slot")
    new = F.coalesce((F.col("__from") - F.lag("__to").over(within) > gap_micros).cast("int"), F.lit(1))
    numbered = slots.withColumn("__new", new).withColumn("session", F.sum("__new").over(within).cast("long"))
    return numbered.groupBy(source, "session").agg(F.min("__from").alias("start"), F.max("__to").alias("end"), F.sum("__n").alias("events"))
