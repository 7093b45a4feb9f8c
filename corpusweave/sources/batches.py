"""Landed API responses: one JSON object per line, with the arrival number of the response in ``seq``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusweave.plans.ranks import rank_in_group
from corpusweave.session import cut, new_table_path

PAGE_RECORD = """struct<title string, ns int, contentmodel string, missing boolean, pagelanguagehtmlcode string,
  pagelanguagedir string,
  revisions array<struct<revid bigint, parentid bigint, minor string, user string, timestamp string, comment string>>,
  redirects array<struct<title string, ns int, fragment string>>,
  categories array<struct<title string, ns int, hidden boolean>>,
  coordinates array<struct<lat double, lon double, primary string, globe string>>,
  thumbnail struct<source string, width int, height int>,
  categoryinfo struct<size int, pages int, files int, subcats int, hidden boolean>,
  pageprops map<string, string>, flagged struct<stable_revid bigint>>"""
RESPONSE_SCHEMA = f"""seq bigint, query struct<pages array<{PAGE_RECORD}>>, warnings map<string, map<string, string>>,
  error struct<code string, info string>, `continue` map<string, string>"""


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses as landed; the schema is fixed, so nothing is inferred and unused fields are not parsed."""
    return spark.read.schema(RESPONSE_SCHEMA).json(path)


def read_quarantined(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(responses, malformed): lines that are not a response, cut off or of another shape, as file, line, bytes and reason instead of rows of nulls.

    A line is malformed if it isn't JSON, if a field has another type than a response gives it, or if it has neither a number nor a query, a warning or an
    error. Both tables are views of one kept reading, so they always add up to the lines that have landed; blank lines are none.
    """
    schema = StructType.fromDDL(f"{RESPONSE_SCHEMA}, __line string")
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "__line").json(path)
    path_kept = new_table_path(spark, "responses-read")
    read.withColumn("__file", F.input_file_name()).write.parquet(path_kept)
    read = spark.read.parquet(path_kept)
    empty = F.col("seq").isNull() | (F.col("query").isNull() & F.col("warnings").isNull() & F.col("error").isNull())
    good = F.col("__line").isNull() & ~empty
    reason = F.when(F.col("__line").isNull(), "empty").when(F.try_parse_json("__line").isNull(), "not json").otherwise("other shape")
    text = F.coalesce("__line", F.to_json(F.struct(*[c for c in read.columns if not c.startswith("__")])))
    malformed = read.filter(~good).select(F.col("__file").alias("file"), text.alias("line"), F.octet_length(text).cast("long").alias("bytes"), reason.alias("reason"))
    return read.filter(good).drop("__line", "__file"), malformed


def page_records(responses: DataFrame) -> DataFrame:
    """One row per page record; a page split over several responses still has several rows."""
    return responses.select("seq", F.inline("query.pages"))


def merge_scalars(records: DataFrame, key: str, seq: str, columns: Sequence[str]) -> DataFrame:
    """Last given value per page and column; a response that lacks a field does not erase it."""
    return records.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
    )


def merge_items(records: DataFrame, key: str, seq: str, array: str) -> DataFrame:
    """Array fields concatenated in response order, kept as rows: key, ordinal (from 1), item.

    Rows rather than one array per page, so that a page with very many items is not built in one task.
    """
    items = records.select(key, seq, F.posexplode(array).alias("__pos", "item"))
    return rank_in_group(items, [key], [seq, "__pos"], rank="ordinal").select(key, "ordinal", "item")


def merge_entries(records: DataFrame, key: str, seq: str, mapping: str) -> DataFrame:
    """Object fields merged key by key, later responses winning: key, field, value."""
    entries = records.select(key, seq, F.explode(mapping).alias("field", "value"))
    return entries.groupBy(key, "field").agg(F.max_by("value", seq).alias("value"))


def merge_nested(records: DataFrame, key: str, seq: str, document: str) -> DataFrame:
    """Records of one page merged at any depth: key, path, kind, ordinal, value (as JSON), one row per leaf.

    Later responses win: objects are merged field by field, arrays appended in response order, anything else replaced. If a field has another kind in a
    later response (an object after an array, say), what came before is gone. ``document`` is a VARIANT; ``seq`` is unique in a page.

    ``path`` is the list of fields that lead to the leaf. Its kind is ``array`` for one item of an array, ``object`` for an object without fields, else
    ``scalar``. Each round goes one level down, for all pages at once, so there are as many rounds as records are deep; leaves stay rows, and no page is
    put together in one task.
    """
    here = records.select(key, seq, F.array().cast("array<string>").alias("path"), F.col(document).alias("value"))
    leaves = []
    while True:
        shape = F.lower(F.regexp_extract(F.schema_of_variant("value"), "^(OBJECT|ARRAY)", 1))
        here = cut(here.filter("value IS NOT NULL").withColumn("kind", F.when(shape == "", "scalar").otherwise(shape)))
        if here.isEmpty():
            break
        newest = [F.max(F.when(F.col("kind") == k, F.col(seq))).alias(k) for k in ("object", "array", "scalar")]
        last = here.groupBy(key, "path").agg(F.max(seq).alias("last"), *newest)
        # of the kind that the last response gives, all since another one was given
        winner = F.when(F.col("object") == F.col("last"), "object").when(F.col("array") == F.col("last"), "array").otherwise("scalar")
        others = F.greatest(*[F.when(winner != k, F.col(k)) for k in ("object", "array", "scalar")])
        last = last.select(key, "path", winner.alias("kind"), "last", F.coalesce(others, F.lit(-(1 << 62))).alias("since"))
        live = cut(here.join(last, [key, "path", "kind"]).filter(F.col(seq) > F.col("since")))
        leaves.append(live.filter((F.col("kind") == "scalar") & (F.col(seq) == F.col("last"))).select(
            key, "path", "kind", F.lit(1).cast("long").alias("ordinal"), F.to_json("value").alias("value")))
        items = live.filter("kind = 'array'").select(key, "path", seq, F.posexplode(F.col("value").cast("array<variant>")).alias("__pos", "item"))
        items = items.select(key, "path", seq, "__pos", F.to_json("item").alias("value"))
        leaves.append(rank_in_group(items, [key, "path"], [seq, "__pos"], rank="ordinal").select(key, "path", F.lit("array").alias("kind"), "ordinal", "value"))
        objects = live.filter("kind = 'object'")
        fields = objects.select(key, seq, "path", F.explode(F.col("value").cast("map<string, variant>")).alias("field", "item"))
        bare = objects.groupBy(key, "path").agg(F.min(F.to_json("value")).alias("value")).filter("value = '{}'")
        leaves.append(bare.select(key, "path", F.lit("object").alias("kind"), F.lit(1).cast("long").alias("ordinal"), "value"))
        here = fields.select(key, seq, F.concat("path", F.array("field")).alias("path"), F.col("item").alias("value"))
    return reduce(DataFrame.union, leaves) if leaves else records.sparkSession.createDataFrame([], f"{key} long, path array<string>, kind string, ordinal long, value string")


def rebuild(leaves: DataFrame, key: str) -> DataFrame:
    """key, document: the leaves of ``merge_nested`` as one JSON text a page, fields in the order of their names; for pages that fit a row. Levels are closed from the deepest up."""
    depth = leaves.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    arrays = leaves.filter("kind = 'array'").groupBy(key, "path").agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]), ","), F.lit("]")).alias("value"))
    rows = leaves.filter("kind <> 'array'").select(key, "path", "value").union(arrays)
    for level in range(depth, 0, -1):
        named = F.concat(F.regexp_extract(F.to_json(F.create_map(F.element_at("path", -1), F.lit(0))), r"(?s)^\{(.*)0\}$", 1), "value")
        closed = rows.filter(F.size("path") == level).select(key, F.slice("path", 1, level - 1).alias("path"), F.element_at("path", -1).alias("field"), named.alias("member"))
        closed = closed.groupBy(key, "path").agg(F.array_sort(F.collect_list(F.struct("field", "member"))).alias("members"))
        closed = closed.select(key, "path", F.concat(F.lit("{"), F.array_join(F.transform("members", lambda m: m["member"]), ","), F.lit("}")).alias("value"))
        rows = cut(rows.filter(F.size("path") < level).union(closed))
    return rows.select(key, F.col("value").alias("document"))


def repeated_cursors(responses: DataFrame, scan: str, cursor: str) -> DataFrame:
    """Cursors met more than once in one scan: the scan would never end."""
    return responses.filter(F.col(cursor).isNotNull()).groupBy(scan, cursor).agg(
        F.count(F.lit(1)).alias("times")
    ).filter("times > 1")


def warning_census(responses: DataFrame) -> DataFrame:
    """Warnings and errors by module and text; a database error is fatal."""
    from corpusweave.constants import DB_ERROR_CODE

    entries = responses.select(F.explode("warnings").alias("module", "texts")).select(
        F.lit("warning").alias("level"), "module", F.explode("texts").alias("field", "text"),
    )
    errors = responses.filter("error IS NOT NULL").select(
        F.lit("error").alias("level"), F.lit("api").alias("module"), F.lit("code").alias("field"), F.col("error.code").alias("text"),
    )
    return entries.unionByName(errors).groupBy("level", "module", "text").agg(
        F.count(F.lit(1)).alias("times")
    ).withColumn("fatal", (F.col("level") == "error") & (F.col("text") == DB_ERROR_CODE))
