"""Page lists given by the user: inline comma lists or files with one title per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.text import col, path_title


def inline_titles(value: Column | str) -> Column:
    """Array of titles in a comma list: trimmed, empty entries dropped, underscores as spaces."""
    trimmed = F.transform(F.split(col(value), ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.transform(F.filter(trimmed, lambda t: t != ""), path_title)


def line_titles(value: Column | str) -> Column:
    """Array of titles in a file body: carriage returns removed, empty lines dropped, underscores as spaces."""
    lines = F.transform(F.split(col(value), "\n"), lambda t: F.replace(t, F.lit("\r"), F.lit("")))
    return F.transform(F.filter(lines, lambda t: t != ""), path_title)


def read_list_file(spark: SparkSession, path: str) -> DataFrame:
    """pos, title of a list file, read line by line; ``pos`` grows with the line number but has gaps."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.replace("value", F.lit("\r"), F.lit("")).alias("line"))
    return lines.filter("line <> ''").select("pos", path_title("line").alias("title"))
