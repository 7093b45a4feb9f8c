"""Snapshot variants: formats and languages of one catalogue, and what a host says about a source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave import constants as c
from corpusweave.plans.keyed import lookup, missing_from


def format_flags(fmt: Column) -> Column:
    """Struct(nopic, novid, nopdf, nodet, flavour) of a format text such as ``nopic,nopdf:label``.

    Text after a colon is the flavour, even when empty; otherwise it follows from the flags.
    """
    parts = F.split(fmt, ":")
    flags = {name: F.get(parts, F.lit(0)).contains(name) for name in ("nopic", "novid", "nopdf", "nodet")}
    computed = F.concat_ws(
        "-",
        F.when(flags["nopic"], "nopic").when(flags["nopdf"], "nopdf").when(flags["novid"] & ~flags["nodet"], "novid"),
        F.when(flags["nodet"], "nodet"))
    flavour = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(computed)
    return F.struct(*[v.alias(k) for k, v in flags.items()], flavour.alias("flavour"))


def fan_out(pages: DataFrame, formats: Sequence[str], lang_variants: Sequence[str] = ("",)) -> DataFrame:
    """Every page in every variant. The variants are a literal array in each row: no join, no shuffle."""
    variants = F.array(*[F.struct(F.lit(v).alias("lang_variant"), F.lit(f).alias("format")) for v in lang_variants for f in formats])
    rows = pages.withColumn("__v", F.explode(variants)).select(*pages.columns, "__v.lang_variant", "__v.format")
    return rows.withColumn("__f", format_flags(F.col("format"))).select(*rows.columns, "__f.*")


def host_labels(pages: DataFrame, iso2: Column, iso3: Column) -> DataFrame:
    """Adds creator and lang_label from ``host``."""
    parts = F.split("host", r"\.")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    name = F.when(second.isin(*c.KNOWN_PROJECTS) | (F.char_length(first) < F.char_length(second)), second).otherwise(first)
    return pages.withColumns({
        "creator": F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.char_length(name))),
        "lang_label": F.when(F.array_contains(parts, iso3), iso3).otherwise(iso2),
    })


def still_to_do(work: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is not in the manifest of an earlier run."""
    return missing_from(work, manifest, keys)


def flatten_plurals(strings: Mapping[str, str | Mapping[str, str]]) -> dict[str, str]:
    """Label dictionary with plural objects as ``key_category`` entries."""
    flat: dict[str, str] = {}
    for key, value in strings.items():
        if isinstance(value, Mapping) and value and set(value) <= set(c.PLURAL_CATEGORIES):
            flat.update({f"{key}_{category}": str(text) for category, text in value.items()})
        else:
            flat[key] = str(value)
    return flat


def localised(pages: DataFrame, labels: DataFrame, keys: Sequence[str], fallback: str = "en") -> DataFrame:
    """page rows × label keys with the text of the page's language, else of the fallback language.

    ``labels``: lang, key, text (one row per language and key).
    """
    wanted = pages.withColumn("key", F.explode(F.array(*[F.lit(k) for k in keys])))
    own = lookup(wanted, labels, ["lang", "key"])
    base = labels.filter(F.col("lang") == fallback).select("key", F.col("text").alias("__base"))
    return lookup(own, base, ["key"]).withColumn("text", F.coalesce("text", "__base")).drop("__base")
