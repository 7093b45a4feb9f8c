"""Where an asset lands in the snapshot and what its URL says about its size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.constants import (
    ASSET_DIR, FANDOM_PATTERN, FORMULA_PATTERN, MULT_IN_URL_PATTERN, THUMB_PATTERN, WIDTH_IN_URL_PATTERN,
)
from corpusweave.functions.text import col, encode_component, let
from corpusweave.functions.urls import query_param, url_parts

# escapes of these characters survive URI decoding
RESERVED = "3B 2F 3F 3A 40 26 3D 2B 24 2C 23".split()


def decode_uri(url: Column | str) -> Column:
    """Percent-decoding of a whole URI: escaped reserved characters stay escaped; null if malformed."""
    kept = F.regexp_replace(col(url), f"(?i)%({'|'.join(RESERVED)})", "%25$1")
    return F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))


def asset_path(url: Column | str, escape: bool = False) -> Column:
    """Snapshot path of an absolute asset URL; null when the URL cannot be read."""
    url = col(url)

    def thumb(plain: Column, groups: Column) -> Column:
        original = F.regexp_replace(F.get(groups, F.lit(1)), "/$", "")
        last, extension = F.get(groups, F.lit(2)), F.get(groups, F.lit(3))
        name = F.when(F.char_length(original) <= F.char_length(last), last).otherwise(F.concat(original, extension))
        return placed(F.get(groups, F.lit(0)), name)

    def placed(folder: Column, name: Column) -> Column:
        return F.concat(F.md5(folder), F.lit("/"), encode_component(name) if escape else name)

    def hashed(plain: Column) -> Column:
        def named(parts: Column) -> Column:
            path = F.get(parts, F.lit(2))
            base = F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1)
            variant = F.coalesce(F.concat(F.lit("_"), query_param(url, "variant")), F.lit(""))
            loaded = F.concat(F.lit("load.php_"), query_param(url, "modules"), F.lit("_"), query_param(url, "image"), variant, F.lit(".svg"))
            return F.when(path.endswith("/load.php"), F.coalesce(loaded, base)).otherwise(base)

        name = F.concat(F.md5(plain), F.lit("_"), let(url_parts(url), named))
        return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z\d+\-.]*:"), encode_component(name) if escape else name)

    def special(plain: Column) -> Column:
        return (
            F.when(plain.rlike(FORMULA_PATTERN), placed(F.regexp_extract(plain, FORMULA_PATTERN, 1), F.concat(F.regexp_extract(plain, FORMULA_PATTERN, 2), F.lit(".svg"))))
            .when(plain.rlike(FANDOM_PATTERN), placed(F.regexp_extract(plain, FANDOM_PATTERN, 1), F.regexp_extract(plain, FANDOM_PATTERN, 2)))
            .otherwise(hashed(plain))
        )

    def of(plain: Column) -> Column:
        # one regex pass: directory, original file, last segment, extra extension; a single piece if there is no match
        groups = F.split(F.regexp_replace(plain, THUMB_PATTERN, "$1\u0001$4\u0001$6\u0001$7"), "\u0001")
        return let(groups, lambda g: F.when(F.size(g) == 4, thumb(plain, g)).otherwise(special(plain)))

    return F.concat(F.lit(ASSET_DIR + "/"), let(F.when(url.contains("%"), decode_uri(url)).otherwise(url), of))


def url_width(url: Column | str) -> Column:
    """Pixel width of the last ``<n>px-`` mark."""
    return F.try_element_at(F.regexp_extract_all(col(url), F.lit(WIDTH_IN_URL_PATTERN), F.lit(1)), F.lit(-1)).cast("long")


def url_multiplier(url: Column | str) -> Column:
    """Density multiplier of ``-<n>x.``; only read when there is no width mark."""
    found = F.nullif(F.regexp_extract(col(url), MULT_IN_URL_PATTERN, 1), F.lit(""))
    return F.when(url_width(url).isNull(), found.try_cast("double"))


def subtitle_url(full: Column) -> Column:
    """The address of a subtitle track in the format that browsers read."""
    return F.when(full.rlike(r"[?&]trackformat="), F.regexp_replace(full, r"([?&]trackformat=)[^&#]*", "$1vtt")).otherwise(
        F.concat(full, F.lit("&trackformat=vtt")))


def subtitle_path(url: Column) -> Column:
    """Where a subtitle track lies in the snapshot; null if its address names no title or language."""
    return F.concat(query_param(url, "title"), F.lit("-"), query_param(url, "lang"), F.lit(".vtt"))
