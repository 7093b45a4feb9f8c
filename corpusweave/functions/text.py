"""Titles, paths and percent-encoding as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.constants import TITLE_WORD_MAX_BYTES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it.

    Naming an expression n times copies it n times into the plan; nested URL rules would grow past what
    the JIT compiles. A lambda variable is one small reference.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def encode_component(c: Column | str) -> Column:
    """Percent-encoding that leaves letters, digits and ``-_.!~*'()`` alone."""
    return replace_all(F.url_encode(col(c)), [
        ("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"),
    ])


def decode_component(c: Column | str) -> Column:
    """Percent-decoding; undecodable input is kept, and ``+`` stays a plus."""
    return let(col(c), lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))


def title_path(title: Column | str) -> Column:
    return F.replace(col(title), F.lit(" "), F.lit("_"))


def path_title(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("_"), F.lit(" "))


def link_href(title: Column | str) -> Column:
    """The href under which a title is reached inside the snapshot."""
    path = F.regexp_replace(title_path(title), "^/", ".//")
    return F.replace(encode_component(path), F.lit("%2F"), F.lit("/"))


def relative_href(parent_path: Column | str, target: Column | str) -> Column:
    """``target`` as seen from ``parent_path``: one step up per run of slashes, leading ones not counted."""
    depth = F.regexp_count(F.regexp_replace(col(parent_path), r"^/+", ""), F.lit(r"/+"))
    return F.concat(F.when(depth > 0, F.repeat(F.lit("../"), depth)).otherwise(F.lit("./")), col(target))


def _cut_word(word: Column, max_bytes: int) -> Column:
    # utf-8 needs at least one byte per character, so only the first max_bytes characters can fit
    fitting = F.filter(
        F.sequence(F.lit(0), F.least(F.char_length(word), F.lit(max_bytes))),
        lambda n: F.octet_length(F.substring(word, F.lit(1), n)) <= max_bytes,
    )
    return F.when(F.octet_length(word) <= max_bytes, word).otherwise(
        F.substring(word, F.lit(1), F.array_max(fitting))
    )


def truncate_words(text: Column | str, max_bytes: int = TITLE_WORD_MAX_BYTES) -> Column:
    """Cut every space-separated word to ``max_bytes`` UTF-8 bytes at a character boundary."""
    words = F.transform(F.split(col(text), " "), lambda w: _cut_word(w, max_bytes))
    return F.when(F.octet_length(col(text)) <= max_bytes, col(text)).otherwise(F.array_join(words, " "))


def plain_number(c: Column) -> Column:
    """A double as a plain decimal string without a trailing ``.0``."""
    def text(x: Column) -> Column:
        small = (F.abs(x) < 1e-3) & (x != 0)
        return F.when(small, F.call_function("format_number", x, F.lit("0.####################"))).otherwise(x.cast("string"))

    return F.regexp_replace(let(c, text), r"\.0$", "")
