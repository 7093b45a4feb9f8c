"""URL expressions: resolution against a base, href to title, geo links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.constants import SCHEME_PATTERN
from corpusweave.functions.text import col, decode_component, let, path_title, plain_number


@dataclass(frozen=True)
class Site:
    """What the link rules need to know about the wiki a page comes from."""

    origin: str = "https://wiki.example.org"
    article_path: str = "/wiki/"
    script_path: str = "/w/index.php"
    main_page: str = "Main Page"
    root_is_main_page: bool = False

    @property
    def protocol(self) -> str:
        return self.origin.split("//")[0]

    @property
    def article_url(self) -> str:
        return self.origin + self.article_path


def scheme(href: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(href), SCHEME_PATTERN, 1), F.lit(""))


# scheme with colon, authority with slashes, path, query and fragment
URL_PARTS = r"(?s)^([a-zA-Z][a-zA-Z\d+\-.]*:)?(//[^/?#]*)?([^?#]*)(.*)$"


def url_parts(url: Column) -> Column:
    """[scheme:, //authority, path, ?query#fragment] from one regex pass; missing parts are empty."""
    return F.split(F.regexp_replace(url, URL_PARTS, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")


def remove_dot_segments(path: Column) -> Column:
    def resolved(p: Column) -> Column:
        kept = F.aggregate(
            F.split(p, "/"), F.array().cast("array<string>"),
            lambda acc, part: F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
            .when(part == ".", acc).otherwise(F.concat(acc, F.array(part))))
        return F.concat(F.array_join(kept, "/"), F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))

    return let(path, lambda p: F.when(p.rlike(r"(^|/)\.\.?(/|$)"), resolved(p)).otherwise(p))


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """Resolve ``href`` against an absolute ``base`` (a column, or a literal URL string)."""
    def part(parts: Column, i: int) -> Column:
        return F.get(parts, F.lit(i))

    def join(h: Column, b: Column) -> Column:
        origin = F.concat(part(b, 0), part(b, 1))
        base_path = F.when(part(b, 2) == "", F.lit("/")).otherwise(part(b, 2))
        own_path = F.when(part(h, 2) == "", F.lit("/")).otherwise(remove_dot_segments(part(h, 2)))
        query = F.regexp_extract(part(b, 3), r"^([^#]*)", 1)
        return (
            F.when((part(h, 0) != "") & (part(h, 1) == ""), F.array_join(h, ""))
            .when(part(h, 1) != "", F.concat(F.when(part(h, 0) == "", part(b, 0)).otherwise(part(h, 0)), part(h, 1), own_path, part(h, 3)))
            .when(part(h, 2).startswith("/"), F.concat(origin, own_path, part(h, 3)))
            .when(part(h, 2) != "", F.concat(origin, remove_dot_segments(F.concat(F.regexp_extract(base_path, r"^(.*/)", 1), part(h, 2))), part(h, 3)))
            .when(part(h, 3).startswith("?"), F.concat(origin, base_path, part(h, 3)))
            .otherwise(F.concat(origin, base_path, query, part(h, 3)))
        )

    base = F.lit(base) if isinstance(base, str) else base
    return let(url_parts(col(href)), lambda h: let(url_parts(base), lambda b: join(h, b)))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z\d+\-.]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z\d+\-.]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def query_param(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded as a form value; null if absent."""
    pair = F.nullif(F.regexp_extract(url, rf"^[^#]*?[?&](\Q{name}\E=[^&#]*)", 1), F.lit(""))
    raw = F.substring(pair, F.lit(len(name) + 2), F.char_length(pair))
    return let(raw, lambda r: F.coalesce(F.try_url_decode(r), r))


def href_title(href: Column | str, site: Site) -> Column:
    """Title a link points to, or null if it leaves the article space."""
    href = col(href)
    last_two = F.regexp_extract(F.regexp_extract(href, r"^(.*)\.[^.]*$", 1), r"([^/]*(?:/[^/]*)?)$", 1)
    name = F.regexp_replace(F.regexp_extract(href, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")

    def title(path: Column) -> Column:
        def after(prefix: str) -> Column:
            return F.substring(path, F.lit(len(prefix) + 1), F.char_length(path))

        return (
            F.when((href == "/") & F.lit(site.root_is_main_page), F.lit(site.main_page))
            .when(path == site.script_path, query_param(href, "title"))
            .when(href.startswith("./"), decode_component(after("/")))
            .when(path.startswith(site.article_path), decode_component(after(site.article_path)))
            .when(href.rlike(r"/[0-9]+(\.|$)"), last_two)
            .when(F.regexp_extract(href, r"^(.*)/[^/]*$", 1).contains("../"), name)
        )

    return F.nullif(path_title(let(url_path(absolute_url(href, site.origin + "/")), title)), F.lit(""))


def _hemisphere(pieces: Column, signs: dict[str, int]) -> Column:
    """Struct(value, used): degrees, minutes, seconds up to a hemisphere letter among the first four pieces."""
    first = F.coalesce(*[F.when(F.get(pieces, F.lit(i)).isin(*signs), F.lit(i)) for i in range(4)])

    def read(at: Column) -> Column:
        value = F.lit(0.0)
        for i, unit in enumerate((1, 60, 3600)):
            value = value + F.when(at > i, F.get(pieces, F.lit(i)).try_cast("double") / unit).otherwise(0.0)
        sign = F.coalesce(*[F.when(F.get(pieces, at) == k, F.lit(v)) for k, v in signs.items()])
        return F.struct((value * sign).alias("value"), (at + 1).alias("used"))

    return let(first, read)


def geo_href(href: Column | str) -> Column:
    """``geo:lat,lon`` for map links, else null."""
    href = col(href)

    def both(first: Column, second: Column) -> Column:
        return F.when(first.try_cast("double").isNotNull() & second.try_cast("double").isNotNull(), F.concat_ws(",", first, second))

    def sexagesimal(pieces: Column) -> Column:
        def with_lat(lat: Column) -> Column:
            used = lat["used"]
            rest = F.slice(pieces, used + 1, F.greatest(F.size(pieces) - used, F.lit(0)))
            lon = _hemisphere(rest, {"E": 1, "W": -1, "O": 1})["value"]
            return F.concat(plain_number(lat["value"]), F.lit(","), plain_number(lon))

        return let(_hemisphere(pieces, {"N": 1, "S": -1}), with_lat)

    def geohack(pieces: Column) -> Column:
        pair = F.split(F.get(pieces, F.lit(0)), ";")
        return F.when(F.size(pair) == 2, both(F.get(pair, F.lit(0)), F.get(pair, F.lit(1)))).otherwise(sexagesimal(pieces))

    # the leading number of the parameter counts, whatever follows it
    number = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
    lat_q, lon_q = (F.regexp_extract(query_param(href, k), number, 1).try_cast("double") for k in ("lat", "lon"))
    point = (
        F.when(href.rlike(r"(?i)poimap2\.php"), F.concat(plain_number(lat_q), F.lit(","), plain_number(lon_q)))
        .when(href.rlike(r"(?i)geohack\.php"), let(F.split(F.upper(query_param(href, "params")), "_"), geohack))
        .when(href.rlike(r"(?i)Special:Map"), let(F.split(href, "/"), lambda p: both(F.get(p, F.lit(4)), F.get(p, F.lit(5)))))
    )
    return F.concat(F.lit("geo:"), point)


def is_map_href(href: Column) -> Column:
    return href.rlike(r"(?i)poimap2\.php|geohack\.php|Special:Map")


def without_http(url: Column) -> Column:
    return F.regexp_replace(url, r"(?i)^https?://", "")
