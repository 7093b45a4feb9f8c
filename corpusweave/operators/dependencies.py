"""Style and script dependencies: imports, closures, module sets, gadgets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweave import constants as c
from corpusweave.functions.assets import asset_path
from corpusweave.functions.text import let, relative_href
from corpusweave.functions.urls import Site, absolute_url
from corpusweave.plans.closure import first_positions, reach
from corpusweave.plans.keyed import members_of, missing_from
from corpusweave.plans.ranks import rank_in_group
from corpusweave.session import cut, small_table

# fixed values: the two url forms of style sheets
IMPORT_PATTERN = r"""(?i)@import\s+(?:url\(\s*(['"]?)(.*?)\1\s*\)|(['"])(.*?)\3)\s*([^;]*);"""
URL_PATTERN = r"""(?i)url\(['"]{0,1}(.*?)['"]{0,1}\)"""
URL_SPAN = r"""(?i)(url\(['"]{0,1})(.*?)(['"]{0,1}\))"""
SUPPORTS_PATTERN = r"(?i)supports\s*\((.*?)\)"


# --- style sheets ----------------------------------------------------------------------------------

def css_urls(sheets: DataFrame) -> DataFrame:
    """Assets a sheet (url, body) refers to outside its imports: sheet, pos, full_url, path, replacement."""
    plain = F.regexp_replace("body", IMPORT_PATTERN, "")
    found = sheets.select(F.col("url").alias("sheet"), F.posexplode(F.regexp_extract_all(plain, F.lit(URL_PATTERN), F.lit(1))).alias("pos", "ref"))
    refs = found.filter((F.col("ref") != "") & ~F.col("ref").startswith("data"))
    full = refs.withColumn("full_url", absolute_url("ref", F.col("sheet"))).withColumn("path", asset_path("full_url", escape=True))
    safe = F.replace(F.replace(F.replace("path", F.lit("'"), F.lit("%27")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return full.select("sheet", F.col("pos").cast("long").alias("pos"), "full_url", "path", F.concat(F.lit("../"), safe).alias("replacement"))


def inline_sheets(tokens: DataFrame, site: Site, key: str = "page_id") -> DataFrame:
    """Texts of ``style`` elements as sheets (key, seq, url, body); their URLs are taken as relative to the site."""
    before = F.lag("tag").over(Window.partitionBy(key).orderBy("seq"))
    marked = tokens.withColumn("__style", (F.col("kind") == "text") & before.eqNullSafe(F.lit("style")))
    return marked.filter("__style AND text <> ''").select(key, "seq", F.lit(site.origin + "/").alias("url"), F.col("text").alias("body"))


def local_urls(text: Column, base: Column | str, to_page: Callable[[Column], Column]) -> Column:
    """The text of a sheet with its URLs, taken as relative to ``base``, replaced by what ``to_page`` makes of their place in the snapshot.

    The sheet is cut at its ``url()`` spans and put together again, so a URL is replaced where it stands and nowhere else: it may be part of another
    one, of a selector or of a comment, and may come twice.
    """
    spans = F.arrays_zip(
        F.split(text, URL_PATTERN, -1).alias("before"), *[F.regexp_extract_all(text, F.lit(URL_SPAN), F.lit(i)).alias(n) for i, n in enumerate(("opening", "ref", "closing"), 1)])

    def local(ref: Column) -> Column:
        path = let(let(absolute_url(ref, base), lambda url: asset_path(url, escape=True)), to_page)
        return F.replace(F.replace(F.replace(path, F.lit("'"), F.lit("%27")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))

    def rewritten(span: Column) -> Column:
        # nothing follows what stands behind the last span
        led = let(F.coalesce(span["ref"], F.lit("")), lambda ref: F.when((ref == "") | ref.startswith("data"), ref).otherwise(F.coalesce(local(ref), ref)))
        return F.concat(span["before"], F.coalesce(span["opening"], F.lit("")), led, F.coalesce(span["closing"], F.lit("")))

    return F.array_join(F.transform(spans, rewritten), "")


def rewrite_inline_styles(tokens: DataFrame, site: Site, page_path: Column, key: str = "page_id") -> DataFrame:
    """URLs in ``style`` elements lead to the snapshot; the sheet is rewritten inside its row."""
    before = F.lag("tag").over(Window.partitionBy(key).orderBy("seq"))
    marked = tokens.withColumn("__style", (F.col("kind") == "text") & before.eqNullSafe(F.lit("style")))
    rewritten = local_urls(F.col("text"), site.origin + "/", lambda path: relative_href(page_path, path))
    return marked.withColumn("text", F.when(F.col("__style"), rewritten).otherwise(F.col("text"))).drop("__style")


def css_imports(sheets: DataFrame) -> DataFrame:
    """Import edges in source order: src, pos, dst, supports, media."""
    statements = sheets.select(F.col("url").alias("src"), F.posexplode(F.regexp_extract_all("body", F.lit(IMPORT_PATTERN), F.lit(0))).alias("pos", "statement"))
    target = F.concat(F.regexp_extract("statement", IMPORT_PATTERN, 2), F.regexp_extract("statement", IMPORT_PATTERN, 4))
    conditions = F.trim(F.regexp_extract("statement", IMPORT_PATTERN, 5))
    parts = statements.select("src", "pos", target.alias("target"), conditions.alias("conditions")).filter("target <> ''")
    return parts.select(
        "src", F.col("pos").cast("long").alias("pos"), absolute_url("target", F.col("src")).alias("dst"),
        F.trim(F.regexp_extract("conditions", SUPPORTS_PATTERN, 1)).alias("supports"),
        F.trim(F.regexp_replace("conditions", r"(?i)^(.*?)supports\s*\(.*?\)", "$1")).alias("media"))


def css_flatten_order(roots: DataFrame, imports: DataFrame, sheets: DataFrame) -> DataFrame:
    """Order in which a root's sheets appear, each once, at its first import: root, sheet, position (from 1).

    Imports of sheets that are not there are skipped.
    """
    edges = members_of(imports.select("src", "pos", "dst"), sheets.select(F.col("url").alias("dst")), ["dst"])
    placed = first_positions(roots, edges)
    return rank_in_group(placed, ["root"], ["place"], rank="position").select("root", F.col("node").alias("sheet"), "position")


def css_flatten_text(roots: DataFrame, imports: DataFrame, sheets: DataFrame) -> DataFrame:
    """root, text: each root's sheet with its imports in their places, each sheet once, URLs leading to the snapshot.

    An imported sheet stands inside what its import asks for, ``@supports`` within ``@media``; both hold for what it imports itself. Pieces of text
    are ordered by the path of import positions that leads to them, so nothing is put together before the one aggregate per root.
    """
    edges = members_of(imports, sheets.select(F.col("url").alias("dst")), ["dst"])
    placed = cut(first_positions(roots, edges))
    last = F.size("place") - 1
    above = placed.select("root", F.col("node").alias("src"), F.col("place").alias("above"))
    entered = placed.withColumns({"above": F.when(last >= 0, F.slice("place", F.lit(1), F.greatest(last, F.lit(0)))), "pos": F.get("place", last)})
    entered = entered.join(above, ["root", "above"], "left").join(edges.select("src", "pos", "supports", "media"), ["src", "pos"], "left")
    supports, media = (F.coalesce(name, F.lit("")) for name in ("supports", "media"))
    begin = F.concat(F.lit("\n/* start "), "node", F.lit(" */\n\n"), F.when(media != "", F.concat(F.lit("@media "), media, F.lit(" {\n"))).otherwise(""),
                     F.when(supports != "", F.concat(F.lit("@supports ("), supports, F.lit(") {\n"))).otherwise(""))
    end = F.concat(F.when(supports != "", "\n}\n").otherwise(""), F.when(media != "", "\n}\n").otherwise(""), F.lit("\n/* end   "), F.col("node"), F.lit(" */\n"))
    segments = F.transform(F.split("body", IMPORT_PATTERN, -1), lambda text: local_urls(text, F.col("url"), lambda path: F.concat(F.lit("../"), path)))
    texts = sheets.select(F.col("url").alias("node"), segments.alias("segments"))
    base = F.transform("place", lambda p: p * 2 + 1)  # imports have odd places, what stands between them even ones

    def piece(place: Column, text: Column) -> Column:
        return F.struct(F.concat(base, F.array(place)).alias("place"), text.alias("text"))

    own = F.transform("segments", lambda text, i: piece((i * 2).cast("long"), text))
    pieces = F.concat(F.array(piece(F.lit(-1).cast("long"), begin)), own, F.array(piece(F.lit(1 << 62).cast("long"), end)))
    dealt = entered.join(texts, "node").select("root", F.explode(pieces).alias("piece"))
    ordered = F.array_sort(F.collect_list("piece"))
    return dealt.groupBy("root").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))


# --- modules ---------------------------------------------------------------------------------------

def module_edges(pages: DataFrame, key: str) -> DataFrame:
    """key, kind (js, css), module: what a page asks for. ``pages``: key, modules, modulestyles, text.

    User modules are left out, base modules always come along, and marks in the text add modules.
    """
    def kept(names: str) -> Column:
        return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda m: ~m.startswith("user"))

    def triggered(i: int) -> Column:
        return F.array_compact(F.array(*[F.when(F.col("text").contains(mark), F.lit(pair[i])) for mark, pair in c.TEXT_TRIGGERED_MODULES.items()]))

    def literal(names: Sequence[str]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    css = F.array_distinct(F.concat(literal(c.BASE_STYLE_MODULES), kept("modulestyles"), triggered(0)))
    js = F.array_distinct(F.concat(literal(c.BASE_SCRIPT_MODULES), kept("modules"), triggered(1)))
    both = F.array(F.struct(F.lit("css").alias("kind"), css.alias("names")), F.struct(F.lit("js").alias("kind"), js.alias("names")))
    return pages.select(key, F.inline(both)).select(key, "kind", F.explode("names").alias("module"))


def category_styles(flags: DataFrame, key: str) -> DataFrame:
    """key, kind, module: the styles that category pages add. ``flags``: key, size (members), files, nogallery."""
    styles = F.array_compact(F.array(
        F.when(F.col("size") > 0, F.lit(c.CATEGORY_STYLE_MODULE)), F.when((F.col("files") > 0) & ~F.col("nogallery"), F.lit(c.GALLERY_STYLE_MODULE))))
    return flags.select(key, F.lit("css").alias("kind"), F.explode(styles).alias("module"))


def needs_math(modules: Column) -> Column:
    """Whether a page loads a formula renderer: one of its modules names it."""
    return F.exists(modules, lambda m: m.rlike("(?i)mathjax"))


def trusted_scripts(edges: DataFrame, mode: str, extra: Sequence[str] = ()) -> DataFrame:
    """Script edges a run keeps: mode none, trusted (the allow list and the user's own) or all. Styles always stay."""
    if mode == "all":
        return edges
    if mode == "none":
        return edges.filter("kind = 'css'")
    return edges.filter((F.col("kind") == "css") | F.col("module").isin(*c.TRUSTED_SCRIPT_MODULES, *extra))


def module_set(edges: DataFrame) -> DataFrame:
    return edges.select("kind", "module").distinct()


def module_closure(used: DataFrame, depends: DataFrame, registry: DataFrame, dynamic: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Scripts to ship: the used ones, known dynamic extras, and all they depend on; modules not in the registry fall out.

    ``used``: module; ``depends``: src, dst; ``registry``: module.
    """
    dynamic = c.DYNAMIC_SCRIPT_DEPENDENCIES if dynamic is None else dynamic
    pairs = [(m, extra) for m, extras in dynamic.items() for extra in extras]
    seeds = used.select("module")
    if pairs:
        table = small_table(used.sparkSession, ["module", "extra"], pairs)
        seeds = seeds.unionByName(seeds.join(table, "module").select(F.col("extra").alias("module")))
    known = members_of(seeds.distinct(), registry, ["module"])
    return members_of(reach(known, depends, "module"), registry, ["module"]).select("module")


def scripts_without_styles(scripts: DataFrame, styles: DataFrame, added: Sequence[str] = ()) -> DataFrame:
    """Scripts that are not shipped as styles already, unless the user asked for them; user modules are skipped."""
    doubled = styles.filter(~F.col("module").isin(*added)) if added else styles
    return missing_from(scripts.filter(~F.col("module").startswith("user")), doubled, ["module"])


# --- gadgets ---------------------------------------------------------------------------------------

def active_gadgets(pages: DataFrame, gadgets: Sequence[Mapping], key: str, skin: str, action: str = "view") -> DataFrame:
    """key, kind, module of the gadgets that apply to each page (ns, contentmodel, categories).

    The gadget list is configuration, so it travels in the plan as an array; each row keeps the gadgets it
    matches and only those become rows. A gadget with peers is a script and its peers are styles.
    """
    def modules(g: Mapping) -> list[tuple[str, str]]:
        if g.get("peers"):
            return [("css", p) for p in g["peers"]] + [("js", g["id"])]
        if any(g.get(part) for part in ("scripts", "dependencies", "datas", "messages")):
            return [("js", g["id"])]
        return [("css", g["id"])] if g.get("styles") else []

    def matches(g: Mapping) -> Column:
        hit = F.lit(not g.get("skins") or skin in g["skins"]) & F.lit(not g.get("actions") or action in g["actions"])
        if g.get("namespaces"):
            hit = hit & F.coalesce("ns", F.lit(0)).isin(*g["namespaces"])
        if g.get("contentModels"):
            hit = hit & F.coalesce("contentmodel", F.lit(c.DEFAULT_CONTENT_MODEL)).isin(*g["contentModels"])
        if g.get("categories"):
            own = F.coalesce("categories", F.array().cast("array<string>"))
            hit = hit & F.arrays_overlap(own, F.array(*[F.lit(x) for x in g["categories"]]))
        return hit

    found = [F.when(matches(g), F.struct(F.lit(kind).alias("kind"), F.lit(f"ext.gadget.{name}").alias("module"))) for g in gadgets for kind, name in modules(g)]
    return pages.select(key, F.inline(F.array_compact(F.array(*found))))


