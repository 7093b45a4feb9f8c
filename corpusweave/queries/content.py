"""Content queries. Cleaning steps are compared byte for byte: the digest of the whole cleaned page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusweave import constants as c
from corpusweave.operators import content as ops
from corpusweave.operators import links, rendering
from corpusweave.plans.intervals import is_start
from corpusweave.plans.layout import spread
from corpusweave.queries import Family, Query
from corpusweave.session import new_table_path
from corpusweave.sources import html_tokens, views
from corpusweave.sources.views import with_views
from corpusweave.sources.wiki_html import EXTRAS, wiki_pages, wiki_sql

QUERIES = Family()


# where a page never ends its <b>, the bold goes on in each paragraph that follows and in the footer
@QUERIES.add(r"""
WITH s AS (SELECT page_id, html, regexp_replace(html, '(?s)<script>.*?</script>', '<script></script>', 'g') AS body FROM pages)
SELECT page_id, len(regexp_extract_all(body, '<[a-zA-Z]'))
    + CASE WHEN contains(body, '<b>') AND NOT contains(body, '</b>') THEN len(regexp_extract_all(substr(body, strpos(body, '<b>')), '<p>')) + 1 ELSE 0 END AS elements, len(regexp_extract_all(body, '<a ')) AS anchors,
  len(regexp_extract_all(body, '(?s)<!--.*?-->')) AS comments,
  len(regexp_extract_all(regexp_replace(body, '(?s)<!--.*?-->|<script>|</script>', '', 'g'), '<(?:br|meta)[^>]*>')) AS voids FROM s""")
def html_tokens_per_page(spark, sf_dir):
    tokens = html_tokens.tokenize(views.table(spark, sf_dir, "pages"))
    return tokens.groupBy("page_id").agg(
        F.count_if(is_start()).alias("elements"), F.count_if(is_start("a")).alias("anchors"), F.count_if(F.col("kind") == "comment").alias("comments"),
        F.count_if(is_start("br", "meta")).alias("voids"))


QUERIES["html_tokens"] = QUERIES.pop("html_tokens_per_page")


def _cleaned(name: str, step: Callable[[DataFrame], DataFrame], sql: str) -> None:
    def build(spark, sf_dir):
        pages = wiki_pages(spark, sf_dir)
        tokens = html_tokens.tokenize(pages)
        return html_tokens.serialise(step(tokens)).select("page_id", F.md5("html").alias("html_md5"))

    build.__name__ = name
    QUERIES[name] = Query(build, sql)


_cleaned("html_serialise", lambda t: t, wiki_sql())
_cleaned("clean_tags", ops.remove_tags, wiki_sql({6: EXTRAS[6].split("<link")[0]}))
_cleaned("clean_classes", ops.remove_classes, wiki_sql({7: '<div id="purgelink">x</div>'}))
_cleaned("clean_nolink", ops.remove_linkless, wiki_sql({1: ""}))
_cleaned("clean_gallery", ops.remove_empty_galleries, wiki_sql({
    2: EXTRAS[2].replace('<li class="gallerybox">t</li>', ""), 3: "", 15: '<ul class="gallery"><li class="gallerybox"></li></ul>'}))
_cleaned("clean_ids", ops.remove_ids, wiki_sql({7: EXTRAS[7].replace('<div id="purgelink">x</div>', "")}, first_only=True))
_cleaned("lead_only", ops.lead_section, wiki_sql(lead_only=True))
_cleaned("strip_citations", ops.remove_citations, wiki_sql({4: ""}))
_cleaned("empty_sections", ops.remove_empty_sections, wiki_sql(drop_empty=True))
_cleaned("clean_attrs", ops.clean_attributes, wiki_sql({8: '<div class="big thumb" style="color:red">y</div>'}))
_cleaned("strip_scripts", ops.remove_scripts, wiki_sql({11: EXTRAS[11].split("<script")[0] + "<iframe" + EXTRAS[11].split("</script><iframe", 1)[1]}))
_cleaned("ref_spans", lambda t: ops.globe_map_links(ops.reference_spans(t)), wiki_sql({
    5: '<sup id="r{k}">[2]</sup>', 11: EXTRAS[11].replace("48 N <b>2</b> E", "🌍")}))
_cleaned("strip_editlinks", ops.remove_edit_links, wiki_sql({6: "<link" + EXTRAS[6].split("<link", 1)[1]}))
_cleaned("clean_frames", ops.remove_empty_frames, wiki_sql({9: '<figure><img src="/im/i.png"></figure>'}))
_cleaned("iframe_tokens", lambda t: ops.replace_iframes(t, views.SITE), wiki_sql({
    11: EXTRAS[11].split("<iframe")[0]
    + '<a class="external" href="https://www.youtube.com/watch?v=v{k}"><img width="9" src="https://img.youtube.com/vi/v{k}/hqdefault.jpg" alt="Video thumbnail" loading="lazy"></a>'
    + '<div src="https://x.example.org/e?k={k}" class="mwo-external-video-card"><a class="external" href="https://x.example.org/e?k={k}">Open embedded content (external)</a></div>'}))


_cleaned("hook_transform", lambda t: ops.transform_pages(
    t, lambda x: x.filter(~(F.col("tag").eqNullSafe(F.lit("h2")) & (F.col("kind") != "text"))).withColumn(
        "text", F.when(F.col("text").rlike("^S [0-9]+$"), F.lit("")).otherwise(F.col("text"))),
    main_page=F.col("page_id") == 0), """
SELECT page_id, html_md5 FROM (""" + wiki_sql(where="doc_id = 0") + """) UNION ALL SELECT page_id, html_md5 FROM (
""" + wiki_sql(where="doc_id <> 0").replace("CASE WHEN i > 0 THEN '<h2>S ' || i || '</h2>' ELSE '' END", "''") + ")")


def _numbered(page, tokens):
    """Every heading gets its number and how many there are, which no column of one token knows; references go with what they hold."""
    headings = sum(t.kind == "start" and t.tag == "h2" for t in tokens)
    out, n, inside, gone = [], 0, False, -1
    for token in tokens:
        if token.seq <= gone:
            continue
        if token.kind == "start" and token.tag == "sup":
            gone = token.end_seq
            continue
        if token.tag == "h2":
            inside = token.kind == "start"
            n += inside
        elif inside and token.kind == "text":
            token = Row(**(token.asDict() | {"text": f"{n}/{headings} {token.text}"}))
        out.append(token)
    return ops.renumbered(out)


# cross-element logic in user code; the main page is left as it is
_cleaned("hook_page", lambda t: ops.transform_each_page(t, _numbered, skipped=F.col("page_id") == 0), """
SELECT page_id, html_md5 FROM (""" + wiki_sql(where="doc_id = 0") + """) UNION ALL SELECT page_id, html_md5 FROM (
""" + wiki_sql({4: EXTRAS[4].split("</sup>", 1)[1]}, where="doc_id <> 0").replace("'<h2>S ' || i ||", "'<h2>' || i || '/' || (max(i) OVER (PARTITION BY doc_id)) || ' S ' || i ||") + ")")


_MEDIA_SQL = wiki_sql({
    2: '<ul class="gallery"><li class="gallerybox"><img src="../@A@/P{k}.png" width="120" loading="lazy"></li><li class="gallerybox">t</li></ul>',
    9: '<figure><figcaption>f</figcaption></figure><span typeof="mw:File/Frameless"></span><figure><img src="../@I@/i.png" loading="lazy"></figure>',
    10: '<video poster="../@A@/V{k}.jpg" height="40" controls="40"><source src="../@V@/{k}.webm"></video><img src="data:image/png,z" loading="lazy">',
    12: '<audio controls="" src="../@V@/{k}.ogg"></audio>',
    14: '<video controls="40"><source src="../@V@/{k}.webm"><track src="../V{k}.webm-en.vtt"></video>',
    15: EXTRAS[15].replace('src="/im/n.png"', 'src="../@I@/n.png" loading="lazy"'),
})
for _mark, _dir in (("@A@", "https://img.example.org/"), ("@I@", "https://wiki.example.org/im/"), ("@V@", "https://wiki.example.org/v/")):
    _MEDIA_SQL = _MEDIA_SQL.replace(_mark, "_assets_/' || md5('" + _dir + "') || '")


@QUERIES.add(_MEDIA_SQL)
def media_attrs(spark, sf_dir):
    pages = wiki_pages(spark, sf_dir)
    tokens = html_tokens.tokenize(pages)
    path = F.concat(F.lit("Doc_"), F.col("page_id"), F.lit("/x"))
    return html_tokens.serialise(ops.media_attributes(tokens, views.SITE, path)).select("page_id", F.md5("html").alias("html_md5"))


_RENDERED_SQL = wiki_sql({
    0: '<div class="hatnote">see <a href="../Doc_{k}">x</a></div>', 1: "", 3: "", 5: '<sup id="r{k}">[2]</sup>', 6: "", 7: ("", '<div id="purgelink">x</div>'),
    2: '<ul class="gallery"><li class="gallerybox"><img src="../@A@/P{k}.png" width="120" loading="lazy"></li></ul>',
    8: '<div class="big thumb" style="color:red">y</div>', 9: '<figure><img src="../@I@/i.png" loading="lazy"></figure>',
    10: '<video poster="../@A@/V{k}.jpg" height="40" controls="40"><source src="../@V@/{k}.webm"></video><img src="data:image/png,z" loading="lazy">',
    11: '<a class="mw-kartographer-maplink" href="#">🌍</a><a class="external" href="https://www.youtube.com/watch?v=v{k}"><img width="9" src="../@Y@{k}@/hqdefault.jpg" alt="Video thumbnail" loading="lazy"></a>'
        '<div src="https://x.example.org/e?k={k}" class="mwo-external-video-card"><a class="external" href="https://x.example.org/e?k={k}">Open embedded content (external)</a></div>',
    12: '<audio controls="" src="../@V@/{k}.ogg"></audio>', 14: '<video controls="40"><source src="../@V@/{k}.webm"><track src="../V{k}.webm-en.vtt"></video>',
    15: '<ul class="gallery"><li class="gallerybox"></li></ul>',
    19: "<style>.b/a.png{background:url(../@S@/a.png)} i{background:url('../@J@/a.png')} p{src:url(../@S@/a.png)} b{src:url(data:b/a.png)}</style>",
}, drop_empty=True)
for _mark, _dir in (("@A@", "https://img.example.org/a/ab/"), ("@I@", "https://wiki.example.org/im/"), ("@V@", "https://wiki.example.org/v/"), ("@S@", "https://wiki.example.org/b/"), ("@J@", "https://wiki.example.org/im/b/")):
    _RENDERED_SQL = _RENDERED_SQL.replace(_mark, "_assets_/' || md5('" + _dir.replace("/a/ab/", "/") + "') || '")
_RENDERED_SQL = _RENDERED_SQL.replace("@Y@{k}@", "_assets_/' || md5('https://img.youtube.com/vi/v' || k || '/') || '")


@QUERIES.add(_RENDERED_SQL)
def render_pages(spark, sf_dir):
    """Pages through all steps: links, cleaning, media. The tokens are written once; from there on only titles leave their page."""
    tokens = html_tokens.tokenize_to_table(wiki_pages(spark, sf_dir), new_table_path(spark, "tokens"))
    path = F.concat(F.lit("Doc_"), F.col("page_id"), F.lit("/x"))
    titles = views.sections(spark, sf_dir).select(F.concat(F.lit("Doc "), F.col("doc_id") + F.col("section")).alias("title")).distinct()
    return html_tokens.serialise(rendering.render(tokens, links.known_titles(titles, titles.select(F.lower("title").alias("from_title"))), views.SITE, path)).select(
        "page_id", F.md5("html").alias("html_md5"))


@QUERIES.add("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'https://www.youtube.com/embed/v' || p_partkey || '?rel=0' WHEN 1 THEN '//youtu.be/v' || p_partkey
  WHEN 2 THEN 'https://www.youtube.com/watch?list=x' WHEN 3 THEN '/embed/' || p_partkey ELSE '' END AS src FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'thumbnail' WHEN 1 THEN 'thumbnail' WHEN 2 THEN 'link' WHEN 3 THEN 'card' ELSE 'delete' END AS kind,
  CASE p_partkey % 5 WHEN 0 THEN 'https://www.youtube.com/watch?v=v' || p_partkey WHEN 1 THEN 'https://www.youtube.com/watch?v=v' || p_partkey WHEN 2 THEN src
    WHEN 3 THEN 'https://wiki.example.org' || src END AS href,
  CASE WHEN p_partkey % 5 < 2 THEN 'https://img.youtube.com/vi/v' || p_partkey || '/hqdefault.jpg' END AS thumbnail FROM p""")
def iframe_replace(spark, sf_dir):
    k = F.col("p_partkey")
    src = (
        F.when(k % 5 == 0, F.concat(F.lit("https://www.youtube.com/embed/v"), k, F.lit("?rel=0"))).when(k % 5 == 1, F.concat(F.lit("//youtu.be/v"), k))
        .when(k % 5 == 2, F.lit("https://www.youtube.com/watch?list=x")).when(k % 5 == 3, F.concat(F.lit("/embed/"), k)).otherwise(F.lit("")))
    parts = views.table(spark, sf_dir, "part").select("p_partkey", src.alias("src"))
    return parts.select("p_partkey", ops.iframe_parts(F.col("src"), views.SITE).alias("x")).select("p_partkey", "x.*")


@QUERIES.add("""
WITH p AS (SELECT p_partkey, p_size, p_name, CASE WHEN p_size % 3 = 0 THEN p_size * 4 WHEN p_size % 3 = 1 THEN p_size * 3 WHEN p_size % 5 <> 0 THEN p_size * 10 END AS w,
  CASE WHEN p_size % 2 = 0 THEN p_size * 2 END AS h, CASE WHEN p_partkey % 4 <> 0 THEN p_name || ' & "' || p_partkey || '"' END AS alt FROM part),
q AS (SELECT *, coalesce(w, 1) AS sw, coalesce(h, 1) AS sh, coalesce(w >= 48 AND h >= 24, FALSE) AS roomy,
  replace(replace(alt, '&', '&amp;'), '"', '&quot;') AS safe FROM p)
SELECT p_partkey, CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height, '<svg xmlns="http://www.w3.org/2000/svg" width="' || sw || '" height="' || sh || '" viewBox="0 0 ' || sw || ' ' || sh
  || '" preserveAspectRatio="none">' || coalesce('<title>' || safe || '</title>', '')
  || CASE WHEN roomy THEN '<defs><clipPath id="alt-text-clip"><rect x="0" y="0" width="100%" height="100%" /></clipPath></defs>' ELSE '' END
  || '<rect width="100%" height="100%" fill="transparent"/>'
  || CASE WHEN roomy AND alt IS NOT NULL THEN '<g clip-path="url(#alt-text-clip)"><text x="50%" y="50%" text-anchor="middle" dominant-baseline="middle" fill="#54595d" font-size="'
       || greatest(10, least(16, sh // 3)) || '" font-family="sans-serif">' || safe || '</text></g>' ELSE '' END || '</svg>' AS svg FROM q""")
def image_placeholder(spark, sf_dir):
    size = F.col("p_size")
    pairs = [
        ("width", F.when(size % 3 == 0, (size * 4).cast("string"))), ("height", F.when(size % 2 == 0, (size * 2).cast("string"))),
        ("style", F.when(size % 3 == 1, F.concat(F.lit("color:red; width: "), size * 3, F.lit("px;"))).otherwise(F.lit("max-width: 5px"))),
        ("data-file-width", F.when(size % 5 != 0, (size * 10).cast("string"))),
        ("alt", F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("  "), "p_name", F.lit(' & "'), "p_partkey", F.lit('"'))).otherwise(F.lit("  "))),
    ]
    attrs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs]), lambda e: e["value"].isNotNull()))
    images = views.table(spark, sf_dir, "part").select("p_partkey", attrs.alias("attrs"))
    return images.select("p_partkey", ops.image_size(F.col("attrs"), "width").alias("width"), ops.image_size(F.col("attrs"), "height").alias("height"),
                         ops.placeholder_svg(F.col("attrs")).alias("svg"))


@QUERIES.add(with_views("pages", body=r"""
t AS (SELECT page_id, heading, title, regexp_replace(regexp_extract(html, '(?i)<title( [^>]*)?>(.*)</title>', 2), '<[^>]*>?', '', 'g') AS document_title FROM v_pages)
SELECT page_id, document_title, CASE WHEN page_id % 3 = 0 THEN title WHEN heading <> '' THEN heading ELSE title END AS display_text,
  CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN heading ELSE 'Main' END AS main_heading FROM t"""))
def title_text(spark, sf_dir):
    k = F.col("page_id")
    display = F.when(k % 3 == 0, F.lit("<i></i>")).otherwise(F.concat(F.lit("<i>"), "heading", F.lit("</i>")))
    override = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("-")).otherwise(F.lit("Main"))
    return views.pages(spark, sf_dir).select(
        "page_id", ops.document_title(F.col("html")).alias("document_title"), ops.title_text(display, F.col("title")).alias("display_text"),
        ops.main_page_heading(override, F.col("heading")).alias("main_heading"))


@QUERIES.add("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS last_edit, 'https://wiki.example.org/wiki/?title=Order_' || replace(url_encode(o_orderpriority), '%20', '_') || '&oldid=' || o_orderkey AS permalink,
  CASE o_orderkey % 3 WHEN 0 THEN 'CC &lt;BY' WHEN 1 THEN 'https://lic.example.org/' || o_orderstatus ELSE 'unknown' END AS license,
  CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 90) || ';' || (o_orderkey % 180) END AS geo_position FROM orders""")
def footer_facts(spark, sf_dir):
    key = F.col("o_orderkey")
    pages = views.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("Order "), "o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        key.alias("revision_id"), "o_orderstatus",
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.col("o_custkey") % 90, F.lit(";"), key % 180)).alias("coordinates"))
    facts = ops.footer_facts(pages, views.SITE, F.when(key % 3 == 0, F.lit("CC <BY")), F.when(key % 3 == 1, F.concat(F.lit("https://lic.example.org/"), "o_orderstatus")), "unknown")
    return facts.select("o_orderkey", "last_edit", "permalink", "license", "geo_position")


@QUERIES.add("""
WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT event_id, 'wgPageName' AS key, '"' || event_type || '"' AS value FROM e WHERE k % 4 <> 3
  UNION ALL SELECT event_id, 'wgArticleId', CAST(event_id AS VARCHAR) FROM e WHERE k % 4 <> 3
  UNION ALL SELECT event_id, 'wgAction', CASE WHEN k % 2 = 0 THEN '"view"' ELSE '"edit"' END FROM e WHERE k % 4 <> 3
  UNION ALL SELECT event_id, 'wgIsArticle', CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END FROM e WHERE k % 4 <> 3
  UNION ALL SELECT event_id, 'wgList', '[' || k || ',2]' FROM e WHERE k % 4 <> 3
  UNION ALL SELECT event_id, u.key, u.value FROM e, (VALUES ('wgBreakFrames', 'false'), ('wgUserName', 'null'), ('wgUserGroups', '["*"]'),
    ('wgIsProbablyEditable', 'false'), ('wgRelevantPageIsProbablyEditable', 'false'), ('wgExtra', '1')) u(key, value))
SELECT event_id, key, value FROM r""")
def page_config(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    config = F.concat(
        F.lit('{"wgBreakFrames":!1,"wgPageName":"'), "event_type", F.lit('","wgArticleId":'), "event_id", F.lit(',"wgUserId":'), "user_id", F.lit(',"wgAction":"'),
        F.when(k % 2 == 0, F.lit("nosuchaction")).otherwise(F.lit("edit")), F.lit('",\n"wgIsArticle": !'), F.when(k % 3 == 0, F.lit("0")).otherwise(F.lit("1")),
        F.lit(',"wgRequestId":"q","wgList":['), k, F.lit(',2]}'))
    head = F.when(k % 4 == 1, F.concat(F.lit("<script>{mw.config.set("), config, F.lit(");mw.loader.state({});"))).when(
        k % 4 == 3, F.lit("<head></head>")).otherwise(F.concat(F.lit('<script>RLPAGE=1;RLCONF='), config, F.lit(';\nRLSTATE={"a":"b"};')))
    events = spread(views.table(spark, sf_dir, "events")).select("event_id", ops.page_config(head, {"wgExtra": "1"}).alias("config"))
    return events.select("event_id", F.explode("config").alias("key", "value"))


@QUERIES.add(with_views("pages", body="""
t AS (SELECT page_id, lang, page_id % 2 = 0 AS even FROM v_pages)
SELECT page_id, 'lang-' || lang || ' action-view' || CASE WHEN even THEN ' x' ELSE '' END AS body_class,
  'skin-theme-clientpref-os ' || CASE WHEN even THEN 'vector-toc-not-available' ELSE 'vector-feature-toc-pinned-clientpref-0 vector-toc-not-available' END || ' l-' || lang AS html_class FROM t"""))
def css_class_norm(spark, sf_dir):
    even = F.col("page_id") % 2 == 0
    body = F.concat(F.lit("lang-"), "lang", F.lit("  action-nosuchaction mw-editable"), F.when(even, F.lit("  x")).otherwise(F.lit(" ")))
    html = F.concat(F.when(even, F.lit("skin-theme-clientpref-day ")).otherwise(F.lit("skin-theme-clientpref-night ")),
                    F.when(even, F.lit(" vector-toc-available")).otherwise(F.lit("vector-feature-toc-pinned-clientpref-1")), F.lit(" l-"), "lang")
    return views.pages(spark, sf_dir).select(
        "page_id", ops.normal_classes(body, c.BODY_CLASS_REPLACEMENTS).alias("body_class"), ops.normal_classes(html, c.HTML_CLASS_REPLACEMENTS).alias("html_class"))


@QUERIES.add(with_views("pages", body="SELECT page_id FROM v_pages WHERE html LIKE '%href=\"/the\"%' OR page_id = 0"))
def hook_keep(spark, sf_dir):
    tokens = html_tokens.tokenize(views.table(spark, sf_dir, "pages"))
    return ops.keep_pages(tokens, is_start("a") & (F.col("attrs")["href"] == "/the"), "page_id", main_page=F.col("page_id") == 0)


@QUERIES.add("""
WITH d AS (SELECT doc_id AS page_id, lang, '<body>' || CASE WHEN lang <> 'de' THEN '<details><summary><h2 id="fr" class="sectionlangue">F</h2></summary><p>f</p>'
    || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '<details><h3>s</h3></details>' END || '</details>' ELSE '' END || '</body>' AS kept FROM documents)
SELECT page_id, md5(replace(kept, '<summary>', '<summary style="display:none! important">')) AS html_md5 FROM d WHERE lang <> 'de'""")
def hook_language(spark, sf_dir):
    french = F.concat(F.lit('<details><summary><h2 id="fr" class="sectionlangue">F</h2></summary><p>f</p><details><h'), F.when(F.col("doc_id") % 2 == 0, "4>m</h4").otherwise("3>s</h3"),
                      F.lit("></details></details>"))
    other = F.concat(F.lit('<details><summary><h2 class="sectionlangue" id="'), "lang", F.lit('x">O</h2></summary><details><h3>i</h3></details></details>'))
    html = F.concat(F.lit("<body>"), other, F.when(F.col("lang") != "de", french).otherwise(F.lit("")), F.lit("</body>"))
    tokens = html_tokens.tokenize(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html")))
    return html_tokens.serialise(ops.keep_language_section(tokens, "fr")).select("page_id", F.md5("html").alias("html_md5"))
