"""Golden cases of single operators."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave.functions.urls import Site
from corpusweave.operators import assets, catalogue, categories, content, dependencies, links, outputs, quality, redirects, variants
from corpusweave.sources import html_tokens

SITE = Site(origin="https://en.wikipedia.org")
DEEP, FLAT = "London/City_Example", "London"
COMMONS = "../_assets_/0c70a452f799bfe840676ee341124611/"

HILLS, PIER = Site(origin="https://hills.example.net"), "Harbour/North_Pier"
SOUNDS = "../_assets_/" + hashlib.md5(b"https://files.example.org/m/").hexdigest() + "/"
LINKS = [
    # page path, href, rel, class, resource -> action, href
    ("Harbour", "/wiki/Old_Mill", "", "", None, "wiki", "Old_Mill"),
    (PIER, "/wiki/Old_Mill", "", "", None, "wiki", "../Old_Mill"),
    (PIER, "/wiki/Ferry#Fares", "mw:WikiLink", "", None, "wiki", "../Ferry#Fares"),
    (PIER, "/wiki/Valley/West_side", "", "", None, "wiki", "../Valley/West_side"),
    (PIER, "https://hills.example.net/wiki/Old_Mill", "", "", None, "wiki", "../Old_Mill"),
    (PIER, "/wiki/Quarry", "nofollow", "mirror-link", None, "wiki", "../Quarry"),
    (PIER, "./Ghost", "nofollow", "", None, "unwrap", None),
    (PIER, "/wiki/Not_written_yet", "", "new", None, "unwrap", None),
    (PIER, "", "", "", None, "delete", None),
    (PIER, "", "", "mw-selflink selflink", None, "keep", ""),
    (PIER, "#timetable", "", "", None, "keep", "#timetable"),
    (PIER, "geo:12.5,-3.25", "mw:ExtLink", "", None, "keep", "geo:12.5,-3.25"),
    # 12 degrees 30 minutes 36 seconds are 12.51 degrees
    (PIER, "//geo.example.org/geohack/geohack.php?pagename=Hill&params=12_30_36_N_3_15_0_W_type:hill", "mw:ExtLink", "", None, "geo", "geo:12.51,-3.25"),
    (PIER, "/wiki/Special:Map/5/10.25/-20.5/fr", "", "", None, "geo", "geo:10.25,-20.5"),
    (PIER, "/w/index.php?oldid=7", "", "", None, "external", "https://hills.example.net/w/index.php?oldid=7"),
    (PIER, "http://shop.example.com", "mw:ExtLink", "", None, "external", "http://shop.example.com"),
    (PIER, "https://shop.example.com/a?b=c", "", "", None, "external", "https://shop.example.com/a?b=c"),
    (PIER, "//cdn.example.com", "", "", None, "external", "https://cdn.example.com"),
    (PIER, "//files.example.org/m/1/12/B%C3%A4r.ogg", "", "", "./Media:Bär.ogg", "media", SOUNDS + "B%C3%A4r.ogg"),
    (PIER, "//files.example.org/m/3/34/Owl.oga", "", "", "./Media:Owl.oga", "media", SOUNDS + "Owl.oga"),
]


def test_links(spark):
    rows = [(i, *case[:5]) for i, case in enumerate(LINKS)]
    df = spark.createDataFrame(rows, "i int, page_path string, href string, rel string, class string, resource string")
    decided = links.classify(df, HILLS)
    got = [(r.action, r.new_href) for r in links.final_hrefs(decided).orderBy("i").collect()]
    assert got == [case[5:] for case in LINKS]


def test_links_are_rewritten_in_the_page(spark):
    html = ('<p><a href="/wiki/Here" rel="mw:WikiLink">h</a><a href="/wiki/Gone"><b>g</b></a><a class="new" href="/wiki/Red">r</a><a>empty</a>'
            '<a href="//x.org/y" title="t">x</a><area href="/wiki/Old#s"></p>')
    tokens = html_tokens.tokenize(spark.createDataFrame([(1, html)], "page_id int, html string"))
    decided = links.classify(links.anchors(tokens).withColumn("page_path", F.lit(DEEP)), SITE)
    known = links.known_titles(spark.createDataFrame([("Here",)], "title string"), spark.createDataFrame([("Old",)], "from_title string"))
    out = html_tokens.serialise(links.rewrite_links(tokens, decided, known)).first().html
    assert out == ('<p><a href="../Here" rel="mw:WikiLink">h</a><b>g</b>r<a href="https://x.org/y" title="t" class="external">x</a><area href="../Old#s"></p>')


def test_keyed_catalogue(spark):
    pages = spark.createDataFrame([("A", 1), ("B", 2)], "title string, n int")
    asked = spark.createDataFrame([("A",), ("Z",)], "title string")
    assert {(r.title, r.exists) for r in catalogue.existing(asked, pages).collect()} == {("A", True), ("Z", False)}
    assert [r.title for r in catalogue.delete(pages, asked).collect()] == ["B"]


def test_unresolved_links_are_unwrapped_and_redirects_kept(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",)], "title string")
    known = links.known_titles(spark.createDataFrame([("A",)], "title string"), spark.createDataFrame([("B",), ("A",)], "from_title string"))
    assert {r.title: r.state for r in links.resolve(df, known).collect()} == {"A": "page", "B": "redirect", "C": "unwrap"}


def video(spark, display, *sources):
    rows = [("v", i, src, width, display) for i, (src, width) in enumerate(sources)]
    df = spark.createDataFrame(rows, "video string, pos int, src string, width int, display_width int")
    return [r.src for r in assets.choose_video_source(df, "video").collect()]


def test_video_source(spark):
    sources = [("a.120p.vp9.webm", 120), ("a.160p.webm", 160), ("a.320.webm", 320), ("a.320.vp9.webm", 320), ("a.webm", 780)]
    assert video(spark, 300, *sources) == ["a.320.vp9.webm"]
    assert video(spark, 800, *sources) == ["a.webm"]
    assert video(spark, 0, *sources) == ["a.webm"]
    assert video(spark, 300, ("a.ogv", 300)) == []
    assert video(spark, 300, ("x.webm", 300), ("y.webm", 300)) == ["x.webm"]
    assert video(spark, 300, ("x.vp9.webm", 300), ("y.vp9.webm", 300)) == ["y.vp9.webm"]


def test_audio_source(spark):
    def choose(*sources):
        df = spark.createDataFrame([("a", i, *s) for i, s in enumerate(sources)], "audio string, pos int, src string, type string")
        return assets.choose_audio_source(df, "audio").first().src

    assert choose(("x.mp3", "audio/mpeg"), ("x.ogg", None), ("y.ogg", None)) == "x.ogg"
    assert choose(("x.mp3", "audio/mpeg"), ("x.wav", "audio/wav")) == "x.mp3"
    assert choose(("x.oga", "audio/ogg; codecs=vorbis"), ("x.ogg", None)) == "x.oga"


def test_media_sources_of_elements(spark):
    html = ('<video width="300" src="/v/own.webm"><source src="/v/a.webm" data-width="780"><source src="/v/b.webm" data-file-width="320"><source src="/v/c.ogv" data-width="300"></video>'
            '<video src="/v/d.webm"></video><video src="/v/e.ogv"></video><audio resource="//up.org/f.mp3"></audio>'
            '<audio src="/x.mp3"><source src="/v/g.mp3" type="audio/mpeg"><source src="/v/h.oga" type="audio/ogg; codecs=v"></audio>')
    tokens = html_tokens.tokenize(spark.createDataFrame([(1, html)], "page_id int, html string"))
    got = [r.url for r in assets.media_sources(tokens, SITE).orderBy("seq").collect()]
    assert got == ["https://en.wikipedia.org/v/b.webm", "https://en.wikipedia.org/v/d.webm", "https://up.org/f.mp3", "https://en.wikipedia.org/v/h.oga"]


def test_document_title(column):
    rows = ["<title>a <i>b</i></title>", "<title lang='x'>\nc\n</title>", "<p>none</p>"]
    assert column(rows, "h string", content.document_title(F.col("h"))) == ["a b", "\nc\n", ""]


def test_best_resolution(spark):
    url = "https://upload.wikimedia.org/wikipedia/commons/thumb/3/39/A.jpg/{}px-A.jpg"
    rows = [(1, url.format(60), None), (2, url.format(220), None), (3, url.format(100), 300), (4, url.format(90), 300)]
    df = assets.with_paths(spark.createDataFrame(rows, "seq long, url string, width long"))
    best = assets.best_resolution(df, [F.col("seq")], ["seq"]).collect()
    assert [(r.seq, r.width) for r in best] == [(3, 300)]
    full = assets.with_paths(spark.createDataFrame([*rows, (9, "https://upload.wikimedia.org/wikipedia/commons/3/39/A.jpg", None)], df.drop("path").schema))
    assert assets.best_resolution(full, [F.col("seq")], ["seq"]).first().seq == 9


def cleaned(spark, html, step):
    tokens = html_tokens.tokenize(spark.createDataFrame([(1, html)], "page_id int, html string"))
    return html_tokens.serialise(step(tokens)).first().html


def test_parser_closes_what_html_closes(spark):
    html = '<p><b>x<br><p>y</p><ul><li>1<li>2</ul><script>if (a<b) {"</p>"}</script><!-- c -->&amp;&nbsp;<td>'
    want = ('<p><b>x<br></b></p><p><b>y</b></p><ul><li><b>1</b></li><li><b>2</b></li></ul><script>if (a<b) {"</p>"}</script><!-- c --><b>&amp;&nbsp;</b>')  # bold goes on, a cell needs a table
    assert cleaned(spark, html, lambda t: t) == want


def test_reference_call_spans(spark):
    html = '<span rel="dc:references" id="a" class="c">[<i>1</i>]</span><span rel="dc:references"></span><span>k</span>'
    assert cleaned(spark, html, content.reference_spans) == '<sup id="a">[<i>1</i>]</sup><span>k</span>'


def test_galleries(spark):
    box, full = '<li class="gallerybox">t</li>', '<li class="gallerybox"><img src="a"></li>'
    cases = {
        f'<ul class="gallery">{box}{full}</ul>': f'<ul class="gallery">{full}</ul>',
        f'<ul class="gallery">{box}</ul>': "",
        '<ul class="gallery"><li><img src="a"></li></ul>': "",
        f'<ul class="gallery"><li class="gallerybox"><ul class="gallery">{box}</ul><img src="b"></li></ul>': '<ul class="gallery"><li class="gallerybox"><img src="b"></li></ul>',
        f"{full}{box}": full,
    }
    for html, want in cases.items():
        assert cleaned(spark, f"<div>{html}</div>", content.remove_empty_galleries) == f"<div>{want}</div>"


def test_iframes(spark):
    cases = {
        "<iframe></iframe>": "",
        '<iframe src="https://youtu.be/abc-_1"></iframe>':
            '<a class="external" href="https://www.youtube.com/watch?v=abc-_1"><img src="https://img.youtube.com/vi/abc-_1/hqdefault.jpg" alt="Video thumbnail" loading="lazy"></a>',
        '<iframe src="https://www.youtube.com/watch?x"></iframe>':
            '<a class="external" href="https://www.youtube.com/watch?x" aria-label="View this content externally">View this content externally</a>',
        '<iframe class="k" src="/e">t</iframe>':
            '<div src="/e" class="k mwo-external-video-card"><a class="external" href="https://en.wikipedia.org/e">Open embedded content (external)</a></div>',
    }
    for html, want in cases.items():
        assert cleaned(spark, f"<p>{html}</p>", lambda t: content.replace_iframes(t, SITE)) == f"<p>{want}</p>"


def test_video_thumbnail_is_an_asset(spark):
    tokens = html_tokens.tokenize(spark.createDataFrame([(1, '<p>a<iframe width="70" src="https://youtu.be/abc">x</iframe>b</p><img src="/q.png">')], "page_id int, html string"))
    replaced = content.replace_iframes(tokens, SITE)
    refs = assets.token_refs(replaced, SITE).orderBy("seq").collect()
    assert [(r.url, r.width) for r in refs] == [("https://img.youtube.com/vi/abc/hqdefault.jpg", 70), ("https://en.wikipedia.org/q.png", None)]
    # the spread numbers still nest
    assert html_tokens.serialise(content.drop_subtrees(replaced, F.col("tag") == "p")).first().html == '<img src="/q.png">'


def test_empty_section_with_heading_only(spark):
    html = '<section><h2>a</h2></section><section><div class="mw-heading">b</div><p>t</p></section><section><section><h2>c</h2></section></section>'
    want = '<section><div class="mw-heading">b</div><p>t</p></section><section></section>'
    assert cleaned(spark, html, content.remove_empty_sections) == want


def test_map_links_show_one_globe(spark):
    def link(inner):
        return f'<a class="mw-kartographer-maplink">{inner}</a>'

    cases = {link("<b>1</b>2") + "t" + link("3"): link("🌍") + "t" + link("🌍"), link("<i></i>"): link("<i></i>"), link("<b>1</b>") + link("<i></i>") + "t": link("🌍") + link("<i></i>") + "t"}
    for html, want in cases.items():
        assert cleaned(spark, f"<p>{html}</p>", content.globe_map_links) == f"<p>{want}</p>"


def test_placeholders_keep_formulas(spark):
    html = '<img class="mwe-math-fallback-image-inline" src="/m.svg"><img alt="x" width="60" height="30" src="/p.png" srcset="q">'
    out = cleaned(spark, html, content.image_placeholders)
    assert out.startswith('<img class="mwe-math-fallback-image-inline" src="/m.svg"><img alt="x" width="60" height="30" src="data:image/svg+xml;charset=UTF-8,%3Csvg')
    assert "srcset" not in out and 'loading="lazy"' in out


def test_page_config(column):
    head = 'x;RLCONF={"wgBreakFrames":!1,"wgA":{"b":[1]},"wgUserId":5,"wgIs": !0,"wgAction":"nosuchaction"};\nRLSTATE={}'
    (got,) = column([head], "h string", content.page_config(F.col("h")))
    assert got == {"wgA": '{"b":[1]}', "wgIs": "true", "wgAction": '"view"', "wgBreakFrames": "false", "wgUserName": "null", "wgUserGroups": '["*"]',
                   "wgIsProbablyEditable": "false", "wgRelevantPageIsProbablyEditable": "false"}


def test_flavours(column):
    cases = {"": "", "nopic": "nopic", "nopic:nopic-alias": "nopic-alias", "nopic,nopdf": "nopic", "nopic,nopdf:pdf-alias": "pdf-alias", "nopic,:extra-alias": "extra-alias",
             "nopic:": "", "nopic,nodet": "nopic-nodet", "nodet,nopic": "nopic-nodet", "novid": "novid", "novid,nodet": "nodet"}
    assert column(list(cases), "f string", variants.format_flags(F.col("f"))["flavour"]) == list(cases.values())


def failure(**given):
    base = dict(url="https://x.org/w/api.php?action=parse&format=json&page=A", error_code=None, http=200, content_type="application/json", raw_body=None, json_body=None)
    return tuple({**base, **given}.values())


@pytest.mark.parametrize("given, rule", [
    (dict(json_body='{"error":{"code":"nope"}}'), None),
    (dict(http=404, raw_body=""), 1),
    (dict(raw_body="x Page has been deleted. y"), 2),
    (dict(json_body='{"error":{"code":"permissiondenied"}}'), 4),
    (dict(http=504, json_body='{"error":{"code":"internal_api_error_Wikimedia\\\\RequestTimeout\\\\RequestTimeoutException"}}'), 7),
    (dict(http=504, url="https://x.org/rest", json_body='{"error":{"code":"internal_api_error_Wikimedia\\\\RequestTimeout\\\\RequestTimeoutException"}}'), None),
    (dict(json_body='{"warnings":{"result":{"*":"This result was truncated because"}}}'), 16),
    (dict(json_body='{"warnings":{"result":{"x":"This result was truncated because"}}}'), None),
    (dict(http=500, content_type="text/html; charset=UTF-8", raw_body=""), 17),
])
def test_error_rules(spark, given, rule):
    df = spark.createDataFrame([failure(**given)], "url string, error_code string, http long, content_type string, raw_body string, json_body string")
    assert quality.with_first_rule(df).first().rule_no == rule


def test_numeric_collation():
    assert categories.is_numeric_collation("numeric") and categories.is_numeric_collation("uca-fr-u-kn")
    assert not categories.is_numeric_collation("uca-fr") and not categories.is_numeric_collation("uppercase")


def test_css_imports_and_conditions(spark):
    sheets = spark.createDataFrame([("https://x.org/a/m.css", '@import url("b.css") supports(display: grid) screen;@IMPORT \'../c.css\';.x{background:url(i.png)}@import "";')], "url string, body string")
    rows = [(r.pos, r.dst, r.supports, r.media) for r in dependencies.css_imports(sheets).orderBy("pos").collect()]
    assert rows == [(0, "https://x.org/a/b.css", "display: grid", "screen"), (1, "https://x.org/c.css", "", "")]
    assert [r.full_url for r in dependencies.css_urls(sheets).collect()] == ["https://x.org/a/i.png"]


def test_index_path_needs_a_free_candidate(spark):
    taken = spark.createDataFrame([("index",), ("home",)], "title string")
    none = spark.createDataFrame([], "from_title string")
    assert outputs.index_path(taken, none).first().index_path == "welcome"
    full = spark.createDataFrame([(x,) for x in ("index", "welcome", "home", "Main_Page")], "title string")
    assert outputs.index_path(full, none).isEmpty()
    assert outputs.index_path(none.withColumnRenamed("from_title", "title"), none).first().index_path == "index"


def test_index_is_a_list_below_eleven_images(spark):
    pages = spark.createDataFrame([(f"P{i}", i < 10) for i in range(20)], "title string, has_image boolean")
    listed = spark.createDataFrame([(i, f"P{i}") for i in range(20)] + [(20, "R"), (21, "gone")], "pos int, title string")
    redirect = spark.createDataFrame([("R", "P3")], "from_title string, to_title string")
    rows = outputs.index_entries(listed.filter("pos <> 20"), pages, redirect).orderBy("pos").collect()
    assert [r.title for r in rows] == [f"P{i}" for i in range(20)] and {r.layout for r in rows} == {"list"}
    # the redirect leads to an eleventh entry with an image
    rows = outputs.index_entries(listed, pages, redirect).orderBy("pos").collect()
    assert [r.title for r in rows] == [*[f"P{i}" for i in range(10)], "P3"] and {r.layout for r in rows} == {"tiles"}


def test_redirect_stub_and_truncation(spark):
    df = spark.createDataFrame([("a b", "C d", "my part"), ("x" * 300, "Y", "")], "from_title string, to_title string, fragment string")
    rows = {r.path: r for r in redirects.routed(df).collect()}
    assert (rows["a_b"].route, rows["a_b"].target) == ("stub", "C_d#my_part")
    assert (rows["x" * 300].route, rows["x" * 300].title) == ("redirect", "x" * 240)
    assert {r.route for r in redirects.routed(df, lead_only=True).collect()} == {"ignored", "redirect"}


def test_catalogue_keeps_absent_fields_absent(spark):
    from corpusweave.sources.batches import PAGE_RECORD

    df = spark.createDataFrame([(dict(title="A", ns=0, contentmodel="wikitext"),)], f"p {PAGE_RECORD}").select("p.*")
    row = catalogue.catalogue_rows(df).first()
    assert row.title == "A" and all(v is None for k, v in row.asDict().items() if k != "title")


def test_inline_styles(spark):
    html = "<style>a{background:url('/im/x.png')} b{background:url(data:z)} c{src:url(\"../im/x(1).woff\")}</style><p>url(k)</p>"
    folder = "../_assets_/" + __import__("hashlib").md5(b"https://en.wikipedia.org/im/").hexdigest()
    want = html.replace("/im/x.png", folder + "/x.png", 1).replace("../im/x(1).woff", folder + "/x%281%29.woff")
    assert cleaned(spark, html.replace("x(1)", "x%281%29"), lambda t: dependencies.rewrite_inline_styles(t, SITE, F.lit(DEEP))) == want


def test_page_deps(spark):
    html = '<img src="/im/a.png" width="50"><a href="//up.example.org/im/s.ogg" resource="./Media:s">s</a><style>p{background:url(/im/b.png)}</style>'
    tokens = html_tokens.tokenize(spark.createDataFrame([(1, html)], "page_id int, html string"))
    anchors = links.classify(links.anchors(tokens).withColumn("page_path", F.lit("A")), SITE)
    sheets = dependencies.inline_sheets(tokens, SITE)
    styles = sheets.select("page_id", F.lit("https://en.wikipedia.org/im/b.png").alias("full_url"))
    assert [r.full_url for r in dependencies.css_urls(sheets).collect()] == ["https://en.wikipedia.org/im/b.png"]
    deps = assets.page_deps(assets.token_refs(tokens, SITE), anchors, styles)
    assert sorted((r.url, r.kind, r.width) for r in deps.collect()) == [
        ("https://en.wikipedia.org/im/a.png", "image", 50), ("https://en.wikipedia.org/im/b.png", "media", None), ("https://up.example.org/im/s.ogg", "media", None)]


def test_list_file(spark, tmp_path):
    from corpusweave.sources.page_list import read_list_file

    (tmp_path / "list.txt").write_bytes(b"Main_Page\r\n\r\n Brian May\nA_B\n")
    assert [r.title for r in read_list_file(spark, str(tmp_path / "list.txt")).orderBy("pos").collect()] == ["Main Page", " Brian May", "A B"]


def test_require_empty(spark):
    quality.require_empty(spark.range(0), "none")
    with pytest.raises(ValueError, match="too many: .*'id': 0"):
        quality.require_empty(spark.range(3), "too many")


def test_urls_of_a_sheet_are_replaced_where_they_stand(spark):
    """One URL inside another, in a selector and in a comment; the same one twice; data and empty ones."""
    body = "/* x/a.png */ .x/a.png{b:url(x/a.png)} i{b:url('y/x/a.png')}b{b:URL(\"x/a.png\")}u{b:url(data:x/a.png)}url()"
    x, y = (f"../_assets_/{hashlib.md5(f'https://h.example.net/s/{d}/'.encode()).hexdigest()}/a.png" for d in ("x", "y/x"))
    sheets = spark.createDataFrame([(body,), ("no url",), ("",), (None,)], "body string")
    got = sheets.select(dependencies.local_urls(F.col("body"), "https://h.example.net/s/main.css", lambda p: F.concat(F.lit("../"), p))).collect()
    want = f"/* x/a.png */ .x/a.png{{b:url({x})}} i{{b:url('{y}')}}b{{b:URL(\"{x}\")}}u{{b:url(data:x/a.png)}}url()"
    assert [r[0] for r in got] == [want, "no url", "", None]


def test_flattened_sheets_keep_their_own_urls(spark):
    """An import beside a url() of the same text: only what stands after the import is an asset."""
    base = "https://h.example.net/s/"
    rows = [(base + "m.css", '@import url("n.css");i{b:url(n.css)}n.css{}'), (base + "n.css", "b{b:url(p/n.css)}")]
    sheets = spark.createDataFrame(rows, "url string, body string")
    text = dependencies.css_flatten_text(spark.createDataFrame([(base + "m.css",)], "root string"), dependencies.css_imports(sheets), sheets).first().text
    one, two = (f"../_assets_/{hashlib.md5((base + d).encode()).hexdigest()}/n.css" for d in ("", "p/"))
    assert text == (f"\n/* start {base}m.css */\n\n\n/* start {base}n.css */\n\nb{{b:url({two})}}\n/* end   {base}n.css */\ni{{b:url({one})}}n.css{{}}\n/* end   {base}m.css */\n")


def test_a_hook_sees_one_page_at_a_time(spark):
    pages = [(i, f"<body><p>{i}</p><i>a</i><p>b<br></p></body>") for i in range(6)] + [(9, "")]
    tokens = html_tokens.tokenize(spark.createDataFrame(pages, "page_id int, html string"))

    def last_paragraph_first(page, rows):
        assert {r.page_id for r in rows} == {page} and [r.seq for r in rows] == sorted(r.seq for r in rows)
        starts = [r for r in rows if r.kind == "start" and r.tag == "p"]
        moved = [r for r in rows if starts[-1].seq <= r.seq <= starts[-1].end_seq]
        return content.renumbered([rows[0], *moved, *[r for r in rows[1:] if r not in moved]])

    out = content.transform_each_page(tokens, last_paragraph_first, skipped=F.col("page_id") == 3)
    assert out.columns == tokens.columns
    got = {r.page_id: r.html for r in html_tokens.serialise(out).collect()}
    assert got == {i: pages[3][1] if i == 3 else f"<body><p>b<br></p><p>{i}</p><i>a</i></body>" for i in range(6)}
    again = {r.page_id: r.html for r in html_tokens.serialise(content.drop_subtrees(out, F.col("tag") == "p")).collect()}
    assert set(again.values()) == {"<body><i>a</i></body>"}


def test_a_hook_parses_pages_once_also_where_some_are_skipped(spark):
    tokens = html_tokens.tokenize(spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>b</p>")], "page_id int, html string"))
    out = content.transform_each_page(tokens, lambda page, rows: rows[1:-1], skipped=(F.col("page_id") == 1) | (F.col("kind") == "end"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2, "one to parse, one for the hook"
    # tokens that are skipped stay, those of the same page that are not are what the function sees
    assert sorted((r.page_id, r.seq, r.kind) for r in out.collect()) == [(1, 0, "start"), (1, 1, "text"), (1, 2, "end"), (2, 2, "end")]


def test_a_hook_sees_plain_values_and_may_change_attributes_in_place(spark):
    html = '<p id="a" class="">x<br data-y="&amp;1"><!--c--></p>'
    tokens = html_tokens.tokenize(spark.createDataFrame([(1, html)], "page_id long, html string")).withColumns({
        "lost": F.when(F.col("seq") == 1, F.lit(None)).otherwise(F.col("seq").cast("long")), "extra": F.create_map(F.lit("k"), "seq"), "part": F.lit(0.5)})
    want = sorted(map(tuple, tokens.collect()), key=lambda r: r[1])

    def step(page, rows):
        assert [*map(tuple, rows)] == [(*r[:-2], [*r[-2].items()], r[-1]) for r in want]
        assert {type(v) for r in rows for v in r} <= {int, str, dict, list, float, type(None)}
        rows[0].attrs["class"] = "z"
        rows[2].attrs.clear()
        return rows

    out = sorted(content.transform_each_page(tokens, step).collect(), key=lambda r: r.seq)
    assert out[0].attrs == {"id": "a", "class": "z"} and out[2].attrs == {}
    assert [(*r[:6], *r[7:]) for r in out] == [(*r[:6], *r[7:]) for r in want] and [r.attrs for r in out[3:]] == [r[6] for r in want[3:]]


def test_values_of_columns_are_those_of_to_pylist():
    pairs = pa.array([[("a", "1"), ("b", "2")], None, [], [("c", None)], [("d", "é")]], pa.map_(pa.string(), pa.string()))
    for begin, length in ((0, 5), (1, 3), (3, 2), (2, 1), (1, 0)):
        part = pairs.slice(begin, length)
        dicts = content.attribute_dicts(part)
        assert dicts == [None if p is None else dict(p) for p in part.to_pylist()]
        assert content.attribute_maps(dicts, pairs.type).equals(pa.array([None if d is None else [*d.items()] for d in dicts], pairs.type))
    for column in (pa.array([1, None, 2**62], pa.int64()), pa.array([1, 2], pa.int32()), pa.array(["a", None]), pa.array([True, None]), pa.array([], pa.int32())):
        assert content.python_values(column) == column.to_pylist()
