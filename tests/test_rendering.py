"""A page through all content steps."""

import hashlib
import re

from pyspark.sql import functions as F

from corpusweave.functions.urls import Site
from corpusweave.operators import assets, content, links, rendering
from corpusweave.session import cut, new_table_path
from corpusweave.sources import html_tokens

SITE = Site(origin="https://en.wikipedia.org")
HTML = (
    '<html><body><section data-mw-section-id="0"><p about="#x">Lead <a href="/wiki/Here">here</a> <a href="/wiki/Gone">gone</a>'
    '<sup class="mw-ref reference"><a href="#c">[1]</a></sup></p><div class="hatnote">no link</div><link rel="x"><script>s("</p>")</script></section>'
    '<section data-mw-section-id="1"><h2>Media</h2><figure><img src="/im/a.png" srcset="y" width="9"></figure><figure><i>none</i></figure>'
    '<video width="50" height="10"><source src="/v/a.webm" data-width="40"><source src="/v/b.webm" data-width="60"></video>'
    '<span class="mw-editsection">e</span><iframe src="https://youtu.be/vid"></iframe></section>'
    '<section data-mw-section-id="2"><h2>Empty</h2></section></body></html>'
)


def folder(url):
    return "./_assets_/" + hashlib.md5(url.encode()).hexdigest() + "/"


def rendered(spark, flags):
    path = F.lit("Page")
    tokens = cut(html_tokens.tokenize(spark.createDataFrame([(1, HTML)], "page_id int, html string")))
    decided = links.classify(links.anchors(tokens).withColumn("page_path", path), SITE, flags)
    known = links.known_titles(spark.createDataFrame([("Here",)], "title string"), spark.createDataFrame([], "from_title string"))
    cleaned = cut(rendering.clean_pages(links.rewrite_links(tokens, decided, known), SITE, path, flags))
    return html_tokens.serialise(rendering.place_media(cleaned, SITE, path, flags)).first().html


def test_full_variant(spark):
    assert rendered(spark, links.Flags()) == (
        '<html><body><section data-mw-section-id="0"><p>Lead <a href="Here">here</a> gone<sup class="mw-ref reference"><a href="#c">[1]</a></sup></p></section>'
        f'<section data-mw-section-id="1"><h2>Media</h2><figure><img src="{folder("https://en.wikipedia.org/im/")}a.png" width="9" loading="lazy"></figure>'
        f'<video width="50" height="40" controls="40"><source src="{folder("https://en.wikipedia.org/v/")}b.webm" data-width="60"></video>'
        f'<a class="external" href="https://www.youtube.com/watch?v=vid"><img src="{folder("https://img.youtube.com/vi/vid/")}hqdefault.jpg" alt="Video thumbnail" loading="lazy"></a>'
        '</section></body></html>')


def test_lead_only_without_pictures(spark):
    assert rendered(spark, links.Flags(nopic=True, nodet=True)) == (
        '<html><body><section data-mw-section-id="0"><p>Lead <a href="Here">here</a> gone</p></section></body></html>')


def test_no_pictures(spark):
    out = rendered(spark, links.Flags(nopic=True))
    assert "<video" not in out and out.count("data:image/svg+xml") == 2 and "_assets_" not in out


def test_chain_shuffles_tokens_once_and_parses_them_nowhere(spark):
    path = F.concat(F.lit("Doc_"), F.col("page_id"))
    tokens = html_tokens.tokenize_to_table(spark.createDataFrame([(1, HTML), (2, HTML)], "page_id int, html string"), new_table_path(spark, "tokens"))
    known = links.known_titles(spark.createDataFrame([("Here",)], "title string"), spark.createDataFrame([], "from_title string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = rendering.render(tokens, known, SITE, path)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#\d+, ", plan)
    assert len(re.findall("Exchange hashpartitioning", plan)) == len(keys), "a shuffle by more than one column"
    # anchors are numbered by page and then looked up by title; tokens and verdicts meet by page
    assert sorted(keys) == sorted(["page_id"] * keys.count("page_id") + ["title"] * keys.count("title")) and keys.count("page_id") <= 2 and keys.count("title") <= 2
    assert "MapInArrow" not in plan and "CartesianProduct" not in plan


def test_empty_reference_spans_go_after_frames_made_gaps(spark):
    html = '<iframe src="https://youtu.be/v"></iframe><span rel="dc:references" id="r"></span><span rel="dc:references" id="q">[1]</span>'
    tokens = html_tokens.tokenize(spark.createDataFrame([(1, html)], "page_id int, html string"))
    out = html_tokens.serialise(content.reference_spans(content.replace_iframes(tokens, SITE))).first().html
    assert out.endswith('</a><sup id="q">[1]</sup>')


def test_classes_are_split_only_where_there_are_some(spark):
    html = '<div class="x y">t</div><p class="">u</p><i>v</i><b class="xy">w</b>'
    tokens = html_tokens.tokenize(spark.createDataFrame([(1, html)], "page_id int, html string"))
    asked = tokens.select("seq", "kind", "tag", content.has_class("x", "z").alias("has"))
    assert {(r.tag, r.has) for r in asked.collect() if r.kind == "start"} == {("div", True), ("p", False), ("i", False), ("b", False)}
    assert not any(r.has or r.has is None for r in asked.collect() if r.kind != "start")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("isnotnull(attrs") < plan.index("arrays_overlap")


def test_steps_that_share_a_pass_leave_what_they_leave_one_by_one(spark):
    frame = '<iframe class="{}" src="{}">in<b></iframe>'.format
    pages = [
        frame("mw-editsection", "https://youtu.be/v") + "<p>a</p>" + frame("noprint", "https://x.org/e"),
        '<span class="mw-editsection">e<link>' + frame("", "https://youtu.be/v") + "</span>t" + frame("", "") + "u" + frame("ab", "https://www.youtube.com/"),
        '<ul class="gallery"><li class="gallerybox"><i class="noprint"><img></i></li><li class="gallerybox">x</li></ul><div class="noprint"><p class="noprint">y</p></div>z',
        '<div id="purgelink">1<script>s</script><p id="purgelink">2</p></div><p id="purgelink">3</p><script>t</script><section><h2>h</h2></section>',
        '<a href="">gone<i class="mw-editsection">e</i></a><a class="new" href="/r">kept<link></a><a href="/wiki/Here">h</a>',
        '<video><source src="a.webm"><source src="b.vp9.webm"><div><source src="c.webm"></div></video><source src="d"><audio></audio><video><img src="e.png"></video>',
        '<span rel="dc:references" id="r"><span rel="dc:references"></span><span>s</span></span><span rel="dc:references"><link></span>',
    ]
    tokens = cut(html_tokens.tokenize(spark.createDataFrame([*enumerate(pages)], "page_id int, html string")))
    known = links.known_titles(spark.createDataFrame([("Here",)], "title string"), spark.createDataFrame([], "from_title string"))
    decided = links.classify(links.anchors(tokens).withColumn("page_path", F.lit("Page")), SITE)
    steps = [
        lambda t: links.rewrite_links(t, decided, known), content.remove_edit_links, content.remove_tags, lambda t: content.replace_iframes(t, SITE),
        content.remove_empty_galleries, content.remove_classes, content.remove_linkless, content.reference_spans, content.remove_ids, content.remove_scripts,
        content.remove_empty_sections, assets.prune_sources,
    ]
    alone = together = tokens
    for step in steps:
        alone, together = cut(step(alone)), step(together)
    assert together.columns == tokens.columns
    assert sorted(map(str, together.collect())) == sorted(map(str, alone.collect()))
    html = {r.page_id: r.html for r in html_tokens.serialise(together).collect()}
    card = '<div src="https://www.youtube.com/" class="ab mwo-external-video-card"><a class="external" href="https://www.youtube.com/">Open embedded content (external)</a></div>'
    assert html[0] == "<p>a</p>" and html[1] == "tu" + card
    assert html[2] == '<ul class="gallery"><li class="gallerybox"></li></ul>z' and html[3] == '<p id="purgelink">3</p>' and html[4] == 'kept<a href="Here">h</a>'
    assert html[5] == '<video><source src="b.vp9.webm"><div></div></video><source src="d">' and html[6] == '<sup id="r"><span>s</span></sup>'


def test_chain_puts_tokens_in_order_few_times(spark):
    tokens = html_tokens.tokenize_to_table(spark.createDataFrame([(1, HTML), (2, HTML)], "page_id int, html string"), new_table_path(spark, "tokens"))
    known = links.known_titles(spark.createDataFrame([("Here",)], "title string"), spark.createDataFrame([], "from_title string"))
    plan = rendering.render(tokens, known, SITE, F.lit("Page"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[page_id", plan)) <= 6 and len(re.findall(r"\bWindow \[", plan)) <= 20
