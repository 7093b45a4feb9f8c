"""Wiki-style HTML derived from ``documents``: one section per line, with the elements the cleaning steps look for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.plans.layout import spread
from corpusweave.sources.views import table

# element added to section i of document d, chosen by (d + i) modulo their number; {k} is d + i
EXTRAS = [
    '<div class="hatnote">see <a href="./Doc_{k}">x</a></div>',
    '<div class="hatnote">no link</div>',
    '<ul class="gallery"><li class="gallerybox"><img src="//img.example.org/a/ab/P{k}.png" width="120" srcset="x 2x"></li><li class="gallerybox">t</li></ul>',
    '<ul class="gallery mw-x"><li class="gallerybox"><span>none</span></li></ul>',
    '<sup class="reference"><a href="#c">[1]</a></sup><ol class="mw-references-wrap"><li>r</li></ol><span class="mw-ext-cite-error">e</span>',
    '<span rel="dc:references" id="r{k}" class="z">[2]</span><span rel="dc:references"></span>',
    '<span class="mw-editsection">[<a href="/edit">edit</a>]</span><link rel="stylesheet" href="x"><input type="text" value="{k}">',
    '<div id="purgelink">x</div><div class="noprint big">n<p>q</p></div>',
    '<div class="plainlinks big thumb" about="#m" data-mw="{}" style="display:none;color:red">y</div>',
    '<figure><figcaption>f</figcaption></figure><span typeof="mw:File/Frameless"></span><figure><img src="/im/i.png"></figure>',
    '<video poster="//img.example.org/a/ab/V{k}.jpg" height="20"><source src="/v/{k}.webm"></video><img src="./Special:FilePath/x.png"><img src="data:image/png,z">',
    '<a class="mw-kartographer-maplink" href="#">48 N <b>2</b> E</a><script>if (a < b) { run("</p>"); }</script>'
    '<iframe width="9" src="https://www.youtube.com/embed/v{k}"></iframe><iframe src="https://x.example.org/e?k={k}"></iframe><iframe></iframe>',
    '<audio controls="" src="/v/{k}.ogg"></audio>',
    '<svg><path d="M{k}"/><g><circle r="1"/></g></svg><math><mspace width="1"/><mi>a</mi></math>',
    '<video><source src="/v/{k}.webm"><track src="/w/api.php?title=V{k}.webm&amp;lang=en&amp;trackformat=srt"></video>',
    '<ul class="gallery"><li class="gallerybox"><ul class="gallery"><li><img src="/im/n.png"></li></ul></li></ul>',
    '<p>a<b>b</p><p>c</b>d{k}</p>',
    '<table>m<tr><td>{k}<td><i>x<p>y</i>z</table></p>',
    '<b>1<i>2<div>3</b>4</i>5</div>',
    "<style>.b/a.png{background:url(b/a.png)} i{background:url('im/b/a.png')} p{src:url(b/a.png)} b{src:url(data:b/a.png)}</style>",
]
# as they are written back: empty elements of drawings and formulas have an end tag, and the tree is the one that browsers make
WRITTEN = [
    *EXTRAS[:13], '<svg><path d="M{k}"></path><g><circle r="1"></circle></g></svg><math><mspace width="1"></mspace><mi>a</mi></math>', *EXTRAS[14:16],
    '<p>a<b>b</b></p><p><b>c</b>d{k}</p>',
    'm<table><tbody><tr><td>{k}</td><td><i>x</i><p><i>y</i>z</p></td></tr></tbody></table><p></p>',
    '<b>1<i>2</i></b><i></i><div><i><b>3</b>4</i>5</div>',
    EXTRAS[19],
]
MIN_WORDS = 4


def wiki_pages(spark: SparkSession, sf_dir: str, extras: list[str] | None = None) -> DataFrame:
    """page_id, page_path, lang, html. Built inside each row, without a shuffle."""
    extras = extras or EXTRAS

    def section(line: Column, i: Column) -> Column:
        k = (F.col("doc_id") + i).cast("string")
        body = F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        extra = F.replace(F.get(F.array(*[F.lit(e) for e in extras]), (F.col("doc_id") + i) % len(extras)), F.lit("{k}"), k)
        # only so many words are looked at, where a split would copy them all
        filled = F.when(F.substring_index(line, " ", MIN_WORDS - 1) != line, F.concat(F.lit("<p>"), body, F.lit("</p>"), extra)).otherwise(F.lit(""))
        heading = F.when(i > 0, F.concat(F.lit("<h2>S "), i.cast("string"), F.lit("</h2>"))).otherwise(F.lit(""))
        return F.concat(F.lit('<section data-mw-section-id="'), i.cast("string"), F.lit('">'), heading, filled, F.lit("</section>"))

    sections = F.array_join(F.transform(F.split("text", "\n"), section), "")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("Doc_"), "doc_id", F.lit("/x")).alias("page_path"), "lang",
        F.concat(F.lit("<html><head><title>Doc "), "doc_id", F.lit("</title></head><body>"), sections, F.lit("</body></html>")).alias("html"))


def wiki_sql(changed: dict[int, str | tuple[str, str]] | None = None, first_only: bool = False, lead_only: bool = False, drop_empty: bool = False, where: str = "TRUE") -> str:
    """SQL for (page_id, html_md5) of these pages with some extras replaced: what a cleaning step should leave. A pair holds for the first of
    its kind on a page and for the others."""
    changed = changed or {}
    quote = lambda e: "replace('" + e.replace("'", "''") + "', '{k}', CAST(k AS VARCHAR))"
    after = " ".join(f"WHEN k % {len(EXTRAS)} = {n} {'AND nth = 1' if first_only else ''} THEN {quote(e)}" for n, e in changed.items() if isinstance(e, str))
    after += "".join(f" WHEN k % {len(EXTRAS)} = {n} AND nth = 1 THEN {quote(e[0])} WHEN k % {len(EXTRAS)} = {n} THEN {quote(e[1])}" for n, e in changed.items() if not isinstance(e, str))
    before = " ".join(f"WHEN k % {len(EXTRAS)} = {n} THEN {quote(e)}" for n, e in enumerate(WRITTEN))
    extra = f"CASE {after} {before} END"
    keep = " AND ".join(["TRUE", *(["i = 0"] if lead_only else []), *(["words >= 4"] if drop_empty else [])])
    return f"""
WITH l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS arr FROM documents WHERE {where}),
u AS (SELECT doc_id, unnest(arr) AS line, unnest(range(len(arr))) AS i FROM l),
w0 AS (SELECT doc_id, i, doc_id + i AS k, len(string_split(line, ' ')) AS words, replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body FROM u),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k % {len(EXTRAS)}, words >= 4 ORDER BY i) AS nth FROM w0),
s AS (SELECT doc_id, i, words, '<section data-mw-section-id="' || i || '">' || CASE WHEN i > 0 THEN '<h2>S ' || i || '</h2>' ELSE '' END
  || CASE WHEN words >= 4 THEN '<p>' || body || '</p>' || {extra} ELSE '' END || '</section>' AS piece FROM w),
g AS (SELECT doc_id, coalesce(string_agg(CASE WHEN {keep} THEN piece END, '' ORDER BY i), '') AS pieces FROM s GROUP BY doc_id)
SELECT doc_id AS page_id, md5('<html><head><title>Doc ' || doc_id || '</title></head><body>' || pieces || '</body></html>') AS html_md5 FROM g"""
