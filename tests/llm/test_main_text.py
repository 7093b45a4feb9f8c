import pytest

from corpusweave.llm import main_text

PROSE = "the man of the house was in it and it was good for all of us to be there, as we had been before. " * 3
CASES = {
    "an article without what surrounds it": (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body><header>Site</header><nav><ul><li><a href=1>One</a></ul></nav>"
        "<!-- ad --><div class='ad'>Buy the thing and be good.</div><article><h1>Head</h1><p><b>First.<br><p>Second &amp; third</p><form>Name <input></form>"
        "<p>Short.</p><section class='comments'><p>I like it</p></section></article><aside>See also</aside><footer>&copy; me</footer></body></html>",
        "Head\nFirst.\nSecond & third\nShort."),
    "named containers": (
        "<body><div class='cookie-notice'>We use them.</div><div id='content'><h2>Head</h2><p>One &lt;b&gt; two<br><br>three &nbsp; x <a href=x>l</a></p>"
        "<div class='share-bar'><a>f</a></div></div><div id=sidebar>x</div>", "Head\nOne <b> two\nthree x l"),
    "rules alone": (f"<body><ul><li><a href=1>Home</a><li><a>News</a></ul><h1>A head</h1><p>{PROSE}<p>Short.<p>{PROSE}<table><tr><td>Copyright</table>",
                    f"A head\n{PROSE.strip()}\nShort.\n{PROSE.strip()}"),
    "a header in an article": ("<header>Site</header><article><header><h1>Head</h1></header>Text</article>", "Head\nText"),
    "cut off in a tag": ("<article><p>one</p><p>two &am</p><p class='x", "one\ntwo &am"),
    "cut off in a comment": ("<article><p>one<!-- two", "one"),
    "cut off in a script": ("<article><p>one<script>two", "one"),
    "text only": ("just a few words", "just a few words"),
    "signs": ("<article>1 < 2 && 3 > 2 &#233;&eacute;&unknown;</article>", "1 < 2 && 3 > 2 éé&unknown;"),
    "hidden": ("<article>a<div hidden>b</div><div style='display: none'>c</div><div aria-hidden='true'>d</div></article>", "a"),
    "a list of links": ("<main><p>Text</p><ul><li><a href=1>x</a> <a href=2>y</a> <a href=3>z</a></li></ul></main>", "Text"),
    "white space": ("<article>\n a\t b\r\n\r\n c </article>", "a b c"),
    "nothing": ("", ""),
    "navigation only": ("<nav><a href=1>x</a></nav>", ""),
}

#: Embedded elements that are empty, end by what follows, or don't end.
EMBEDDED = {
    "an icon": ("<article><p>one</p><svg class='i'/><p>two</p><svg viewBox='0 0 1 1' /><p>three</p><svg><path d=1 /></svg></article>", "one\ntwo\nthree"),
    "an svg ended by html": ("<article><p>one</p><svg><path d=1><text>x</text><p>two</p></article>", "one\ntwo"),
    "html in an svg": ("<article>one<svg><foreignObject><p>two</p></foreignObject><text>x</text></svg><p>three</article>", "one\nthree"),
    "open to the end": ("<article><p>one</p><canvas><p>two</p><iframe><object><video><p>three</p></article>", "one\ntwo\nthree"),
    "a button without end": ("<article><p>one</p><button><p>two</p><button>x</button><select><option><p>three</p><input><p>four</p></article>", "one\ntwo\nthree\nfour"),
    "ended ones": ("<article>one<button>a</button><select><option>b</select><canvas><p>c</canvas><object>d</object><textarea><p>e</textarea><p>two</article>", "one\ntwo"),
}

#: Pages that declare only a part of their main text, or a wrapper of it by a name.
PARTLY = {
    "a story beside a teaser card": (f"<body><nav><a href=1>Home</a></nav><div><p>{PROSE}</p><p>{PROSE}</p></div><article><a href=2>More</a></article>", f"{PROSE.strip()}\n{PROSE.strip()}\nMore"),
    "a story below its data": (f"<body><div class='post-meta'>By A</div><div><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div>", f"By A\n{PROSE.strip()}\nShort.\n{PROSE.strip()}"),
    "a wrapper that holds a sidebar": (f"<div class='page with-sidebar'><p>{PROSE}</p><div class=sidebar>x</div></div>", PROSE.strip()),
    "an article in a wrapper": ("<div class='sidebar layout'><div>menu</div><article><p>One</p></article><div>x</div></div>", "One"),
    "articles that are comments": ("<article>One</article><div class=comments><article>I like it</article></div>", "One"),
    "an article in a hidden place": ("<main>One</main><div class=modal><div hidden><article>x</article></div></div><aside><article>y</article></aside>", "One"),
}


@pytest.mark.parametrize("name", PARTLY)
def test_declarations_are_no_verdict_on_the_rest_of_the_page(name):
    page, text = PARTLY[name]
    assert main_text.extract(page) == text


@pytest.mark.parametrize("name", EMBEDDED)
def test_embedded_elements(name):
    page, text = EMBEDDED[name]
    assert main_text.extract(page) == text


def test_embedded_elements_stay_linear():
    for page in ("<svg>" * 50_000, "<button>" * 50_000, "<svg><title></title>" * 20_000 + "<desc>", "<svg><desc>" * 20_000, "<canvas>" * 50_000, "<select><input>" * 20_000):
        main_text.extract(page)


@pytest.mark.parametrize("name", CASES)
def test_extract(name):
    page, text = CASES[name]
    assert main_text.extract(page) == text


def test_quotes_and_nesting_stay_linear():
    for page in ("<" * 50_000, "<a title=\"" * 5_000, "<div>" * 20_000 + "x", "<!--" * 20_000, "<b a='>'>" * 10_000 + "y"):
        main_text.extract(page)


def test_pages(spark):
    rows = [(1, "u", "<article>é</article>"), (None, None, None), (1, "u", "<article>é</article>"), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    assert sorted(map(str, map(tuple, main_text.main_texts(pages).collect()))) == sorted(map(str, [(1, "u", "é", 1), (1, "u", "é", 1), (2, "v", "", 0), (None, None, "", 0)]))
    assert main_text.main_texts(pages.limit(0)).count() == 0
