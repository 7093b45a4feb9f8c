"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block elements. The first pass decides each block by itself: by the element it stands in, where the page says what that
is (navigation, form, advert, article, ...), else by the share of its text in links, its length and its share of stop words. Blocks that are
too short or too plain to tell stay open; in the second pass they take the label of the nearest decided neighbours before and after them.
In a declared article, what is not declared something else, nor a list of links, is content.

Null and empty pages give the empty text. Broken markup is read as far as it goes: unclosed elements end with an outer one, a tag or comment
cut off by the page's end ends there. Pages are read whole, nothing is capped. Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.rows import map_documents

SHORT, LONG = 60, 150
MANY_LINKS, LINK_LIST = 0.4, 0.75
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.10, 0.22

#: Common function words of the languages that pages are expected in.
STOP_WORDS = frozenset((
    "a an and are as at be but by for from had has have he her his i if in is it its not of on or she so than that the their them there they this to was we were "
    "what when which who will with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind "
    "so über um und von vor war was wenn wie wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sur un une vous à "
    "al como con de del el ella en entre era es esta este ha la las lo los más me no nos o para pero por que se si sin sobre son su sus un una y ya"
).split())

BREAKING = frozenset((
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul"
).split())
#: Elements whose place in the tree is kept; all others only end blocks or are inline.
NESTING = frozenset("article aside blockquote body details div dl fieldset figure footer form head header main menu nav ol section table td ul".split())
NOT_CONTENT = frozenset("aside footer form head menu nav".split())
#: Words of class, id and role that say that an element is not the main text, or that it is.
NOT_CONTENT_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog "
    "disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promoted "
    "related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
).split())
CONTENT_NAMES = frozenset("article content entry main post story".split())
#: Of what is not content by its names, what holds articles of its own; in others, an article or main inside shows that they wrap the page.
OF_OTHERS = frozenset((
    "ad ads adv advert adverts advertisement advertising comment comments disqus promo promoted related reply replies respond sponsor sponsored"
).split())
#: A class as in "with-sidebar" says what the element holds, not what it is.
HOLDING = frozenset("has have no with without".split())
SPLIT_NAMES = re.compile(r"[^a-z]+")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""\shidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)"
    r"|<(script|style)\b(?s:.*?)(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.I)
#: Elements that are left out with all in them, if they end; else their tag alone is.
EMBEDDED = frozenset("noscript template svg iframe object canvas select textarea button audio video".split())
#: What ends them or, for the last three, shows that they have ended: their next start, or HTML elements outside of foreign ones.
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in (*EMBEDDED, "foreignobject", "desc", "title")} | {
    "button": re.compile(r"</button\s*>|<button\b", re.I),
    "select": re.compile(r"</select\s*>|<(?:select|input|textarea)\b", re.I),
    "svg": re.compile(
        r"</svg\s*>|<(foreignobject|desc|title)\b|<(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby"
        r"|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var|article|aside|section|main|header|footer|nav|figure)(?=[\s/>])", re.I)}
WORDS = re.compile(r"[^\W\d_]+")

CONTENT, OTHER, OPEN = 1, 0, None
#: Other than content by its names, as far as no article or main in it says more.
NAMED = 2


@dataclass
class Block:
    text: str
    density: float  # share of its letters in links
    links: int
    declared: int | None
    label: int | None = OPEN


def declaration(tag: str, attributes: str, outer: int | None) -> int | None:
    """What an element says about its content. Inside what is not content nothing is, but an article in what only names call so; a header of an article
    belongs to it."""
    if outer == OTHER:
        return OTHER
    if outer == NAMED:
        return CONTENT if tag in ("article", "main") and not HIDDEN.search(attributes) else OTHER if tag in NOT_CONTENT or HIDDEN.search(attributes) else NAMED
    if tag in NOT_CONTENT or tag == "header" and outer is None or HIDDEN.search(attributes):
        return OTHER
    names = set()
    for found in NAMES.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            words = set(SPLIT_NAMES.split(name))
            if not words & HOLDING:
                names |= words
    if tag not in ("article", "main", "body") and names & NOT_CONTENT_NAMES:
        return OTHER if names & OF_OTHERS else NAMED
    return CONTENT if tag in ("article", "main") or tag != "body" and names & CONTENT_NAMES else outer


def embedded_end(page: str, tag: str, at: int, endless: set[str]) -> int | None:
    """Where an embedded element ends whose start tag ends at ``at``; None if it doesn't. ``endless``: elements with no end in the rest of the page."""
    while tag not in endless:
        found = ENDS[tag].search(page, at)
        if not found:
            endless.add(tag)
        elif found[0].startswith("</"):
            return found.end()
        elif tag != "svg":
            return None
        elif not found[1]:
            return found.start()
        else:
            at = embedded_end(page, found[1].lower(), found.end(), endless) or found.end()
    return None


def tags(page: str) -> Iterator[tuple[re.Match, int]]:
    """Tags, comments and other markup, and where the text goes on after each; embedded elements count as one."""
    at, endless = 0, set()
    while token := TOKEN.search(page, at):
        at, tag = token.end(), (token[3] or "").lower()
        if tag in EMBEDDED and not token[2] and not (tag == "svg" and token[4].endswith("/")):
            at = embedded_end(page, tag, at, endless) or at
        yield token, at


def blocks(page: str) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple[str, int | None]] = []
    text: list[str] = []
    linked: list[str] = []
    links, in_link, breaks = 0, False, 0

    def flush() -> None:
        nonlocal links, breaks
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            letters = sum(map(len, html.unescape("".join(linked)).split()))
            found.append(Block(joined, letters / (len(joined) - joined.count(" ")), links, stack[-1][1] if stack else None))
        text.clear()
        linked.clear()
        links, breaks = 0, 0

    at = 0
    for token, after in tags(page):
        plain = page[at:token.start()]
        at = after
        if plain:
            text.append(plain)
            if plain.strip():
                breaks = 0
            if in_link:
                linked.append(plain)
        closing, tag = token[2], (token[3] or "").lower()
        if tag == "br":
            text.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
        elif tag == "a":
            in_link = not closing
            links += not closing
        elif tag in BREAKING:
            flush()
            if closing:
                in_link = False
                if tag in NESTING and any(name == tag for name, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
            elif tag in NESTING:
                if tag == "body":
                    stack.clear()
                stack.append((tag, declaration(tag, token[4], stack[-1][1] if stack else None)))
    plain = page[at:]
    text.append(plain)
    if in_link:
        linked.append(plain)
    flush()
    return found


def first_pass(block: Block) -> int | None:
    """What is declared goes by that, all else by its text, whatever other parts of the page are declared to be."""
    density = block.density
    if block.declared in (OTHER, NAMED):
        return OTHER
    if block.declared == CONTENT:
        return OTHER if block.links > 2 and density > LINK_LIST else CONTENT
    if density > MANY_LINKS:
        return OTHER
    if len(block.text) < SHORT:
        return OTHER if block.links else OPEN
    words = WORDS.findall(block.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= MANY_STOP_WORDS:
        return CONTENT if len(block.text) >= LONG else OPEN
    return OPEN if stop >= FEW_STOP_WORDS else OTHER


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearer decided one, at equal distance of the next, as headings stand before what they head;
    the page's ends count as other than content. Where no block is decided to be content, the open ones are it."""
    if not any(b.label == CONTENT for b in found):
        for block in found:
            block.label = CONTENT if block.label is OPEN else block.label
        return
    ahead: list[tuple[int, int]] = []
    place, label = len(found), OTHER
    for i in range(len(found) - 1, -1, -1):
        if found[i].label is not OPEN:
            place, label = i, found[i].label
        ahead.append((place, label))
    ahead.reverse()
    place, label = -1, OTHER
    for i, block in enumerate(found):
        if block.label is not OPEN:
            place, label = i, block.label
        else:
            block.label = label if i - place < ahead[i][0] - i else ahead[i][1]


def extract(page: str) -> str:
    found = blocks(page)
    for block in found:
        block.label = first_pass(block)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == CONTENT)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def start():
        def each(page_id, url, page):
            text = extract(page)
            yield page_id, url, text, len(text)

        return each

    return map_documents(pages, ["page_id", "url", F.coalesce("html", F.lit("")).alias("html")], schema, start)
