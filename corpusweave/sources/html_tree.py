"""One page's HTML to token rows, with the tree that browsers build: implied ends, formatting that goes on across blocks, content moved out of tables.

Two steps, both linear in the page: a scan by one pattern, which feeds a stack of open elements and a list of active formatting elements; and a walk over
the finished tree that numbers tokens in document order. Text keeps its entities, so that serialising gives back the same bytes. Unlike in browsers
``html``, ``head`` and ``body`` aren't made up where a page leaves them out, and ``select`` and ``template`` have no rules of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

# fixed values: names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li dd dt main menu nav ol p pre listing search section summary table ul xmp plaintext".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKERS = frozenset("applet marquee object td th caption".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta "
    "nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot "
    "th thead title tr track ul wbr xmp".split())
SCOPE = frozenset("applet caption html table td th marquee object template foreignobject desc annotation-xml".split())
BUTTON_SCOPE, LIST_SCOPE, TABLE_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}, frozenset("html table template".split())
RAW_TEXT = frozenset("script style textarea title iframe noembed noframes xmp".split())
ROWS, CELLS = frozenset("tbody thead tfoot".split()), frozenset(("td", "th"))
TABLE_PARTS = ROWS | {"table", "tr"}
IN_TABLE = ROWS | CELLS | {"caption", "col", "colgroup", "tr"}
FOREIGN, HTML_IN_FOREIGN = frozenset(("svg", "math")), frozenset(("foreignobject", "annotation-xml", "desc"))
LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong "
    "strike sub sup table tt u ul var".split())

# starts and ends that, outside tables, need no more than a look at an open paragraph (blocks), at formatting (inlines) or at the current element (ends)
BLOCKS = CLOSES_P - HEADINGS - {"form", "li", "dd", "dt"}
PLAIN = frozenset("script style link meta title param source track template".split())
OTHER_STARTS = (CLOSES_P | IN_TABLE | FORMATTING | MARKERS | FOREIGN | frozenset(
    "html head body form button option optgroup rb rp rt rtc script style link meta title param source track template".split()))
OTHER_ENDS = FORMATTING | MARKERS | IN_TABLE | VOID | {"html", "body", "table", "form"}

NAME_AND_VALUE = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?+"""
ATTRIBUTES = re.compile(NAME_AND_VALUE)
MARKUP = re.compile(
    r"<(?:(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:" + re.sub(r"\((?=[^?])", "(?:", NAME_AND_VALUE) + r")*+)[\s/]*+>|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|!--(?P<comment>>|->|.*?(?:--!?>|\Z))|!(?P<doctype>(?i:doctype)[^>]*+)>|(?P<bogus>[!?/][^>]*+)>)", re.S)
COMMENT_END = re.compile(r"-{0,2}!?>?\Z")

START, END, TEXT, COMMENT, DOCTYPE = "start", "end", "text", "comment", "decl"


class Node:
    __slots__ = ("attrs", "kids", "kind", "parent", "tag", "text")

    def __init__(self, kind: str, tag: str | None = None, attrs: list | None = None, text: str | None = None, parent: Node | None = None):
        self.kind, self.tag, self.attrs, self.text, self.parent = kind, tag, attrs, text, parent
        self.kids: list[Node] | tuple = [] if kind == START else ()

    def like(self) -> Node:
        return Node(START, self.tag, self.attrs)

    def leave(self) -> None:
        if self.parent is not None:
            kids = self.parent.kids
            for at in range(len(kids) - 1, -1, -1):  # what moves is among the last
                if kids[at] is self:
                    del kids[at]
                    break
            self.parent = None

    def take(self, node: Node, at: int | None = None) -> None:
        node.leave()
        node.parent = self
        if at is None:
            self.kids.append(node)
        else:
            self.kids.insert(at, node)


class Builder:
    def __init__(self) -> None:
        self.root = Node(START, "")
        self.open = [self.root]
        self.active: list[Node | None] = []  # None is a marker
        self.form: Node | None = None
        self.foster = False
        self.drawn: list[Node] = []  # foreign elements that may still be open

    # ---- places

    def place(self, target: Node | None = None) -> tuple[Node, int | None]:
        """Where a node goes: into the current one or, out of a table's structure, in front of the table."""
        target = target or self.open[-1]
        if self.foster and target.tag in TABLE_PARTS:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "table":
                    table = self.open[i]
                    if table.parent is not None:
                        kids = table.parent.kids
                        return table.parent, next(at for at in range(len(kids) - 1, -1, -1) if kids[at] is table)
                    return self.open[i - 1], None
        return target, None

    def insert(self, node: Node, opens: bool = True) -> Node:
        if self.foster:
            parent, at = self.place()
            parent.take(node, at)
        else:
            node.parent = parent = self.open[-1]
            parent.kids.append(node)
        if opens:
            self.open.append(node)
            if node.tag in FOREIGN:
                self.drawn.append(node)
        return node

    def append(self, tag: str, attrs: list) -> None:
        """``insert`` of an element that isn't a drawing, where nothing is moved out of a table."""
        parent = self.open[-1]
        node = Node(START, tag, attrs, None, parent)
        parent.kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def text(self, data: str) -> None:
        if not data.isspace():
            if self.open[-1].tag in TABLE_PARTS:
                self.foster = True
            if self.active:
                self.reconstruct()
        if not self.foster:
            parent = self.open[-1]
            kids = parent.kids
            if kids and kids[-1].kind == TEXT:
                kids[-1].text += data
            else:
                kids.append(Node(TEXT, None, None, data, parent))
            return
        parent, at = self.place()
        before = parent.kids[(len(parent.kids) if at is None else at) - 1] if (len(parent.kids) if at is None else at) else None
        if before is not None and before.kind == TEXT:
            before.text += data
        else:
            parent.take(Node(TEXT, text=data), at)
        self.foster = False

    # ---- the stack

    def in_scope(self, tags, scope=SCOPE) -> bool:
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in scope:
                return False
        return False

    def pop_to(self, tags) -> None:
        while len(self.open) > 1 and self.open.pop().tag not in tags:
            pass

    def imply_ends(self, but: str | None = None) -> None:
        while self.open[-1].tag in IMPLIED_END and self.open[-1].tag != but:
            self.open.pop()

    def close_p(self) -> None:
        for node in reversed(self.open):
            tag = node.tag
            if tag == "p":
                self.imply_ends("p")
                self.pop_to(("p",))
                return
            if tag in BUTTON_SCOPE:
                return

    def foreign(self) -> bool:
        while self.drawn and self.drawn[-1] not in self.open:
            self.drawn.pop()
        if not self.drawn:
            return False
        for node in reversed(self.open):
            if node.tag in FOREIGN or node.tag in HTML_IN_FOREIGN:
                return node.tag in FOREIGN
        return False

    # ---- active formatting elements

    def since_marker(self) -> int:
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                return i + 1
        return 0

    def clear_to_marker(self) -> None:
        del self.active[max(0, self.since_marker() - 1):]

    def activate(self, node: Node) -> None:
        same = [i for i in range(self.since_marker(), len(self.active)) if self.active[i].tag == node.tag and self.active[i].attrs == node.attrs]
        if len(same) >= 3:
            del self.active[same[0]]
        self.active.append(node)

    def reconstruct(self) -> None:
        """Formatting that is still active goes on in the current block."""
        first = len(self.active)
        while first and self.active[first - 1] is not None and self.active[first - 1] not in self.open:
            first -= 1
        for i in range(first, len(self.active)):
            self.active[i] = self.insert(self.active[i].like())

    def adopt(self, tag: str) -> None:
        """The end of a formatting element which may lie in another block than its start."""
        if self.open[-1].tag == tag and self.open[-1] not in self.active:
            self.open.pop()
            return
        if self.active and self.active[-1] is self.open[-1] and self.open[-1].tag == tag:  # nothing between its start and its end
            self.open.pop()
            self.active.pop()
            return
        for _ in range(8):
            element = next((n for n in reversed(self.active[self.since_marker():]) if n.tag == tag), None)
            if element is None:
                self.other_end(tag)
                return
            if element not in self.open:
                self.active.remove(element)
                return
            if not self.in_scope((tag,)):
                return
            at = self.open.index(element)
            block = next((n for n in self.open[at + 1:] if n.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.active.remove(element)
                return
            above, bookmark, last = self.open[at - 1], self.active.index(element), block
            i = self.open.index(block)
            count = 0
            while True:
                i -= 1
                node = self.open[i]
                if node is element:
                    break
                count += 1
                if count > 3 and node in self.active:
                    gone = self.active.index(node)
                    bookmark -= gone < bookmark
                    del self.active[gone]
                if node not in self.active:
                    del self.open[i]
                    continue
                copy = node.like()
                self.active[self.active.index(node)] = self.open[i] = copy
                if last is block:
                    bookmark = self.active.index(copy) + 1
                copy.take(last)
                last = copy
            last.leave()
            self.foster = True
            parent, where = self.place(above)
            self.foster = False
            parent.take(last, where)
            copy = element.like()
            for kid in block.kids:
                kid.parent = copy
            copy.kids, block.kids = block.kids, []
            block.take(copy)
            gone = self.active.index(element)
            bookmark -= gone < bookmark
            del self.active[gone]
            self.active.insert(bookmark, copy)
            self.open.remove(element)
            self.open.insert(self.open.index(block) + 1, copy)

    # ---- tags

    def start(self, tag: str, attrs: list, closed: bool) -> None:
        if self.drawn and self.foreign():
            if tag not in LEAVES_FOREIGN and not (tag == "font" and any(n in ("color", "face", "size") for n, _ in attrs)):
                self.insert(Node(START, tag, attrs), not closed)
                return
            while self.foreign():
                self.open.pop()
        current = self.open[-1].tag
        if current not in TABLE_PARTS and not self.foster:
            if tag in BLOCKS:
                self.close_p()
                self.append(tag, attrs)
                return
            if tag not in OTHER_STARTS:
                if self.active:
                    self.reconstruct()
                self.append(tag, attrs)
                return
            if tag in HEADINGS:
                self.close_p()
                if self.open[-1].tag in HEADINGS:
                    self.open.pop()
                self.append(tag, attrs)
                return
            if tag in PLAIN:
                self.append(tag, attrs)
                return
            if tag in FORMATTING and not self.active and tag != "nobr":
                self.append(tag, attrs)
                self.active.append(self.open[-1])
                return
        if tag in IN_TABLE and not self.table_part(tag):
            return
        if tag in ("html", "body") and (same := next((n for n in self.open if n.tag == tag), None)) is not None:
            same.attrs += [pair for pair in attrs if pair[0] not in dict(same.attrs)]
            return
        if tag == "body" and current == "head":
            self.open.pop()
        if tag == "form":
            if self.form is not None:
                return
        if tag not in IN_TABLE and current in TABLE_PARTS and tag not in ("script", "style", "template") and not (tag == "input" and dict(attrs).get("type", "").lower() == "hidden"):
            if tag == "table" and self.in_scope(("table",), TABLE_SCOPE):
                self.pop_to(("table",))
            else:
                self.foster = True
        if tag == "li" or tag in ("dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.tag in same:
                    self.imply_ends(node.tag)
                    self.pop_to((node.tag,))
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
        if tag in CLOSES_P:
            self.close_p()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        elif tag == "button" and self.in_scope(("button",)):
            self.imply_ends()
            self.pop_to(("button",))
        elif tag in ("option", "optgroup") and self.open[-1].tag == "option":
            self.open.pop()
        elif tag in ("rb", "rp", "rt", "rtc") and self.in_scope(("ruby",)):
            self.imply_ends(None if tag in ("rb", "rtc") else "rtc")
        elif tag == "a" and (old := next((n for n in reversed(self.active[self.since_marker():]) if n.tag == "a"), None)) is not None:
            self.adopt("a")
            for held in (self.active, self.open):
                if old in held:
                    held.remove(old)
        elif tag == "nobr" and self.in_scope(("nobr",)):
            self.reconstruct()
            self.adopt("nobr")
        if tag not in CLOSES_P and tag not in IN_TABLE and tag not in ("script", "style", "head", "body", "html", "link", "meta", "title", "param", "source", "track", "template"):
            self.reconstruct()
        node = self.insert(Node(START, tag, attrs), tag not in VOID and not (closed and tag in FOREIGN))
        self.foster = False
        if tag in FORMATTING:
            self.activate(node)
        elif tag in MARKERS:
            self.active.append(None)
        elif tag == "form":
            self.form = node

    def table_part(self, tag: str) -> bool:
        """Brings the stack to where a part of a table belongs; rows and row groups that were left out are made. False if there is no table."""
        if not self.in_scope(("table",), TABLE_SCOPE):
            return False
        if tag in CELLS or tag == "tr":
            stop = ("tr", *ROWS, "table") if tag in CELLS else (*ROWS, "table")
        else:
            stop = ("colgroup", "table") if tag == "col" else ("table",)
        while self.open[-1].tag not in stop:
            if self.open.pop().tag in MARKERS:
                self.clear_to_marker()
        for made, under in (("tbody", ("table",)), ("tr", tuple(ROWS))):
            if (tag in CELLS or tag == "tr" and made == "tbody") and self.open[-1].tag in under:
                self.insert(Node(START, made, []))
        if tag == "col" and self.open[-1].tag == "table":
            self.insert(Node(START, "colgroup", []))
        return True

    def end(self, tag: str) -> None:
        last = self.open[-1]
        if last.tag == tag and tag not in OTHER_ENDS:
            self.open.pop()
        elif last.tag == tag and tag in FORMATTING and self.active and self.active[-1] is last:  # nothing between its start and its end
            self.open.pop()
            self.active.pop()
        elif tag in ("html", "body") and any(n.tag == tag for n in self.open):
            while self.open[-1].tag not in ("body", "html", "head", ""):
                self.open.pop()
            self.active.clear()
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag == "p":
            if not self.in_scope(("p",), BUTTON_SCOPE):
                self.foster = self.open[-1].tag in TABLE_PARTS
                self.insert(Node(START, "p", []))
                self.foster = False
            self.close_p()
        elif tag == "br":
            self.start("br", [], False)
        elif tag in IN_TABLE or tag == "table":
            if self.in_scope((tag,), TABLE_SCOPE):
                while (node := self.open.pop()).tag != tag:
                    if node.tag in MARKERS:
                        self.clear_to_marker()
                if tag in MARKERS:
                    self.clear_to_marker()
        elif tag == "li":
            if self.in_scope(("li",), LIST_SCOPE):
                self.imply_ends("li")
                self.pop_to(("li",))
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_to(HEADINGS)
        elif tag == "form":
            form, self.form = self.form, None
            if form is not None and form in self.open:
                self.imply_ends()
                if form in self.open:
                    self.open.remove(form)
        elif tag in CLOSES_P or tag in ("button", "applet", "marquee", "object"):
            if self.in_scope((tag,)):
                self.imply_ends(tag if tag in ("dd", "dt") else None)
                self.pop_to((tag,))
                if tag in MARKERS:
                    self.clear_to_marker()
        elif tag not in VOID:
            self.other_end(tag)

    def other_end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in SPECIAL:
                return

    # ---- the scan

    def feed(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            begin = html.find("<", at)
            found = MARKUP.match(html, begin) if begin >= 0 else None
            while begin >= 0 and found is None:  # a "<" that is text, or a tag that the page's end cuts off
                if html[begin + 1:begin + 2].isalpha() and html.find(">", begin) < 0:
                    size = begin
                    break
                begin = html.find("<", begin + 1)
                found = MARKUP.match(html, begin) if begin >= 0 else None
            stop = min(size, begin if begin >= 0 else size)
            if stop > at:
                self.text(html[at:stop])
            if found is None:
                return
            at = found.end()
            kind = found.lastgroup
            if kind == "end":
                self.end(found["end"].lower())
            elif kind == "attrs":
                tag, written = found.group("tag", "attrs")
                tag, pairs = tag.lower(), {}
                if written:
                    for name, value in ATTRIBUTES.findall(written):
                        if value[:1] in ('"', "'"):
                            value = value[1:-1]
                        pairs.setdefault(name.lower(), unescape(value) if "&" in value else value)
                self.start(tag, [*pairs.items()], html[at - 2] == "/")
                if tag in RAW_TEXT and self.open[-1].tag == tag and not (self.drawn and self.foreign()):
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    stop = end.start() if end else size
                    if stop > at:
                        self.open[-1].take(Node(TEXT, text=html[at:stop]))
                    at = stop
            elif kind == "comment":
                self.open[-1].take(Node(COMMENT, text=COMMENT_END.sub("", found["comment"])))
            elif kind == "doctype":
                self.open[-1].take(Node(DOCTYPE, text=found["doctype"]))
            elif found["bogus"] != "/":
                self.open[-1].take(Node(COMMENT, text=found["bogus"].lstrip("!/")))

    def write(self, out: Tokens) -> int:
        """Adds every token in document order; returns how many. The tree is used up by it."""
        kinds, elements, parents, tags, attrs, names, values, texts, depths, ends = out.lists
        base, number, depth = len(kinds), 0, 0
        path: list[tuple[Iterator[Node], int | None, int]] = []
        parent, kids = None, iter(self.root.kids)
        while True:
            for kid in kids:
                at = len(kinds)
                kid.parent = None  # so that the tree goes at once, without the collector of cycles
                kinds.append(kid.kind)
                parents.append(parent)
                texts.append(kid.text)
                depths.append(depth)
                ends.append(at - base)
                if kid.kind != START:
                    elements.append(None)
                    tags.append(None)
                    attrs.append(None)
                    continue
                elements.append(number)
                tags.append(kid.tag)
                attrs.append(len(names))
                for name, value in kid.attrs:
                    names.append(name)
                    values.append(value)
                number += 1
                if kid.tag not in VOID:
                    path.append((kids, parent, at))
                    parent, kids = number - 1, iter(kid.kids)
                    depth += 1
                    break
            else:
                if not path:
                    return len(kinds) - base
                element = parent
                kids, parent, at = path.pop()
                depth -= 1
                ends[at] = len(kinds) - base
                kinds.append(END)
                elements.append(element)
                parents.append(parent)
                tags.append(tags[at])
                attrs.append(None)
                texts.append(None)
                depths.append(depth)
                ends.append(ends[at])


class Tokens:
    """Columns of tokens: kind, element, parent, tag, where its attributes begin (null: none may follow), their names and values, text, depth, end."""

    def __init__(self) -> None:
        self.lists: tuple[list, ...] = tuple([] for _ in range(10))

    def __len__(self) -> int:
        return len(self.lists[0])

    def add(self, html: str) -> int:
        """The tokens of one more page; returns how many."""
        builder = Builder()
        builder.feed(html)
        return builder.write(self)


def tokens_of(html: str) -> list[list]:
    """seq, kind, elem_id, parent_id, tag, attrs, text, depth, end_seq of every token in document order."""
    tokens = Tokens()
    tokens.add(html)
    kinds, elements, parents, tags, attrs, names, values, texts, depths, ends = tokens.lists
    begins = [a for a in attrs if a is not None] + [len(names)]
    spans = zip(begins, begins[1:])
    pairs = [None if a is None else [*zip(names[slice(*(span := next(spans)))], values[slice(*span)])] for a in attrs]
    return [list(row) for row in zip(range(len(kinds)), kinds, elements, parents, tags, pairs, texts, depths, ends)]
