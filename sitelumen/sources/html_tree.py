"""A small HTML tree: implied html, head, body and table parts, implied end tags, raw text, and what the HTML standard makes
of misnesting: formatting elements that go on after a block ends (its adoption agency) and content of a table that belongs
before it (its foster parents). Work grows with the length of the text, however deep it nests."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Raw text whose character references are decoded.
DECODED = frozenset(("textarea", "title"))
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li "
    "main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption template applet marquee object body".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements that formatting elements do not reach across.
SPECIAL = CLOSES_P | HEADINGS | SCOPE | frozenset(
    "area base basefont bgsound body br button caption col colgroup dd details dt embed frame frameset head html iframe img input keygen link listing marquee meta noembed noframes "
    "noscript object param plaintext script search select source style tbody td template textarea tfoot th thead title tr track wbr xmp".split()
)
#: Elements that hold table parts only, and the table parts that each may hold.
TABLE_CONTEXT = frozenset("table tbody tfoot thead tr".split())
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th".split())
#: What may stand in a table besides its parts.
IN_TABLE = TABLE_PARTS | frozenset("script style template form input table".split())
#: Cells and the like, across which formatting does not go on, and what ends the search for an open table part.
CELLS, TABLE_SCOPE = frozenset("td th caption".split()), frozenset("table template html".split())
#: Rounds of the adoption agency, and formatting elements that one round clones.
ROUNDS, CLONES = 8, 3
TAG = re.compile(r"<(?:(!--)|(!|\?)|(/?)([a-zA-Z][^\s/>]*))")
COMMENT_END = re.compile(r"-->|--!>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")


#: Formatting elements with the same attributes, and formatting elements in all, that go on after an implied end tag.
EQUAL_FORMATTING, MOST_FORMATTING = 3, 64


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "is_open")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.is_open = False

    def walk(self):
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if not isinstance(c, str)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]

    def text(self, without: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in without:
                stack += reversed(x.children)
        return "".join(out)

    def closest(self, *tags: str) -> Node | None:
        node: Node | None = self
        while node is not None and node.tag not in tags:
            node = node.parent
        return node

    def within(self, tag: str) -> bool:
        return self.parent is not None and self.parent.closest(tag) is not None


class Builder:
    def __init__(self) -> None:
        self.root = Node("#document", {}, None)
        self.html = self._append(self.root, "html", {})
        self.head = self._append(self.html, "head", {})
        self.body: Node | None = None
        self.open: list[Node] = []
        self.counts: dict[str, int] = {}
        self.formatting: list[Node | None] = []  # None where a cell began: what is before it is out of reach
        self._push(self.html)
        self._push(self.head)

    # The stack of open elements, with the number of open ones by name: most questions about it need no walk.

    def _push(self, node: Node, at: int | None = None) -> None:
        self.open.insert(len(self.open) if at is None else at, node)
        node.is_open = True
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1
        if node.tag in CELLS and at is None:
            self.formatting.append(None)

    def _reachable(self) -> int:
        """Where the formatting elements begin that are not out of reach."""
        return next((i + 1 for i in range(len(self.formatting) - 1, -1, -1) if self.formatting[i] is None), 0)

    def _remove(self, node: Node) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] is node:
                del self.open[i]
                break
        node.is_open = False
        self.counts[node.tag] -= 1

    def _close(self, at: int) -> None:
        """Close the open elements from a place on."""
        while len(self.open) > at:
            node = self.open.pop()
            node.is_open = False
            self.counts[node.tag] -= 1
            if node.tag in CELLS and None in self.formatting:
                del self.formatting[self._reachable() - 1 :]

    @staticmethod
    def _append(parent: Node, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, parent)
        parent.children.append(node)
        return node

    def _place(self, target: Node) -> tuple[Node, int | None]:
        """Where content of ``target`` goes: into it, or before its table if it holds table parts only."""
        if target.tag in TABLE_CONTEXT:
            for i in range(len(self.open) - 1, 0, -1):
                table = self.open[i]
                if table.tag == "template":
                    return table, None
                if table.tag == "table":
                    if table.parent is None:
                        return self.open[i - 1], None
                    siblings = table.parent.children
                    at = next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is table)
                    return table.parent, at
        return target, None

    def _insert(self, tag: str, attrs: dict[str, str], foster: bool) -> Node:
        parent, at = self.open[-1], None
        if foster and parent.tag in TABLE_CONTEXT:
            parent, at = self._place(parent)
        if at is None:
            return self._append(parent, tag, attrs)
        node = Node(tag, attrs, parent)
        parent.children.insert(at, node)
        return node

    @staticmethod
    def _move(node: Node, parent: Node, at: int | None = None) -> None:
        if node.parent is not None:
            own = node.parent.children
            del own[next(k for k in range(len(own) - 1, -1, -1) if own[k] is node)]
        node.parent = parent
        parent.children.insert(len(parent.children) if at is None else at, node)

    def _body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            self.body = self._append(self.html, "body", attrs or {})
            self._close(1)
            self._push(self.body)
        elif attrs:
            self.body.attrs = attrs | self.body.attrs

    def _in_scope(self, tags: set[str] | frozenset[str], stop: frozenset[str] | set[str] = SCOPE) -> int | None:
        counts = self.counts
        for t in tags:
            if counts.get(t):
                break
        else:
            return None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in stop:
                return None
        return None

    def _reopen(self) -> None:
        """Formatting elements that an implied end tag has closed go on in the new place."""
        if not self.formatting:
            return
        for k in range(self._reachable(), len(self.formatting)):
            node = self.formatting[k]
            if not node.is_open:
                new = self._insert(node.tag, dict(node.attrs), True)
                self._push(new)
                self.formatting[k] = new

    def text(self, data: str, raw: bool = False) -> None:
        if not data:
            return
        if self.body is None and self.open[-1] in (self.html, self.head):
            if not data.strip(" \t\n\r\f"):
                return
            self._body()
        if raw or self.body is None:
            self._write(self.open[-1].children, len(self.open[-1].children), data)
            return
        if self.open[-1].tag in TABLE_CONTEXT and not data.strip(" \t\n\r\f"):
            self._write(self.open[-1].children, len(self.open[-1].children), data)
            return
        self._reopen()
        parent, at = self.open[-1], None
        if parent.tag in TABLE_CONTEXT:
            parent, at = self._place(parent)
        self._write(parent.children, len(parent.children) if at is None else at, data)

    @staticmethod
    def _write(into: list[Node | str], at: int, data: str) -> None:
        if at and isinstance(into[at - 1], str):
            into[at - 1] += data
        else:
            into.insert(at, data)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if tag == "html":
            self.html.attrs = attrs | self.html.attrs
            return None
        if tag == "head":
            return None
        if tag == "body":
            self._body(attrs)
            return None
        if self.body is None and tag in IN_HEAD:
            while len(self.open) > 2 and self.open[-1].tag not in ("noscript", "template"):
                self._close(len(self.open) - 1)
            if len(self.open) < 2:
                self._push(self.head)
        elif self.body is None and not self.counts.get("template"):
            self._body()
        if tag in CLOSES_P and (i := self._in_scope({"p"}, SCOPE | {"button"})):
            self._close(i)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._close(len(self.open) - 1)
        if tag in SIBLINGS:
            same, stop = SIBLINGS[tag]
            found = None
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in same:
                    found = i
                elif self.open[i].tag in stop or self.open[i].tag in SCOPE - {"td", "th"}:
                    break
            if found:
                self._close(found)
        if tag in TABLE_PARTS:
            if not self.counts.get("table") and not self.counts.get("template"):
                return None  # a table part without a table is ignored
            self._table_context(tag)
        if tag == "a" and self.formatting and any(n.tag == "a" for n in self.formatting[self._reachable() :]):
            last = next(n for n in reversed(self.formatting) if n.tag == "a")
            self._adopt("a")
            if last in self.formatting:
                self.formatting.remove(last)
            if last.is_open:
                self._remove(last)
        if self.body is not None and tag not in CLOSES_P and tag not in TABLE_PARTS and tag not in ("script", "style", "template", "meta", "link", "base", "title"):
            self._reopen()
        node = self._insert(tag, attrs, tag not in IN_TABLE or (tag == "input" and attrs.get("type", "").lower() != "hidden"))
        foreign = closed and (self.counts.get("svg") or self.counts.get("math") or tag in ("svg", "math"))
        if tag not in VOID and not foreign:
            self._push(node)
            if tag in FORMATTING:
                alike = [n for n in self.formatting[self._reachable() :] if n.tag == tag and n.attrs == attrs]
                if len(alike) >= EQUAL_FORMATTING:
                    self.formatting.remove(alike[0])
                self.formatting.append(node)
                first = self._reachable()
                del self.formatting[first : max(first, len(self.formatting) - MOST_FORMATTING)]
        return node

    def _table_context(self, tag: str) -> None:
        """Close what a table part cannot stand in, and open the parts that it needs around it."""
        if not self.counts.get("table"):
            return
        if cell := self._in_scope(CELLS, TABLE_SCOPE):
            self._close(cell)
        i = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag in SCOPE or self.open[i].tag in TABLE_CONTEXT)
        if self.open[i].tag not in TABLE_CONTEXT:
            return
        self._close(i + 1)
        if tag in ("caption", "colgroup", "col", "tbody", "tfoot", "thead") and self.open[-1].tag != "table" and (i := self._in_scope({"table"})):
            self._close(i + 1)
        if tag == "tr" and self.open[-1].tag == "tr":
            self._close(len(self.open) - 1)
        needed = {"tr": ("tbody",), "td": ("tbody", "tr"), "th": ("tbody", "tr"), "col": ("colgroup",)}.get(tag, ())
        if self.open[-1].tag != "table":
            needed = needed[1:] if self.open[-1].tag in ("tbody", "tfoot", "thead") else ()
        for part in needed:
            self._push(self._append(self.open[-1], part, {}))

    def _adopt(self, tag: str) -> bool:
        """The end of a formatting element (the standard's adoption agency): blocks that it began before go on without it, their content within a copy. Whether there was one."""
        for round_ in range(ROUNDS):
            own = next((n for n in reversed(self.formatting[self._reachable() :]) if n.tag == tag), None)
            if own is None:
                return round_ > 0
            if not own.is_open:
                self.formatting.remove(own)
                return True
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i] is own)
            if any(n.tag in SCOPE for n in self.open[at + 1 :]):
                return True  # out of scope
            below = next((i for i in range(at + 1, len(self.open)) if self.open[i].tag in SPECIAL), None)
            if below is None:
                self._close(at)
                self.formatting.remove(own)
                return True
            block, ancestor, mark = self.open[below], self.open[at - 1], self.formatting.index(own)
            last, clones = block, 0
            for i in range(below - 1, at, -1):
                node = self.open[i]
                clones += 1
                if clones > CLONES and node in self.formatting:
                    mark -= self.formatting.index(node) < mark
                    self.formatting.remove(node)
                if node not in self.formatting:
                    self._remove(node)
                    continue
                copy = Node(node.tag, dict(node.attrs), ancestor)
                k = self.formatting.index(node)
                self.formatting[k] = self.open[i] = copy
                node.is_open, copy.is_open = False, True
                if last is block:
                    mark = k + 1
                self._move(last, copy)
                copy.parent = None
                last = copy
            self._move(last, *self._place(ancestor))
            copy = Node(own.tag, dict(own.attrs), block)
            copy.children, block.children = block.children, [copy]
            for child in copy.children:
                if isinstance(child, Node):
                    child.parent = copy
            k = self.formatting.index(own)
            self.formatting.insert(mark, copy)
            del self.formatting[k if k < mark else k + 1]
            self._remove(own)
            self._push(copy, next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i] is block) + 1)
        return True

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            if self.body is None:
                self._body()
            return
        if tag == "head":
            if self.body is None:
                self._close(1)
                self._push(self.head)
            return
        if tag == "br":
            self.start("br", {}, False)
            return
        if tag == "p" and self._in_scope({"p"}, SCOPE | {"button"}) is None:
            if self.body is not None:
                self._insert("p", {}, True)
            return
        if tag in FORMATTING and self._adopt(tag):
            return
        names = HEADINGS if tag in HEADINGS else {tag}
        i = self._in_scope(names, TABLE_SCOPE - {tag} if tag in TABLE_PARTS or tag == "table" else SCOPE - {tag})
        if i and self.open[i] not in (self.html, self.head, self.body):
            self._close(i)


def tree(html: str) -> Node:
    """The document of any text; malformed input gives some tree and never an error."""
    builder, at, n = Builder(), 0, len(html)
    while at < n:
        found = TAG.search(html, at)
        if not found:
            builder.text(unescape(html[at:]))
            break
        builder.text(unescape(html[at : found.start()]))
        if found[1]:
            end = COMMENT_END.search(html, found.end()) if not html.startswith((">", "->"), found.end()) else None
            at = end.end() if end else html.find(">", found.end()) + 1 if html.startswith((">", "->"), found.end()) else n
            continue
        if found[2]:
            end = html.find(">", found.end())
            at = end + 1 if end >= 0 else n
            continue
        at, attrs = found.end(), {}
        while True:
            while at < n and html[at] in " \t\n\r\f/":
                at += 1
            if at >= n or html[at] == ">":
                break
            m = ATTRIBUTE.match(html, at)
            if not m or m.end() == at:
                at += 1
                continue
            value = next((v for v in m.groups()[1:] if v is not None), "")
            attrs.setdefault(m[1].lower(), unescape(value))
            at = m.end()
        if at >= n:
            break  # an unfinished tag is dropped
        closed = html[at - 1] == "/"
        at += 1
        tag = found[4].lower()
        if found[3]:
            builder.end(tag)
            continue
        node = builder.start(tag, attrs, closed)
        if tag in RAW and node is not None and builder.open[-1] is node:
            end = RAW_END[tag].search(html, at)
            data = html[at : end.start() if end else n]
            builder.text(unescape(data) if tag in DECODED else data, raw=True)
            builder.open.pop()
            close = html.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
    builder._body()
    return builder.root
