"""The HTML tree on misnested markup, as the HTML standard has it, and on deep nesting."""

from __future__ import annotations

import random
import time

import pytest

from sitelumen.sources.html_tree import Node, tree


def shown(node: Node) -> str:
    return "".join(x if isinstance(x, str) else f"<{x.tag}{''.join(f' {k}={v}' for k, v in x.attrs.items())}>{shown(x)}</{x.tag}>" for x in node.children)


def body_of(html: str) -> str:
    return shown(next(n for n in tree(html).walk() if n.tag == "body"))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<a>1<div>2<a>3", "<a>1</a><div><a>2</a><a>3</a></div>"),
        ("<a href=x>1<p>2</a>3</p>", "<a href=x>1</a><p><a href=x>2</a>3</p>"),
        ("<b><i><p>x</b>y</i>z", "<b><i></i></b><i></i><p><i><b>x</b>y</i>z</p>"),
        ("<div><b><p>x</div>y", "<div><b><p>x</p></b></div><b>y</b>"),
        ("<b><em><div>x</b>y", "<b><em></em></b><em><div><b>x</b>y</div></em>"),
        ("<p><b>1</p>2</b>3", "<p><b>1</b></p><b>2</b>3"),
        ("</b>x</i><b></b>", "x<b></b>"),
        ("<a><table><td><a><table></table><a></tr><a></table><b>X</b>C<a>Y", "<a><a></a><table><tbody><tr><td><a><table></table></a><a></a></td></tr></tbody></table></a><a><b>X</b>C</a><a>Y</a>"),
        ("<table>text<tr><td>x</table>y", "text<table><tbody><tr><td>x</td></tr></tbody></table>y"),
        ("<table><tr><div>d</div><td>x</table>", "<div>d</div><table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>"),
        ("<table> <tr> <th>a<td>b<tr><td>c</table>", "<table> <tbody><tr> <th>a</th><td>b</td></tr><tr><td>c</td></tr></tbody></table>"),
        ("<table><td>a<tfoot><tr><td>b<caption>c", "<table><tbody><tr><td>a</td></tr></tbody><tfoot><tr><td>b</td></tr></tfoot><caption>c</caption></table>"),
        ("<table><col><tr><td><p>a<table><tr><td>b</table>c</table>d", "<table><colgroup><col></col></colgroup><tbody><tr><td><p>a</p><table><tbody><tr><td>b</td></tr></tbody></table>c</td></tr></tbody></table>d"),
        ("<div><table>x</table></div>", "<div>x<table></table></div>"),
        ("<td>a<tr>b</td>", "ab"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
    ],
)
def test_misnesting(html, want):
    assert body_of(html) == want


def test_every_element_has_one_place_and_every_text_stays():
    rng = random.Random(2)
    tags = "a b i em p div table tr td th tbody li ul span h1 h2 form button select option font nobr".split()
    for _ in range(400):
        parts, n = [], 0
        for _ in range(rng.randint(1, 40)):
            kind = rng.randrange(3)
            n += kind == 2
            parts.append((f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f"t{n};")[kind])
        root = tree("".join(parts))
        nodes = list(root.walk())
        assert len({id(x) for x in nodes}) == len(nodes)
        assert all(any(c is x for c in x.parent.children) for x in nodes)
        text = root.text()
        assert sorted(text.split(";")) == sorted([*(f"t{i}" for i in range(1, n + 1)), ""])


@pytest.mark.parametrize("markup", ["<div>", "<span><b>", "<p><font size=1>", "<ul><li>", "<table><tr><td>", "<a><div>", "<div><svg/>", "<i>x<p>"])
def test_deep_nesting_costs_in_proportion(markup):
    def seconds(n):
        html, best = markup * n, 9.0
        for _ in range(3):
            began = time.perf_counter()
            tree(html)
            best = min(best, time.perf_counter() - began)
        return best

    small, large = seconds(1500), seconds(6000)
    assert large < 9 * small + 0.02, (small, large)


def test_references_cut_before_their_semicolon():
    """``&amp`` without a semicolon is ``&`` in texts, as the HTML standard has it; what is no such name stays."""
    from sitelumen.sources.html_extract import extract

    cut, whole = (extract("https://a.test/", f"<title>x &&amp{end}</title><h1>y &amp{end}</h1><p>&am &ampz</p>") for end in ("", ";"))
    assert cut["title"] == whole["title"] == "x &&" and cut["headings"] == whole["headings"] and cut["text"] == whole["text"]
    assert cut["text"] == "x &&y &&am &z"
