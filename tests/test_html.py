"""Tree, rewrites and Markdown on hand-written pages."""

import random
import re

import pytest

from lintel.html.markdown import plain_tables, to_markdown
from lintel.html.rewrite import absolutise, pretty
from lintel.html.tree import parse, select, serialize
from lintel.operators import pages, richdoc


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h1>A</h1><p>b <b>c</b> <i>d</i></p>", "# A\n\nb **c** *d*"),
        ("<a href='/x'> </a><h2> </h2><h3>kept</h3>", "### kept"),
        ("<ul><li>a<li>b</ul>", "-   a\n-   b"),
        ("<ol><li>x<li>y</ol><p>t</p><ol><li>z</ol><ol start=40><li>q</ol>", "1.  x\n2.  y\n\nt\n\n3.  z\n\n40.  q"),
        ("<table><tr><th>A<th>B<tr><td>1<td>2</table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
        ("<table><tr><td></td><td></td></tr><tr><td></td><td></td></tr></table>", "|  |  |\n| --- | --- |\n|  |  |\n|  |  |"),
        ("<div role=table><div role=rowgroup><div role=row><span role=columnheader>H</span></div></div><div role=rowgroup><div role=row><span role=cell>c</span></div></div></div>", "| H |\n| --- |\n| c |"),
        ("<ol><li><h2> 7.  Methods <i>x</i></h2></li></ol><ol><li>next", "7.  ## Methods *x*\n    \n\n8.  next"),
        ("<h3>2.10 On <code>y</code></h3><p>z", "**2.10 On `y`**\n\nz"),
        ("<ul><li><ol><li>a</ol></ul><ol><li>b</ol>", "-   1.  a\n\n1.  b"),
        ("<p>a<br><br>b</p>", "a\n\nb"),
        ("<p><span>a <b>b<br></b></span>c</p>", "a **b**  \nc"),
        ("<pre><code class='language-py'>x\n y</code></pre>", "```py\nx\n y\n```"),
        ("<p>1*2_3 [x]</p>", "1\\*2\\_3 \\[x\\]"),
        ("<blockquote><p>q</p></blockquote><hr>", "> q\n\n---"),
        ("<p>a b</p><script>var t='</p>x';</script>", "a&nbsp;b"),
        ("<footer>f</footer><main>m</main><header>h</header>", "h\n\nm\n\nf"),
        (None, ""),
        ("", ""),
    ],
)
def test_markdown(html, want):
    assert to_markdown(html) == want


def test_tag_soup_reopens_formatting():
    root = parse("<p><b>one<p>two</b> three")
    assert serialize(select(root, "body")[0]) == "<body><p><b>one</b></p><p><b>two</b> three</p></body>"


def test_absolute_urls():
    got = absolutise('<a href="/é x">a</a><img src=\'b.png\'><a href="data:x"></a><i style="background:url(c.png)">', "http://H.com/d/e")
    assert got == '<a href="http://h.com/%C3%A9%20x">a</a><img src=\'http://h.com/d/b.png\'><a href="data:x"></a><i style="background:url("http://h.com/d/c.png")">'
    assert absolutise('<a href="/x">', "no base") == '<a href="/x">'


def test_pretty():
    assert pretty("<ul><li>a<br></li></ul></b>") == "<ul>\n  <li>\n    a\n    <br>\n  </li>\n</ul>\n</b>"


def test_selectors():
    root = parse("<div class='a b' id=x><p data-k=v><span>1</span><span>2</span></p></div><p>3</p>")
    texts = lambda s: [n.content() for n in select(root, s)]
    assert texts("div.a > p") == ["12"] and texts("#x span:first-child") == ["1"] and texts("[data-k=v] span, body > p") == ["1", "2", "3"]
    assert texts("p[data-k^=v]") == ["12"] and texts(".c") == []


def test_metadata():
    html = """<a class=tm-user-info__username href=/u>Ann</a><time datetime=2024-01-15T10:00:00Z>Jan</time><meta name=keywords content="a, b,">
    <script type="application/ld+json">{"dateModified":"2024-02-01","author":{"name":"Ann Bee"}}</script><a class=tm-publication-hub__link href=/h><span>Hub</span> *</a>"""
    m = pages.metadata_of(parse(html))
    assert (m["author"], m["author_url"], m["publish_date"], m["tags"], m["author_full_name"], m["hubs"]) == ("Ann", "/u", "2024-01-15T10:00:00Z", ["a", "b"], "Ann Bee", ["Hub"])
    assert all(v is None for v in pages.metadata_of(parse("<p>x</p>")).values())


def test_figures():
    html = "<figure><img src=a.png alt=x><figcaption>Рис. 7 t</figcaption></figure><figure><img src=b.svg></figure><figure><img src=c.png></figure>"
    assert [(f["figure_num"], f["src"], f["sequential_index"]) for f in pages.figures_of(parse(html), "http://e.com/")] == [(7, "http://e.com/a.png", 1), (2, "http://e.com/c.png", 2)]


def test_model_tables_and_marks():
    text = "\x10\x12\x1cA\n\x1cB\n\x12\x1cC\n\x1cD\n\x11bold\n"
    items = [{"ty": "is", "s": text}, {"ty": "as", "st": "text", "si": text.index("bold") + 1, "ei": text.index("bold") + 4, "sm": {"ts_bd": True}}]
    blocks = richdoc.model_blocks([{"chunk": items}])
    assert richdoc.blocks_markdown(blocks) == "| A | B |\n| --- | --- |\n| C | D |\n\n**bold**\n"
    assert "<strong>bold</strong>" in richdoc.blocks_html(blocks) and richdoc.blocks_text(blocks) == "A\tB\nC\tD\nbold"


def test_marks_never_cross_line_ends():
    runs = [richdoc.run_of("a\x0bb".replace("\x0b", "\n"), {"bold": True}), richdoc.run_of("c")]
    assert richdoc.content_markdown(runs) == "**a**\n**b**c"


def test_list_counts_restart():
    item = lambda text, level: {"type": "paragraph", "content": [richdoc.run_of(text)], "list": {"id": "l", "level": level, "ordered": True}, "style": None, "quote": False}
    got = richdoc.blocks_markdown([item("a", 0), item("b", 1), item("c", 0), item("d", 1)])
    assert got == "1. a\n    1. b\n2. c\n    1. d\n"


def test_export_preprocessing():
    html = "<style>.c1{font-weight:700}.c2{margin-left:36pt}.c3{margin-left:72pt}</style><p><span class=c1>x</span><span class=c1>y</span></p><ul><li class=c2>a</li></ul><ul><li class=c3>b</li></ul><a href='https://www.google.com/url?q=https://e.com/&sa=D'>l</a>"
    out = richdoc.preprocessed(html)
    assert out["unwrapped_links"] == 1 and 'href="https://e.com/"' in out["html"] and out["hoisted"] == 2
    assert re.search(r"<ul><li class=\"c2\">a<ul><li class=\"c3\">b</li></ul></li></ul>", out["html"])


def test_plain_tables_need_no_tree(monkeypatch):
    """Pages of plain tables, long ones too, give what their trees give, without a tree."""
    rng = random.Random(1)
    texts = ["", " ", "1", "12. x", "- y", "# h", "a|b", "  x  y ", "\n", "\u00a0z\u00a0", "*s*", "a_b", "> q", "+ p", "~~~", "`c`", "[l]", "\\", "=", "x>y", "\x0bk", "\u00e9"]
    made = ["before <table><tr><th>n<th>word" + "".join(f"<tr><td>{k}<td>w{k}" for k in range(20_000)) + "</table>"]
    for _ in range(400):
        html = ""
        for _ in range(rng.randint(1, 2)):
            rows = ["<tr>" + "".join(f"<t{k}>{rng.choice(texts)}{rng.choice(['', f'</t{k}>'])}" for k in rng.choices("dh", k=rng.randint(1, 3))) + rng.choice(["", "</tr>\n"]) for _ in range(rng.randint(1, 3))]
            html += rng.choice(["", "text "]) + "<table>" + "".join(rows) + "</table>"
        made.append(html)
    want = [[pages.table_of(n) for n in parse(h).find_all("table")] for h in made]
    for odd in ("", "text", "<table></table>", "<table><tr></table>", "<table><tr><td>a&amp;b</table>", "<table><tr><td align=left>a</table>", "<table><tr><td><b>x</b></table>", "<table><tr><td>a"):
        assert plain_tables(odd) is None
    monkeypatch.setattr(pages, "parse", None)
    assert [pages.parsed_page(h, None, frozenset({"tables"}))["tables"] for h in made] == want
