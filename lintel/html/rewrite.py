"""Rewrites of the tree before it is rendered, and of HTML text as text."""

from __future__ import annotations

import re

from lintel.functions.urls import resolved
from lintel.html.tree import Node, VOID, element, parse, select, serialize

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
INLINE = frozenset("span a strong b em i u s del ins sub sup mark small q cite code abbr time kbd samp var font".split())
#: Which attributes of which tags hold URLs.
URL_ATTRIBUTES = [("a", "href"), ("img", "src"), ("script", "src"), ("link", "href"), ("form", "action"), ("video", "src"), ("audio", "src"), ("source", "src"), ("track", "src"), ("embed", "src"), ("object", "data"), ("iframe", "src")]


def absolutise(html: str, base: str | None) -> str:
    """URLs in attributes and in ``url(...)`` made absolute, on the text: what is commented out is rewritten too."""
    if not base or not re.match(r"(?i)https?://[^/]", base):
        return html
    low = html.lower()
    for tag, attr in URL_ATTRIBUTES:
        if f"<{tag}" not in low:
            continue
        pattern = re.compile(rf"""(<{tag}\b[^>]*?\s{attr}\s*=\s*)(["'])(.*?)\2""", re.I | re.S)
        html = pattern.sub(lambda m: f"{m[1]}{m[2]}{resolved(m[3], base)}{m[2]}", html)
    return re.sub(r"""url\(\s*["']?([^"')]*)["']?\s*\)""", lambda m: f'url("{resolved(m[1].strip(), base)}")', html)


def pretty(html: str) -> str:
    """One tag or text a line, two spaces a level; void and closed tags don't indent, and the level never goes below 0."""
    out, level = [], 0
    for token in re.split(r"(<[^>]+>)", html):
        token = token.strip()
        if not token:
            continue
        if token.startswith("</"):
            level = max(0, level - 1)
        out.append("  " * level + token)
        opened = re.match(r"<([a-zA-Z][\w-]*)", token)
        if opened and not token.endswith("/>") and opened[1].lower() not in VOID:
            level += 1
    return "\n".join(out)


def scoped(root: Node, content: str | None, body: str | None) -> Node:
    """The part that a selector names (the body's wins), with the page's first h1 before it if it has none."""
    found = next((got[0] for s in (body, content) if s and (got := select(root, s))), None)
    if found is None:
        return root
    title = root.first("h1")
    found.remove()
    out = element("div")
    if title is not None and found.first("h1") is None:
        title.remove()
        out.append(title)
    out.append(found)
    return out


def reorder_landmarks(root: Node) -> None:
    header, main, footer = root.first("header"), root.first("main"), root.first("footer")
    place = lambda n: next(i for i, c in enumerate(n.parent.kids()) if c is n)
    if header and main and header.parent and place(header) > place(main):
        main.put_beside(header, after=False)
    if footer and main and footer.parent and place(footer) < place(main):
        main.put_beside(footer, after=True)


def strip_active(root: Node) -> None:
    for n in list(root.elements()):
        if n.tag in ("style", "script", "noscript"):
            n.remove()
            continue
        if n.tag == "a" and n.attrs.get("href", "").startswith("javascript:"):
            n.remove()
            continue
        n.attrs = {k: v for k, v in n.attrs.items() if not k.lower().startswith("on") and k != "style"}


def drop_empty_headings(root: Node) -> None:
    for n in root.find_all(*HEADINGS):
        if not n.content().strip() and n.first("img") is None:
            n.remove()


def drop_empty_links(root: Node) -> None:
    for n in root.find_all("a"):
        if not n.content().strip() and n.first("img") is None:
            n.remove()


def number_lists(root: Node) -> None:
    """One pass in document order. An ordered list whose one item is only a numbered heading takes that number; a heading
    numbered in two or more parts is a bold paragraph; an outermost ordered list without a start counts on from the last."""
    following, inside = 1, set()
    for n in root.elements():
        if n.parent is not None and (id(n.parent) in inside or n.parent.tag in ("li", "ol", "ul")):
            inside.add(id(n))  # below a list
        if n.tag == "ol":
            if (number := _heading_number(n)) is not None:
                n.attrs.setdefault("start", number)
            if id(n) not in inside:
                if re.fullmatch(r"-?\d+", n.attrs.get("start", "")):
                    following = int(n.attrs["start"])
                elif following > 1:
                    n.attrs["start"] = str(following)
                following += len(n.kids("li"))
        elif n.tag in HEADINGS and re.match(r"\s*\d+\.\d+", n.content()):
            bold = n.kids()[:1] and n.kids()[0].tag == "strong"
            made, holder = Node("p"), Node("strong")
            for c in list(n.children):
                (made if bold else holder).append(c)
            if not bold:
                made.append(holder)
            n.replace_with(made)


def _heading_number(ol: Node) -> str | None:
    """The number that a list's only heading begins with; it leaves the heading."""
    items = ol.kids("li")
    inner = items[0].kids() if len(items) == 1 else []
    found = re.match(r"\s*(\d+)\.\s+", inner[0].content()) if len(inner) == 1 and inner[0].tag in HEADINGS else None
    if found is None:
        return None
    spare = found.end()
    for piece in inner[0].walk():
        if piece.tag is None and spare:
            piece.text, spare = piece.text[spare:], max(0, spare - len(piece.text))
    return found[1]


def semantic_tables(root: Node) -> None:
    """Tables made of ARIA roles become tables; the first row group is the head if it has header cells."""
    for t in [n for n in root.elements() if n.attrs.get("role") == "table"]:
        out = Node("table")
        label = t.attrs.get("aria-label")
        described = next((n for n in root.elements() if t.attrs.get("aria-describedby") and n.attrs.get("id") == t.attrs["aria-describedby"]), None)
        if label or described is not None:
            out.append(element("caption", label or described.content()))
        head, body = Node("thead"), Node("tbody")
        role = lambda n, r: [c for c in n.kids() if c.attrs.get("role") == r]
        for i, group in enumerate(role(t, "rowgroup")):
            for row in role(group, "row"):
                cells = [*(element("th", c.content()) for c in role(row, "columnheader")), *(element("td", c.content()) for c in role(row, "cell"))]
                (head if i == 0 and role(row, "columnheader") else body).append(element("tr", *cells))
        for part in (head, body):
            if part.children:
                out.append(part)
        t.replace_with(out)


def lift_breaks(root: Node) -> None:
    """Line breaks at the edge of inline elements move out of them, as often as needed."""
    moved = True
    while moved:
        moved = False
        for br in root.find_all("br"):
            up = br.parent
            if up is None or up.tag not in INLINE or up.parent is None:
                continue
            if up.children[-1] is br or up.children[0] is br:
                up.put_beside(br, after=up.children[-1] is br)
                moved = True


def formula_of(n: Node) -> str | None:
    """LaTeX that an element shows: images of formulas, annotations, data attributes."""
    cls = n.attrs.get("class", "").split()
    if n.tag == "img" and "formula" in cls:
        return (n.attrs.get("source") or n.attrs.get("alt") or "").strip() or None
    if {"katex", "katex-display"} & set(cls) or n.tag in ("math", "mjx-container"):
        for a in n.find_all("annotation"):
            if a.attrs.get("encoding", "application/x-tex") == "application/x-tex":
                return a.content().strip() or None
    for key in ("data-tex", "data-latex"):
        if n.attrs.get(key):
            return n.attrs[key].strip()
    if n.tag == "mjx-container" and n.attrs.get("aria-label"):
        return n.attrs["aria-label"].strip()
    return None


def replace_formulas(root: Node) -> None:
    for n in list(root.elements()):
        if n.parent is not None and (tex := formula_of(n)):
            n.replace_with(Node(None, text=f"${tex}$"))


def correct_code_language(root: Node) -> None:
    """Code marked as matlab that has the keywords of a proof assistant is coq."""
    signs = re.compile(r"\b(?:Require Import|Theorem|Lemma|Proof|Qed|Inductive|Fixpoint|Definition)\b")
    for code in root.find_all("code"):
        cls = code.attrs.get("class", "").split()
        if any(c in ("matlab", "language-matlab") for c in cls) and signs.search(code.content()):
            code.attrs["class"] = " ".join(c.replace("matlab", "coq") for c in cls)


def unix_line_ends(root: Node) -> None:
    for n in root.find_all("pre", "code"):
        for t in n.walk():
            if t.tag is None:
                t.text = t.text.replace("\r\n", "\n")


def absolutise_tree(root: Node, base: str | None) -> None:
    """URLs in attributes made absolute."""
    if not base or not re.match(r"(?i)https?://[^/]", base):
        return
    held: dict[str, list[str]] = {}
    for tag, attr in URL_ATTRIBUTES:
        held.setdefault(tag, []).append(attr)
    for n in root.elements():
        for attr in held.get(n.tag, ()):
            if attr in n.attrs:
                n.attrs[attr] = resolved(n.attrs[attr], base)


def rewritten(root: Node, html: str, base: str | None = None, content: str | None = None, body: str | None = None, enhanced: bool = False) -> Node:
    """A parsed page with all rewrites done, in place. ``html`` is its text, which tells what there is to rewrite."""
    if base:
        absolutise_tree(root, base)
    if content or body:
        root = scoped(root, content, body)
    # a step that has nothing to work on needs no walk
    tags = {n.tag for n in root.elements()}
    if "main" in tags:
        reorder_landmarks(root)
    strip_active(root)
    headed = not tags.isdisjoint(HEADINGS)
    steps = [(drop_empty_headings, headed), (number_lists, "ol" in tags or headed), (drop_empty_links, "a" in tags), (semantic_tables, "table" in html)]
    if enhanced:
        shown = any(x in html for x in ("formula", "katex", "data-tex", "data-latex", "<math", "mjx-"))
        steps += [(replace_formulas, shown), (correct_code_language, "matlab" in html), (unix_line_ends, "\r" in html)]
    for step, needed in [*steps, (lift_breaks, "br" in tags)]:
        if needed:
            step(root)
    return root


def prepared(html: str, base: str | None = None, content: str | None = None, body: str | None = None, enhanced: bool = False) -> Node:
    return rewritten(parse(html), html, base, content, body, enhanced)


#: Elements that are removed, and what the class of an element fixed over a page says.
OVERLAYS, OVERLAY_CLASS = (".fc-consent-root", ".fc-dialog-overlay"), re.compile(r"popup|modal|overlay|banner|cookie|notification|consent|fc-", re.I)


def without_overlays(html: str) -> str:
    """The page without known overlays, and without elements that its own style fixes over the page and whose class says so."""
    root = parse(html)
    for selector in OVERLAYS:
        for n in select(root, selector):
            n.remove()
    for n in root.elements():
        if re.search(r"position\s*:\s*fixed", n.attrs.get("style", ""), re.I) and OVERLAY_CLASS.search(n.attrs.get("class", "")):
            n.remove()
    return serialize(root)


__all__ = ["absolutise", "formula_of", "prepared", "pretty", "rewritten", "scoped", "serialize", "without_overlays"]
