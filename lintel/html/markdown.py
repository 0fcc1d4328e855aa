"""Markdown (with tables) from a prepared tree."""

from __future__ import annotations

import re
from collections.abc import Iterable

from lintel.html.rewrite import prepared
from lintel.html.tree import BLOCK, LEVELS, Node, parse

_ESCAPES = [
    (re.compile(r"\\"), r"\\\\"), (re.compile(r"\*"), r"\\*"), (re.compile(r"^-"), r"\\-"), (re.compile(r"^\+ "), r"\\+ "),
    (re.compile(r"^(=+)"), r"\\\1"), (re.compile(r"^(#{1,6}) "), r"\\\1 "), (re.compile(r"`"), r"\\`"), (re.compile(r"^~~~"), r"\\~~~"),
    (re.compile(r"\["), r"\\["), (re.compile(r"\]"), r"\\]"), (re.compile(r"^>"), r"\\>"), (re.compile(r"_"), r"\\_"), (re.compile(r"^(\d+)\. "), r"\1\\. "),
]
_BLOCKS = BLOCK | {"body", "html", "head", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "section", "#root"}
_SKIPPED = frozenset("head title script style noscript template iframe".split())
_WS = re.compile(r"[ \t\r\n\f]+")


#: Whether any of these patterns is found.
_SPECIAL = re.compile(r"[\\*`\[\]_]|^(?:[-=>]|\+ |#{1,6} |~~~|\d+\. )")


def _escaped(text: str) -> str:
    if not _SPECIAL.search(text):
        return text
    for pattern, to in _ESCAPES:
        text = pattern.sub(to, text)
    return text


def _collapse(root: Node) -> None:
    """White space as it is shown: runs are one space, none at the edges of blocks or after another."""
    last: Node | None = None
    spaced = True

    def visit(n: Node) -> None:
        nonlocal last, spaced
        for c in list(n.children):
            if c.tag is None:
                t = _WS.sub(" ", c.text)
                if spaced and t.startswith(" "):
                    t = t[1:]
                c.text = t
                if t:
                    spaced, last = t.endswith(" "), c
            elif c.tag in ("pre", "code") and c.tag == "pre":
                trim_end()
            elif c.tag in _BLOCKS or c.tag == "br":
                trim_end()
                visit(c)
                trim_end()
            else:
                visit(c)
                if c.tag in ("img", "input"):
                    spaced, last = False, None

    def trim_end() -> None:
        nonlocal last, spaced
        if last is not None and last.text.endswith(" "):
            last.text = last.text[:-1]
        last, spaced = None, True

    visit(root)
    trim_end()


def _joined(pieces: Iterable[str]) -> str:
    """Pieces one after the other, with at most two line ends between them."""
    out, ends = [], 0
    for piece in pieces:
        inner = piece.lstrip("\n")
        before = min(max(ends, len(piece) - len(inner)), 2)
        if inner:
            body = inner.rstrip("\n")
            out += ["\n" * before, body]
            ends = len(inner) - len(body)
        else:
            ends = before
    return "".join(out) + "\n" * ends


def _children(n: Node) -> str:
    return _joined(map(_render, n.children))


def _items(n: Node) -> str:
    """What is in a list, its items numbered by place."""
    items = n.kids("li")
    shown, last, place = n.kids(), len(items) - 1, 0
    ends_with_item = bool(items) and shown[-1] is items[-1]
    pieces = []
    for c in n.children:
        if c.tag == "li":
            pieces.append(_item(c, place, ends_with_item and place == last))
            place += 1
        else:
            pieces.append(_render(c))
    return _joined(pieces)


def _flanked(inner: str, make) -> str:
    """Edge spaces stay outside of a mark."""
    body = inner.strip(" ")
    if not body.strip():
        return inner
    lead, tail = inner[: len(inner) - len(inner.lstrip(" "))], inner[len(inner.rstrip(" ")) :]
    return lead + make(body) + tail


def _fence(code: str) -> str:
    run = max((len(x) for x in re.findall(r"^`{3,}", code, re.M)), default=2)
    return "`" * (run + 1)


def _inline_code(text: str) -> str:
    if not text:
        return ""
    text = re.sub(r"\r?\n|\r", " ", text)
    mark = "`"
    while mark in re.findall(r"`+", text):
        mark += "`"
    pad = " " if re.match(r"`|.*?[^ ].*`$", text) and ("`" in (text[0], text[-1])) else ""
    return mark + pad + text + pad + mark


def _cell(n: Node) -> str:
    for br in n.find_all("br"):
        br.replace_with(Node(None, text="\0"))
    text = _children(n).replace("\0", "<br>").strip()
    return re.sub(r"\s*\n+\s*", " ", text).replace("|", "\\|")


def _grid(cells: list[list[str]], rule: list[str], headed: bool) -> str:
    """A table's lines; without a head the first one is empty."""
    width = len(rule)
    line = lambda xs: "| " + " | ".join([*xs, *[""] * (width - len(xs))]) + " |"
    head = line(cells[0]) if headed else line([""] * width)
    return "\n".join([head, line(rule), *map(line, cells[1:] if headed else cells)])


def _table(n: Node) -> str:
    rows = rows_of(n)
    if not rows:
        return _children(n)
    cells = [[_cell(c) for c in r.kids("td", "th")] for r in rows]
    width = max(map(len, cells))
    headed = rows[0].parent.tag == "thead" or all(c.tag == "th" for c in rows[0].kids("td", "th"))
    align = [c.attrs.get("align", "").lower() for c in rows[0].kids("td", "th")]
    rule = [{"left": ":--", "right": "--:", "center": ":-:"}.get(align[k] if k < len(align) else "", "---") for k in range(width)]
    caption = next((_children(c).strip() for c in n.kids("caption")), "")
    return ("\n\n" + caption if caption else "") + "\n\n" + _grid(cells, rule, headed) + "\n\n"


def _owner(row: Node) -> Node | None:
    up = row.parent
    while up is not None and up.tag != "table":
        up = up.parent
    return up


def _item(n: Node, place: int = 0, last: bool = True) -> str:
    inner = re.sub(r"\n+$", "\n", _children(n).lstrip("\n")).replace("\n", "\n    ")
    up = n.parent
    mark = "-   "
    if up is not None and up.tag == "ol":
        first = int(up.attrs["start"]) if re.fullmatch(r"-?\d+", up.attrs.get("start", "")) else 1
        mark = f"{first + place}.  "
    box = next((c for c in n.kids("input") if c.attrs.get("type") == "checkbox"), None)
    if box is not None:
        inner = ("[x] " if "checked" in box.attrs else "[ ] ") + inner.lstrip()
    return mark + inner + ("" if last or inner.endswith("\n") else "\n")


def _render(n: Node) -> str:
    if n.tag is None:
        return _escaped(n.text)
    t = n.tag
    if t in _SKIPPED:
        return ""
    if t == "br":
        return "  \n"
    if t == "hr":
        return "\n\n---\n\n"
    if t == "img":
        src, alt, title = n.attrs.get("src", ""), re.sub(r"\n+\s*", "\n", n.attrs.get("alt", "")), n.attrs.get("title", "")
        return f'![{alt}]({src}{f" {chr(34)}{title}{chr(34)}" if title else ""})' if src else ""
    if t == "pre":
        code = n.first("code")
        text = (code or n).content()
        name = re.search(r"(?:language|lang)-(\S+)", (code or n).attrs.get("class", "")) or re.search(r"highlight-(?:text|source)-([a-z0-9]+)", n.parent.attrs.get("class", "") if n.parent else "")
        plain = (code.attrs.get("class", "").split()[:1] if code else []) or [""]
        mark = _fence(text)
        return f"\n\n{mark}{name[1] if name else plain[0]}\n{text.removesuffix(chr(10))}\n{mark}\n\n"
    if t in ("code", "kbd", "samp", "tt"):
        return _inline_code(n.content()) if t == "code" else _children(n)
    if t == "table":
        return _table(n)
    inner = _items(n) if t in ("ul", "ol") else _children(n)
    if t in LEVELS:
        body = inner.strip().replace("\n", " ")
        return f"\n\n{'#' * int(t[1])} {body}\n\n" if body else ""
    if t == "blockquote":
        return "\n\n" + re.sub(r"(?m)^", "> ", inner.strip("\n")) + "\n\n"
    if t in ("ul", "ol"):
        nested = n.parent is not None and n.parent.tag == "li" and n.parent.kids()[-1] is n
        return "\n" + inner if nested else "\n\n" + inner + "\n\n"
    if t == "li":  # outside of a list
        return _item(n, 0, n.parent is None or n.parent.kids()[-1] is n)
    if t in ("strong", "b"):
        return _flanked(inner, lambda x: f"**{x}**")
    if t in ("em", "i"):
        return _flanked(inner, lambda x: f"*{x}*")
    if t in ("del", "s", "strike"):
        return _flanked(inner, lambda x: f"~{x}~")
    if t == "a" and n.attrs.get("href"):
        title = n.attrs.get("title", "").replace('"', '\\"')
        href = re.sub(r"([()])", r"\\\1", n.attrs["href"])
        return _flanked(inner, lambda x: f"[{x}]({href}" + (f' "{title}"' if title else "") + ")")
    if t in _BLOCKS:
        return "\n\n" + inner + "\n\n"
    return inner


def render(root: Node) -> str:
    _collapse(root)
    out = _children(root).strip("\n\t\r ")
    return re.sub(r"\n{3,}", "\n\n", out)


def to_markdown(html: str | None, base: str | None = None) -> str:
    """The basic converter."""
    if not html:
        return ""
    out = render(prepared(html, base)).replace(" ", "&nbsp;")
    return re.sub(r"(?: {2,}\n){2,}", "\n\n", out)


def shown_text(root: Node) -> str:
    """The words that a page shows; the tree stays as it is."""
    out, todo = [], root.children[::-1]
    while todo:
        n = todo.pop()
        if n.tag is None:
            out.append(n.text)
        elif n.tag not in _SKIPPED:
            todo += n.children[::-1]
    return " ".join("".join(out).split())


def to_text(html: str | None) -> str:
    return shown_text(parse(html))


def rows_of(table: Node) -> list[Node]:
    return [r for r in table.find_all("tr") if _owner(r) is table]


def table_markdown(table: Node) -> str:
    """A table's Markdown; the tree stays as it is."""
    own = copied(table)
    _collapse(own)
    return _render(own).strip()


_TEXT, _GAP = r"[^<&\0]*+", r"[ \t\r\n\f]*+"
_ROW = rf"<tr>{_GAP}(?:<td>{_TEXT}(?:</td>{_GAP})?+|<th>{_TEXT}(?:</th>{_GAP})?+)++(?:</tr>{_GAP})?+"
_PLAIN_TABLE = rf"<table>{_GAP}(?:{_ROW})++</table>"
#: Pages of nothing but text and plain tables: rows of cells of text, without attributes, references or further elements.
_PLAIN_PAGE = re.compile(rf"(?:{_TEXT}{_PLAIN_TABLE})++{_TEXT}")
_PLAIN_CELL = re.compile(r"<t([dh])>([^<]*)")


def _plain_cell(text: str) -> str:
    if not text.isalnum():
        text = _escaped(_WS.sub(" ", text).removeprefix(" ").removesuffix(" ")).strip().replace("|", "\\|")
    return text


def plain_tables(html: str) -> list[tuple[list[list[str]], str]] | None:
    """(cells, Markdown) of the tables of a page of plain tables, the same as from its tree; None for any other page."""
    if not _PLAIN_PAGE.fullmatch(html):
        return None
    out = []
    for table in html.split("<table>")[1:]:
        rows = [_PLAIN_CELL.findall(r) for r in table[: table.index("</table>")].split("<tr>")[1:]]
        texts = [[t for _, t in r] for r in rows]
        rule = ["---"] * max(map(len, rows))
        headed = all(kind == "h" for kind, _ in rows[0])
        cells = [[t if t.isalnum() else " ".join(t.split()) for t in r] for r in texts]
        out.append((cells, _grid([[_plain_cell(t) for t in r] for r in texts], rule, headed)))
    return out


def copied(n: Node) -> Node:
    out = Node(n.tag, dict(n.attrs), n.text)
    for c in n.children:
        out.append(copied(c))
    return out
