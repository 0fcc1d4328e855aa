"""Rich documents: model events or API documents to blocks, and blocks to Markdown, HTML and text.

A block is ``{type, style, list, quote, horizontal_rule, content}`` or ``{type: table, rows}``;
content is a list of text runs and images.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from html import escape
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import urls as U
from lintel.functions.text import decode_entities
from lintel.html.tree import Node, parse, serialize

STYLES = ("bold", "italic", "strike")
MARKS = {"bold": "**", "italic": "*", "strike": "~~"}


# ---- content ----------------------------------------------------------------------------


def run_of(text: str, style: dict | None = None) -> dict:
    style = style or {}
    return {"type": "text", "text": text, "link": style.get("link"), **{s: bool(style.get(s)) for s in STYLES}}


def _look(node: dict) -> tuple:
    return (node.get("link"), *(bool(node.get(s)) for s in STYLES))


def merged(content: list[dict]) -> list[dict]:
    """Neighbouring runs of one look are one run."""
    out: list[dict] = []
    for node in content:
        if node["type"] == "text" and out and out[-1]["type"] == "text" and _look(out[-1]) == _look(node):
            out[-1] = {**out[-1], "text": out[-1]["text"] + node["text"]}
        elif node["type"] == "image" or node["text"]:
            out.append(node)
    return out


def plain(content: list[dict]) -> str:
    return "".join((f"[{n.get('alt') or 'image'}]" if n.get("url") else "") if n["type"] == "image" else n["text"] for n in content)


def is_blank(content: list[dict]) -> bool:
    return all(n["type"] == "text" and not n["text"].strip() for n in content)


# ---- the editor's model -------------------------------------------------------------------

BREAK, TABLE, END, ROW, CELL, SOFT = "\n", "\x10", "\x11", "\x12", "\x1c", "\x0b"


def model_items(chunks: list) -> list[dict]:
    """Events of all three accepted shapes: lists, ``{chunk: [...]}`` and single events."""
    out: list[dict] = []
    for c in chunks or []:
        out += c if isinstance(c, list) else c["chunk"] if isinstance(c, dict) and isinstance(c.get("chunk"), list) else [c] if isinstance(c, dict) and c.get("ty") else []
    return [x for x in out if isinstance(x, dict)]


def _units(text: str) -> list[str]:
    """UTF-16 units, as the model counts; a pair of surrogates is its character and an empty unit."""
    out: list[str] = []
    for ch in text:
        out += [ch, ""] if ord(ch) > 0xFFFF else [ch]
    return out


class _Model:
    """What the events say about places in the text."""

    def __init__(self, items: list[dict], cids: dict[str, str]):
        self.units = _units("".join(x.get("s") or "" for x in items if x.get("ty") in ("is", "iss")))
        self.look: list[dict] = [{} for _ in self.units]
        self.paragraph: dict[int, dict] = {}
        self.list: dict[int, dict] = {}
        self.rules: set[int] = set()
        self.images: dict[int, dict] = {}
        for x in items:
            if x.get("ty") == "as":
                self._style(x)
        places = {x["id"]: max(0, int(x.get("spi") or 0) - 1) for x in items if x.get("ty") in ("te", "ste") and x.get("id")}
        for x in items:
            if x.get("ty") in ("ae", "ase") and x.get("id") in places:
                o = (x.get("epm") or {}).get("ee_eo") or {}
                suggested = x["ty"] == "ase"
                self.images[places[x["id"]]] = {
                    "type": "image", "cid": o.get("i_cid"), "url": cids.get(o.get("i_cid")), "width": o.get("i_wth"), "height": o.get("i_ht"),
                    "is_suggestion": suggested, "alt": o.get("eo_ad") or ("suggested image" if suggested else "image"),
                }

    def _style(self, x: dict) -> None:
        m, kind = x.get("sm") or {}, x.get("st")
        try:
            start, end = int(x["si"]), int(x["ei"])
        except (KeyError, TypeError, ValueError):
            return
        if kind in ("text", "link"):
            patch = {"link": (m.get("lnks_link") or {}).get("ulnk_url")} if kind == "link" else {s: True for s, key in zip(STYLES, ("ts_bd", "ts_it", "ts_st"), strict=True) if m.get(key) and m.get(f"{key}_i") is not True}
            for k in range(max(0, start - 1), min(len(self.look), end)):
                self.look[k] = {**self.look[k], **patch}
        elif kind == "paragraph":
            self.paragraph[end] = m
        elif kind == "list":
            self.list[end] = {"id": m.get("ls_id") or "", "level": int(m.get("ls_nest") or 0), "ordered": False}
        elif kind == "horizontal_rule":
            self.rules.add(end)

    def block(self, content: list[dict], end: int) -> dict:
        m = self.paragraph.get(end, {})
        heading, indent = int(m.get("ps_hd") or 0), float(m.get("ps_il") or 0)
        own = self.list.get(end)
        dashes = re.fullmatch("-+", plain(content).strip()) is not None
        return {
            "type": "paragraph", "content": content, "style": f"HEADING_{heading}" if heading > 0 else None, "list": dict(own) if own else None,
            "quote": own is None and indent > 0 and indent == float(m.get("ps_ifl") or 0), "horizontal_rule": dashes and bool({end, end - 1} & self.rules),
        }


#: What ends a cell, as letters for CELL and BREAK: after a cell with something in it a CELL takes the line end that follows
#: with it; a line end takes the CELL that follows.
_ENDS = {True: re.compile("CBC?|BC?|C"), False: re.compile("BC?|C")}


def table_of(tokens: list[dict | str]) -> dict:
    """A table from its nodes and control codes. ROW ends a row, with a last cell only if something is in it; a cell's end
    begins the next cell; blank rows at the end go."""
    letters = {ROW: "R", CELL: "C", BREAK: "B"}
    shape = "".join("x" if isinstance(t, dict) else letters[t] for t in tokens) + "R"
    rows: list[list[list[dict]]] = []
    row: list[list[dict]] | None = None
    cell: list[dict] | None = None
    at = 0
    while at < len(shape):
        filled = cell is not None and not is_blank(cell)
        if shape[at] == "R":
            if row is not None:
                rows.append([*row, merged(cell)] if filled else row)
            row, cell, step = [], None, 1
        elif shape[at] == "x":
            row, cell, step = row or [], [*(cell or []), tokens[at]], 1
        else:
            row = [*(row or []), *([merged(cell)] if cell is not None else [])]
            cell, step = [], _ENDS[filled].match(shape, at).end() - at
        at += step
    while len(rows) > 1 and all(map(is_blank, rows[-1])):
        rows.pop()
    return {"type": "table", "rows": [{"cells": [{"content": c} for c in r]} for r in rows]}


def model_blocks(chunks: list, cids: dict[str, str] | None = None, hints: list[dict] | None = None) -> list[dict]:
    """Blocks of a document's model events; ``hints`` (from its HTML export) settle ordered lists and quotes."""
    m = _Model(model_items(chunks), cids or {})
    blocks: list[dict] = []
    open_: list[dict] = []
    table: list[dict | str] | None = None

    def settle(end: int) -> None:
        content = merged(open_)
        if not is_blank(content):
            blocks.append(m.block(content, end))
        open_.clear()

    for k, unit in enumerate(m.units):
        if unit == TABLE:
            settle(k + 1)
            table = []
        elif unit == END:
            if table is not None:
                blocks.append(table_of(table))
            table = None
        elif unit in (ROW, CELL, BREAK) and table is not None:
            table.append(unit)
        elif unit == BREAK:
            settle(k + 1)
        elif unit not in (ROW, CELL):
            put: Callable[[dict], None] = table.append if table is not None else open_.append
            if k in m.images:
                put(m.images[k])
                if unit == "*":
                    continue
            if unit:
                put(run_of("\n") if unit == SOFT else run_of(unit, m.look[k]))
    if table is not None:
        blocks.append(table_of(table))
    settle(len(m.units))
    return hinted(blocks, hints) if hints else blocks


def export_hints(html: str) -> list[dict]:
    """(text, ordered, quote) of headings, paragraphs and list items of an export, in order."""
    out = []
    root = parse(preprocessed(html)["html"])
    for n in root.find_all("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"):
        above = []
        up = n.parent
        while up is not None:
            above.append(up.tag)
            up = up.parent
        nested = {id(x) for sub in n.find_all("ol", "ul") for x in sub.walk()} if n.tag == "li" else set()
        text = " ".join("".join(x.text for x in n.walk() if x.tag is None and id(x) not in nested).replace("\u00a0", " ").split())
        if text:
            lists = [t for t in above if t in ("ol", "ul")]
            out.append({"text": text, "ordered": lists[0] == "ol" if n.tag == "li" and lists else None, "quote": n.tag != "li" and "blockquote" in above})
    return out


def hinted(blocks: list[dict], hints: list[dict]) -> list[dict]:
    """Each paragraph takes the next hint of equal text and kind; the place among the hints only moves forward."""
    at = 0
    for b in blocks:
        if b["type"] != "paragraph":
            continue
        text = " ".join(plain(b["content"]).replace("\u00a0", " ").split())
        k = next((k for k in range(at, len(hints)) if hints[k]["text"] == text and (hints[k]["ordered"] is not None) == bool(b["list"])), None) if text else None
        if k is None:
            continue
        at = k + 1
        if b["list"]:
            b["list"]["ordered"] = hints[k]["ordered"]
        else:
            b["quote"] = hints[k]["quote"]
    return blocks


# ---- the API's document ---------------------------------------------------------------------


def api_blocks(document: dict) -> list[dict]:
    objects = document.get("inlineObjects") or {}

    def inline(p: dict) -> list[dict]:
        out = []
        for e in p.get("elements") or []:
            if "textRun" in e:
                out.append(run_of(re.sub(r"\n$", "", e["textRun"].get("content") or "")))
            elif "inlineObjectElement" in e:
                o = ((objects.get(e["inlineObjectElement"].get("inlineObjectId")) or {}).get("inlineObjectProperties") or {}).get("embeddedObject") or {}
                urls = o.get("imageProperties") or {}
                if url := urls.get("contentUri") or urls.get("sourceUri"):
                    out.append({"type": "image", "url": url, "alt": o.get("title") or o.get("description") or "image"})
        return merged(out)

    def cell(elements: list[dict]) -> list[dict]:
        out: list[dict] = []
        for e in elements or []:
            own = inline(e["paragraph"]) if "paragraph" in e else [run_of(blocks_markdown([table(e["table"])]))] if "table" in e else []
            out += ([run_of("\n")] if out and own and "paragraph" in e else []) + own
        return merged(out)

    def table(t: dict) -> dict:
        return {"type": "table", "rows": [{"cells": [{"content": cell(c.get("content"))} for c in r.get("tableCells") or []]} for r in t.get("tableRows") or []]}

    out = []
    for e in (document.get("body") or {}).get("content") or []:
        if "table" in e:
            out.append(table(e["table"]))
        elif "paragraph" in e and not is_blank(content := inline(e["paragraph"])):
            style = (e["paragraph"].get("paragraphStyle") or {}).get("namedStyleType")
            out.append({"type": "paragraph", "style": style, "content": content, "list": None, "quote": False, "horizontal_rule": False})
    return out


# ---- renderings ---------------------------------------------------------------------------


def _level(style: str | None) -> int:
    m = re.fullmatch(r"HEADING_(\d)", style or "")
    return int(m[1]) if m else {"TITLE": 1, "SUBTITLE": 2}.get(style or "", 0)


def _switch(on: list[str], wanted: list[str]) -> str:
    closed = "".join(MARKS[s] for s in reversed(STYLES) if s in on and s not in wanted)
    return closed + "".join(MARKS[s] for s in STYLES if s in wanted and s not in on)


def _styled(runs: list[dict]) -> str:
    """Marks open and close where the look changes, and never stand across a line end."""
    out, on = "", []
    for r in runs:
        wanted = [s for s in STYLES if r.get(s)]
        for piece in re.findall(r"\n|[^\n]+", r["text"]):
            now = [] if piece == "\n" else wanted
            out += _switch(on, now) + piece
            on = now
    return out + _switch(on, [])


def content_markdown(content: list[dict]) -> str:
    out = ""
    for (kind, link), nodes in groupby(content, key=lambda n: (n["type"], n.get("link") if n["type"] == "text" else id(n))):
        own = list(nodes)
        if kind == "image":
            out += f"![{own[0].get('alt') or 'image'}]({own[0]['url']})" if own[0].get("url") else ""
        else:
            out += f"[{_styled(own)}]({link})" if link else _styled(own)
    return out


def _table_markdown(b: dict) -> str:
    rows = [[content_markdown(c["content"]).replace("|", "\\|").replace("\n", "<br>") for c in r["cells"]] for r in b["rows"]]
    if not rows:
        return ""
    width = max(1, *map(len, rows))
    full = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join(f"| {' | '.join(r)} |" for r in [full[0], ["---"] * width, *full[1:]])


def _paragraph_markdown(b: dict, number: int) -> str:
    text = content_markdown(b["content"]).strip()
    if b.get("horizontal_rule"):
        return "---"
    if level := _level(b.get("style")):
        return f"{'#' * level} {text}"
    if b.get("list"):
        return "    " * b["list"]["level"] + (f"{number}. " if b["list"].get("ordered") else "- ") + text
    return re.sub(r"(?m)^(?=.)", "> ", text).replace("\n\n", "\n>\n") if b.get("quote") else text


def item_numbers(blocks: list[dict]) -> list[int | None]:
    """The number of each list item: how many of its list and level came since something else, or a shallower item, stood between."""
    out: list[int | None] = []
    seen: list[tuple[int, str]] = []  # level and list of the items that still count
    for b in blocks:
        own = b.get("list") if b["type"] == "paragraph" else None
        if own is None:
            seen = []
            out.append(None)
        else:
            here = (own["level"], own.get("id") or "")
            seen = [x for x in seen if x[0] <= here[0]] + [here]
            out.append(seen.count(here))
    return out


def blocks_markdown(blocks: list[dict]) -> str:
    """Blocks a blank line apart; items of lists follow each other, and so do quotes, by an empty quoted line."""
    shown = []
    for b, number in zip(blocks, item_numbers(blocks), strict=True):
        text = _table_markdown(b) if b["type"] == "table" else _paragraph_markdown(b, number or 1)
        if text:
            shown.append(("item" if number else "quote" if b.get("quote") else "", text))
    apart = {("item", "item"): "\n", ("quote", "quote"): "\n>\n"}
    pieces = [text if not k else apart.get((shown[k - 1][0], kind), "\n\n") + text for k, (kind, text) in enumerate(shown)]
    out = "".join(pieces).rstrip()
    return out + "\n" if out else ""


def content_html(content: list[dict]) -> str:
    out = ""
    for n in content:
        if n["type"] == "image":
            size = "".join(f' {k}="{escape(str(n[k]))}"' for k in ("width", "height") if n.get(k))
            out += f'<img src="{escape(n["url"])}" alt="{escape(n.get("alt") or "image")}"{size}>' if n.get("url") else ""
            continue
        parts = []
        for text in n["text"].split("\n"):
            made = escape(text).replace("&#x27;", "&#39;")
            for style, tag in (("bold", "strong"), ("italic", "em"), ("strike", "s")):
                made = f"<{tag}>{made}</{tag}>" if text and n.get(style) else made
            parts.append(f'<a href="{escape(n["link"])}">{made}</a>' if text and n.get("link") else made)
        out += "<br>".join(parts)
    return out


def blocks_html(blocks: list[dict]) -> str:
    out = ""
    for b in blocks:
        if b["type"] == "table":
            out += "<table>" + "".join("<tr>" + "".join(f"<td>{content_html(c['content'])}</td>" for c in r["cells"]) + "</tr>" for r in b["rows"]) + "</table>"
            continue
        inner, level = content_html(b["content"]), _level(b.get("style"))
        if b.get("horizontal_rule"):
            out += "<hr>"
        elif b.get("list"):
            tag = "ol" if b["list"].get("ordered") else "ul"
            out += f"<{tag}><li>{inner}</li></{tag}>"
        else:
            tag = "blockquote" if b.get("quote") else f"h{level}" if 1 <= level <= 6 else "p"
            out += f"<{tag}>{inner}</{tag}>"
    return f"<!doctype html><html><body>{out}</body></html>"


def blocks_text(blocks: list[dict]) -> str:
    parts = ["\n".join("\t".join(plain(c["content"]) for c in r["cells"]) for r in b["rows"]) if b["type"] == "table" else plain(b["content"]) for b in blocks]
    return "\n".join(p for p in parts if p).rstrip()


# ---- the HTML export ------------------------------------------------------------------------


def class_styles(html: str) -> dict[str, str]:
    """Declarations of each class in style sheets; later ones follow earlier ones."""
    out: dict[str, str] = {}
    for sheet in re.findall(r"(?is)<style[^>]*>(.*?)</style>", html):
        for name, rules in re.findall(r"\.([\w-]+)\s*\{([^}]*)\}", sheet):
            out[name] = f"{out[name]};{rules}" if name in out else rules
    return out


def declared(style: str, name: str) -> list[str]:
    """The values that a style declares for a property, or for those that begin with it and a hyphen, in order."""
    pairs = [x.partition(":") for x in style.split(";")]
    return [v.strip() for k, _, v in pairs if k.strip() == name or k.strip().startswith(name + "-")]


def points(style: str, name: str) -> float:
    found = [m[1] for v in declared(style, name) if (m := re.match(r"(-?[\d.]+)pt", v))]
    return float(found[-1]) if found else 0.0


def is_bold(style: str) -> bool:
    return any(v.startswith("bold") or v[:1] in "6789" and v[:3].isdigit() and len(v) >= 3 for v in declared(style, "font-weight"))


def is_italic(style: str) -> bool:
    return any(v.startswith("italic") for v in declared(style, "font-style"))


def is_struck(style: str) -> bool:
    return any("line-through" in v for v in declared(style, "text-decoration"))


def list_level(margin: float) -> int:
    return max(0, math.floor((margin - 36) / 36 + 0.5))


def _wrapped(n: Node, tag: str) -> None:
    inner = Node(tag)
    for c in list(n.children):
        inner.append(c)
    n.children = []
    n.append(inner)


def preprocessed(html: str) -> dict:
    """An export's HTML with looks as tags: ``{html, hoisted, unwrapped_links}``.

    Styles from classes become strong, em and del; indented paragraphs become quotes; flat
    lists nest by margin; first table rows become heads; redirects and no-break spaces go.
    """
    styles, root = class_styles(html), parse(html)
    look = lambda n: ";".join([*(styles[c] for c in n.attrs.get("class", "").split() if c in styles), n.attrs.get("style", "")])
    hoisted = unwrapped = 0
    for n in root.find_all("span"):
        for test, tag in ((is_struck, "del"), (is_italic, "em"), (is_bold, "strong")):
            if n.content().strip() and test(look(n)):
                _wrapped(n, tag)
                hoisted += 1
    for n in root.find_all("a"):
        href = n.attrs.get("href", "")
        m = re.match(r"https?://www\.google\.com/url\?(?:.*&)?q=([^&]+)", href)
        if m:
            from urllib.parse import unquote

            n.attrs["href"], unwrapped = unquote(m[1]), unwrapped + 1
    for p in root.find_all("p"):
        style = look(p)
        left = points(style, "margin-left")
        if left > 0 and left == points(style, "margin-right") and p.parent.tag not in ("li", "blockquote"):
            quote = Node("blockquote")
            p.replace_with(quote)
            quote.append(p)
    _join_neighbours(root, "blockquote")
    _nest_lists(root, look)
    for t in root.find_all("table"):
        rows = t.find_all("tr")
        if rows and not t.find_all("thead") and not t.find_all("th"):
            for c in rows[0].kids("td"):
                c.tag = "th"
        for c in t.find_all("td", "th"):
            paragraphs = c.kids("p")
            for k, p in enumerate(paragraphs):
                inner = list(p.children)
                p.replace_with(*([Node("br"), Node("br")] if k else []), *inner)
    for n in root.elements():
        if n.tag == "a" and n.attrs.get("name") and not n.attrs.get("href") and not n.content().strip():
            n.remove()
    for _ in range(8):
        if not _join_neighbours(root, "strong"):
            break
    for n in root.find_all("strong"):
        if not n.content().strip() and n.first("img") is None:
            n.replace_with(*n.children)
    for t in root.walk():
        if t.tag is None:
            t.text = t.text.replace("\u00a0", " ")
    return {"html": serialize(root), "hoisted": hoisted, "unwrapped_links": unwrapped}


def _join_neighbours(root: Node, tag: str) -> int:
    done = 0
    for n in root.find_all(tag):
        if n.parent is None:
            continue
        kids = n.parent.children
        at = next(i for i, c in enumerate(kids) if c is n)
        nxt = kids[at + 1] if at + 1 < len(kids) else None
        while nxt is not None and nxt.tag == tag:
            for c in list(nxt.children):
                n.append(c)
            nxt.remove()
            done += 1
            kids = n.parent.children
            nxt = kids[at + 1] if at + 1 < len(kids) else None
    return done


def _nest_lists(root: Node, look: Callable[[Node], str]) -> None:
    """Neighbouring flat lists become one list, nested by their items' margins."""
    for lead in root.find_all("ul", "ol"):
        if lead.parent is None or lead.parent.tag == "li":
            continue
        kids = lead.parent.children
        at = next(i for i, c in enumerate(kids) if c is lead)
        group = [lead]
        for c in kids[at + 1 :]:
            if c.tag in ("ul", "ol"):
                group.append(c)
            elif c.tag is not None or c.text.strip():
                break
        items = [(list_level(points(look(li), "margin-left")), g.tag, li) for g in group for li in g.kids("li")]
        if len(group) < 2 and not any(k for k, _, _ in items):
            continue
        top = Node(items[0][1] if items else lead.tag, dict(lead.attrs))
        stack: list[tuple[int, Node]] = [(items[0][0] if items else 0, top)]
        for level, tag, li in items:
            while len(stack) > 1 and level < stack[-1][0]:
                stack.pop()
            if level > stack[-1][0] and stack[-1][1].kids("li"):
                stack.append((level, stack[-1][1].kids("li")[-1].append(Node(tag))))
            li.remove()
            stack[-1][1].append(li)
        for g in group[1:]:
            g.remove()
        lead.replace_with(top)


# ---- columns ------------------------------------------------------------------------------

RENDERED = "markdown string, html string, text string, n_blocks int, n_tables int, n_images int"


def _rendered(blocks: list[dict]) -> dict:
    nodes = [n for b in blocks for n in (b["content"] if b["type"] == "paragraph" else [x for r in b["rows"] for c in r["cells"] for x in c["content"]])]
    return {"markdown": blocks_markdown(blocks), "html": blocks_html(blocks), "text": blocks_text(blocks), "n_blocks": len(blocks), "n_tables": sum(b["type"] == "table" for b in blocks), "n_images": sum(n["type"] == "image" for n in nodes)}


def _from_json(make: Callable[..., list[dict]]):
    @F.pandas_udf(RENDERED)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out = []
            for values in zip(*((columns,) if isinstance(columns, pd.Series) else columns), strict=True):
                try:
                    out.append(_rendered(make(*values)))
                except (ValueError, TypeError, KeyError, AttributeError):
                    out.append(dict.fromkeys(x.split()[0] for x in RENDERED.split(", ")))
            yield pd.DataFrame(out)

    return run


def render_model(chunks_json: Column, cids_json: Column, export_html: Column) -> Column:
    """Renderings of model chunks (JSON), with image addresses (JSON map) and the export's hints; null for what can't be read."""
    return _from_json(lambda c, m, x: model_blocks(json.loads(c), json.loads(m) if m else {}, export_hints(x) if x else None))(chunks_json, cids_json, export_html)


def render_api_document(document_json: Column) -> Column:
    return _from_json(lambda d: api_blocks(json.loads(d)))(document_json)


def preprocess_export(html: Column) -> Column:
    @F.pandas_udf("html string, hoisted int, unwrapped_links int")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([preprocessed(x or "") for x in s], columns=["html", "hoisted", "unwrapped_links"])

    return run(html)


def cid_urls(html: Column) -> Column:
    """Image ids and addresses in an editor page, as a map; the last address of an id wins."""
    pair = r'"(s-[A-Za-z0-9_-]+|[A-Za-z0-9_-]{20,})"\s*:\s*"(https:(?:\\?/){2}[^"]*googleusercontent[^"]*)"'
    urls = F.transform(F.regexp_extract_all(html, F.lit(pair), F.lit(2)), lambda u: F.replace(F.replace(F.replace(u, F.lit("\\/"), F.lit("/")), F.lit("\\u003d"), F.lit("=")), F.lit("\\u0026"), F.lit("&")))
    return F.map_from_arrays(F.regexp_extract_all(html, F.lit(pair), F.lit(1)), urls)


__all__ = ["api_blocks", "blocks_html", "blocks_markdown", "blocks_text", "model_blocks", "preprocessed"]


# ---- documents from receipts -------------------------------------------------------------------

#: Formats that an export has.
FORMATS = ("html", "txt", "md", "pdf", "docx", "epub", "zip")


def exports(documents: DataFrame, receipts: DataFrame, fmt: str = "html", url_col: str = "url") -> DataFrame:
    """``documents`` with document_id, export_url, format, content (text formats; entities decoded in txt and md), body and
    error, from receipts of the export's address. What is no document's address has an error, not a failed job."""
    kind = fmt if fmt in FORMATS else "html"
    asked = documents.withColumn("document_id", U.document_id(F.col(url_col)))
    asked = asked.withColumns({"export_url": U.document_export_url(F.col("document_id"), kind), "format": F.lit(kind)})
    return _received(asked, receipts, url_col, "export", decode=kind in ("txt", "md"), text=kind in ("html", "txt", "md"))


def api_documents(documents: DataFrame, receipts: DataFrame, url_col: str = "url") -> DataFrame:
    """``documents`` with the document API's JSON as content, from receipts of its address."""
    asked = documents.withColumn("document_id", U.document_id(F.col(url_col)))
    asked = asked.withColumn("export_url", U.document_api_url(F.col("document_id")))
    return _received(asked, receipts, url_col, "document API", decode=False, text=True)


def _received(asked: DataFrame, receipts: DataFrame, url_col: str, what: str, decode: bool, text: bool) -> DataFrame:
    got = receipts.select(F.col("url").alias("export_url"), F.col("status").alias("_status"), F.col("body").alias("_body"))
    ok = F.col("_body").isNotNull() & (F.coalesce("_status", F.lit(200)) < 400)
    raw = F.make_valid_utf8(F.col("_body").cast("string"))
    error = (
        F.when(F.col("document_id").isNull(), F.concat(F.lit("not a document's address: "), F.coalesce(url_col, F.lit(""))))
        .when(F.col("_status") >= 400, F.concat(F.lit(f"{what} failed ("), F.col("_status").cast("string"), F.lit("): "), "export_url"))
        .when(~ok, F.concat(F.lit("no receipt of "), "export_url"))
    )
    out = asked.join(got, "export_url", "left").withColumns({"content": F.when(ok & F.lit(text), raw), "body": F.when(ok, F.col("_body")), "error": error})
    return (out.withColumn("content", decode_entities(F.col("content"))) if decode else out).drop("_status", "_body")


# ---- samples of a model while it loads --------------------------------------------------------


def model_fingerprint(chunks: Column) -> Column:
    """How many chunks (array of JSON texts) a sample has, and their bytes; an absent sample has none of either."""
    sizes = F.transform(F.coalesce(chunks, F.array().cast("array<string>")), lambda x: F.coalesce(F.octet_length(x), F.lit(0)).cast("long"))
    return F.struct(F.size(sizes).alias("chunks"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("payload_bytes"))


def same_fingerprint(left: Column, right: Column) -> Column:
    """Both there, and equal."""
    return F.coalesce(left == right, F.lit(False))


def observed(blocks: DataFrame, name: str, text: str = "text", kind: str = "kind") -> DataFrame:
    """``blocks`` with counters that Spark reports under ``name`` when the query ends: blocks, tables, images, text bytes."""
    return blocks.observe(
        name,
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(F.col(kind) == "table").alias("tables"),
        F.count_if(F.col(kind) == "image").alias("images"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("text_bytes"),
    )


def with_image_urls(items: DataFrame, addresses: DataFrame, cid: str = "cid") -> DataFrame:
    """Image items with the address of their content id (``addresses(doc_id, cid, url)``), null where there is none."""
    return items.join(addresses.select("doc_id", F.col("cid").alias(cid), "url"), ["doc_id", cid], "left")
