"""A small HTML tree: tokens from the standard library's tokenizer, implied ends and open formatting as browsers treat them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Their start ends an open paragraph.
BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start tag ends these open elements, up to the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
LEVELS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD = frozenset("title meta link base style script noscript template".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace_with(self, *others: Node) -> None:
        up = self.parent
        if up is not None:
            at = next(i for i, c in enumerate(up.children) if c is self)
            up.children[at : at + 1] = others
            self.parent = None
            for o in others:
                o.parent = up

    def put_beside(self, other: Node, after: bool) -> None:
        """Moves ``other`` next to this node."""
        other.remove()
        at = next(i for i, c in enumerate(self.parent.children) if c is self) + after
        self.parent.children.insert(at, other)
        other.parent = self.parent

    def walk(self) -> Iterator[Node]:
        """All nodes below in document order; the tree may change behind the walk."""
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children)

    def elements(self) -> list[Node]:
        """Elements below in document order, as they are now."""
        out, todo = [], self.children[::-1]
        while todo:
            node = todo.pop()
            if node.tag:
                out.append(node)
                if node.children:
                    todo += node.children[::-1]
        return out

    def own_text(self) -> str:
        return "".join(c.text for c in self.children if c.tag is None)

    def content(self) -> str:
        return self.text if self.tag is None else "".join(n.text for n in self.walk() if n.tag is None)

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.elements() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.elements() if n.tag in tags), None)

    def kids(self, *tags: str) -> list[Node]:
        return [c for c in self.children if c.tag and (not tags or c.tag in tags)]


def element(tag: str, *children: Node | str, **attrs: str) -> Node:
    out = Node(tag, attrs)
    for c in children:
        out.append(Node(None, text=c) if isinstance(c, str) else c)
    return out


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.html = self.root.append(Node("html"))
        self.head = self.html.append(Node("head"))
        self.body = self.html.append(Node("body"))
        self.stack = [self.body]
        self.active: list[Node] = []  # formatting elements that are still open for the reader
        self.raw: Node | None = None
        self.in_head = True

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines and columns aren't asked for

    def _close_to(self, node: Node) -> None:
        while self.stack[-1] is not node:
            self.stack.pop()
        self.stack.pop()

    def _close_paragraph(self) -> None:
        for n in reversed(self.stack[1:]):
            if n.tag == "p":
                self._close_to(n)
                return
            if n.tag in ("table", "td", "th", "button"):
                return

    def _reopen(self) -> None:
        """Formatting that a block's end cut short goes on in the next one."""
        if not self.active:
            return
        for i, f in enumerate(self.active):
            if f not in self.stack:
                again = self.stack[-1].append(Node(f.tag, dict(f.attrs)))
                self.stack.append(again)
                self.active[i] = again

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pairs: dict[str, str] = {}
        for k, v in attrs:
            pairs.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            own = {"html": self.html, "head": self.head, "body": self.body}[tag]
            own.attrs = {**pairs, **own.attrs}
            self.in_head = self.in_head and tag != "body"
            return
        if self.in_head and tag in HEAD:
            node = self.head.append(Node(tag, pairs))
            self.raw = node if tag in RAW else None
            return
        self.in_head = False
        if tag in BLOCK:
            self._close_paragraph()
        if tag in ENDS:
            ended, bound = ENDS[tag]
            for n in reversed(self.stack[1:]):
                if n.tag in bound:
                    break
                if n.tag in ended:
                    self._close_to(n)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
        if tag in LEVELS and self.stack[-1].tag in LEVELS:
            self.stack.pop()
        if tag == "a":
            for f in [f for f in self.active if f.tag == "a"]:
                self.handle_endtag("a")
                self.active = [x for x in self.active if x is not f]
        if tag not in BLOCK and tag not in ENDS:
            self._reopen()
        node = self.stack[-1].append(Node(tag, pairs))
        if tag in VOID:
            return
        if tag in RAW:
            self.raw = node
            return
        self.stack.append(node)
        if tag in FORMATTING:
            self.active.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag == "script" and self.raw is not None:
            self.raw = None

    def handle_endtag(self, tag: str) -> None:
        if self.raw is not None:
            if tag == self.raw.tag:
                self.raw = None
            return
        if tag in ("html", "head", "body"):
            self.in_head = self.in_head and tag != "head"
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag == "p" and not any(n.tag == "p" for n in self.stack):
            self.stack[-1].append(Node("p"))
            return
        if tag in FORMATTING:
            self.active = [f for k, f in enumerate(self.active) if not (f.tag == tag and not any(g.tag == tag for g in self.active[k + 1 :]))]
        for n in reversed(self.stack[1:]):
            if n.tag == tag or (tag in LEVELS and n.tag in LEVELS):
                self._close_to(n)
                return
            if tag in FORMATTING and n.tag in ("td", "th", "table"):
                return

    def handle_data(self, data: str) -> None:
        if self.raw is not None:
            self.raw.append(Node(None, text=data))
            return
        if not data.strip() and self.in_head:
            return
        if self.in_head:
            self.in_head = False
        if data.strip():
            self._reopen()
        self.stack[-1].append(Node(None, text=data))


def parse(html: str | None) -> Node:
    """The document's root; never fails."""
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (ValueError, AssertionError):
        pass  # what was read so far stands
    return builder.root


# ---- selectors --------------------------------------------------------------------------

_PART = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[~^$*|]?=)["']?(?P<val>[^"'\]]*)["']?)?\]|:(?P<pseudo>[\w-]+)""")
_TEST = {"=": lambda a, b: a == b, "^=": lambda a, b: a.startswith(b), "$=": lambda a, b: a.endswith(b), "*=": lambda a, b: b in a, "~=": lambda a, b: b in a.split(), "|=": lambda a, b: a == b or a.startswith(b + "-")}


def _compound(text: str) -> Callable[[Node], bool]:
    tests: list[Callable[[Node], bool]] = []
    for m in _PART.finditer(text):
        g = m.groupdict()
        if g["tag"] and g["tag"] != "*":
            tests.append(lambda n, t=g["tag"].lower(): n.tag == t)
        elif g["cls"]:
            tests.append(lambda n, c=g["cls"]: c in n.attrs.get("class", "").split())
        elif g["id"]:
            tests.append(lambda n, i=g["id"]: n.attrs.get("id") == i)
        elif g["attr"]:
            a, op, v = g["attr"].lower(), g["op"], g["val"]
            tests.append((lambda n, a=a: a in n.attrs) if not op else (lambda n, a=a, f=_TEST[op], v=v: a in n.attrs and f(n.attrs[a], v)))
        elif g["pseudo"] == "first-child":
            tests.append(lambda n: n.parent is not None and n.parent.kids()[0] is n)
    return lambda n: all(t(n) for t in tests)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that match: tags, classes, ids, attributes, ``:first-child``, descendants, children, lists."""
    ways = []
    for alternative in selector.split(","):
        steps = re.findall(r"[>]|(?:[^\s>\[\]]|\[[^\]]*\])+", alternative.strip())
        chain: list[tuple[bool, Callable[[Node], bool]]] = []
        direct = False
        for s in steps:
            if s == ">":
                direct = True
            else:
                chain.append((direct, _compound(s)))
                direct = False
        if chain:
            ways.append(chain)

    def fits(n: Node, chain: list, k: int) -> bool:
        direct, test = chain[k]
        if not test(n):
            return False
        if k == 0:
            return not direct or n.parent is root
        up = n.parent
        while up is not None and up is not root.parent:
            if fits(up, chain, k - 1):
                return True
            if direct:
                return False
            up = up.parent
        return False

    return [n for n in root.elements() if any(fits(n, chain, len(chain) - 1) for chain in ways)]


def serialize(node: Node) -> str:
    from html import escape

    if node.tag is None:
        raw = node.parent is not None and node.parent.tag in ("script", "style")
        return node.text if raw else escape(node.text, quote=False)
    inner = "".join(serialize(c) for c in node.children)
    if node.tag == "#root":
        return inner
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" + ("" if node.tag in VOID else f"{inner}</{node.tag}>")
