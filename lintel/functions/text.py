"""String functions as native column expressions; state machines as Arrow functions at the end."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript defines it; Java's ``\s`` has neither the no-break space nor the others.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other."""
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def swap(c: Column, *steps: tuple[str, str]) -> Column:
    """Literal replacements, one after the other."""
    for what, to in steps:
        c = F.replace(c, F.lit(what), F.lit(to))
    return c


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


# The steps of Markdown clean-up, in order; replacements as Java writes them.
UNICODE = [("\u00a0", "&nbsp;"), ("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2014", " \u2014 "), ("\u2013", "-"), ("\u2026", "...")]
PERCENT = [(r"\$(\d+)\\+%\$", r"\$$1\\\\%\$"), (r"\$(\d+)\\text\{%\}\$", r"\$$1\\\\%\$")]
TIDY = [(r"([^\n`]) +(?!\n)", "$1 "), (f"{SPACE}+\u2014{SPACE}+", " \u2014 "), (r"(?m)^\$\s*$", "")]
EMPTY_BOLD = [(r"(\S)\*\*[^\S\n]*\*\*(\S)", "$1 $2"), (r"\*\*[^\S\n]*\*\*", "")]


def normalize_unicode(c: Column) -> Column:
    """No-break space as an entity, straight quotes, spaced em-dash, hyphen for en-dash, three dots."""
    return swap(c, *UNICODE)


def percent_in_formulas(c: Column) -> Column:
    """A percent sign in a formula of one number gets two backslashes."""
    return chain(c, *PERCENT)


def tidy_spaces(c: Column) -> Column:
    """Double spaces except hard breaks, one space around em-dashes, no lone ``$`` lines."""
    return chain(c, *TIDY)


def drop_empty_bold(c: Column) -> Column:
    return chain(c, *EMPTY_BOLD)


def postprocess(c: Column, unicode: bool = True, formulas: bool = True, bold: bool = True, percent: bool = True) -> Column:
    """All Markdown clean-ups in their order; the two line machines run in Arrow functions only if asked for."""
    if unicode:
        c = normalize_unicode(c)
    if formulas:
        c = space_formulas(c)
    if percent:
        c = percent_in_formulas(c)
    if bold:
        c = space_bold(drop_empty_bold(c))
    return tidy_spaces(c)


def _in_python(steps: list[tuple[str, str]]) -> list[tuple[re.Pattern, str]]:
    """Java's steps for ``re``: ASCII classes, its ends of lines, its references."""
    ends = r"\n\r\u0085\u2028\u2029"
    out = []
    for pattern, to in steps:
        if pattern.startswith("(?m)^") and pattern.endswith("$"):
            pattern = rf"(?<![^{ends}]){pattern[5:-1]}(?![^{ends}])"
        to = re.sub(r"\\(.)|\$(\d)", lambda m: rf"\g<{m[2]}>" if m[2] else "\\\\" if m[1] == "\\" else m[1], to)
        out.append((re.compile(pattern, re.ASCII), to))
    return out


_PERCENT, _TIDY, _EMPTY_BOLD = map(_in_python, (PERCENT, TIDY, EMPTY_BOLD))


def postprocessed(text: str) -> str:
    """``postprocess`` of a text that is in Python already."""
    by_line = lambda f, t: "\n".join(map(f, t.split("\n")))
    for what, to in UNICODE:
        text = text.replace(what, to)
    if "$" in text:
        text = by_line(formula_line, text)
        for pattern, to in _PERCENT:
            text = pattern.sub(to, text)
    if "**" in text:
        for pattern, to in _EMPTY_BOLD:
            text = pattern.sub(to, text)
        text = by_line(bold_line, text)
    for pattern, to in _TIDY:
        text = pattern.sub(to, text)
    return text


# What comparison of texts takes as equal, in order.
COMPARE_STEPS = [
    (r"[\u2000-\u200F\u2028-\u202F]", " "), (r"\u00A0", " "), (r"[\u2018\u2019]", "'"), (r"[\u201C\u201D]", '"'),
    (r"\u00D7", "x"), (r"\\times", "x"), (r"[\u2192\u21A6]", "->"), (r"\\to", "->"), (r"\u2212", "-"),
    (r"\$\$", ""), (r"\$", ""), (r"\\displaystyle\s*", ""), (r"\\text\{([^}]*)\}", "$1"), (r"\\\\%", "%"), (r"\\%", "%"),
    (r"\\subseteq", "\u2286"), (r"(?i)\\mathbb\{n\}_0", "\u2115\u2080"), (r"\\in", "\u2208"), (r"\\emptyset", "\u2205"),
    (r"\^2", "\u00b2"), (r"\^n", "\u207f"),
]
CODE_STEPS = [(r"[\u2000-\u200F\u2028-\u202F]", " "), (r"\u00A0", " "), (r"\u00D7", "x"), (r"\\times", "x"), (r"\$\$", ""), (r"\$", "")]


#: A text without any of these is left as it is by the steps on typography, or on markup.
_TYPOGRAPHY, _MARKUP = r"[\u00A0\u00D7\u2000-\u202F\u2192\u21A6\u2212]", r"[\\$^]"


def _given(c: Column, needed: str, steps: list[tuple[str, str]]) -> Column:
    """The steps where the text holds what they look for; the text is bound once, so that it isn't computed again in each branch."""
    return F.get(F.transform(F.array(c), lambda x: F.when(F.regexp_like(x, F.lit(needed)), chain(x, *steps)).otherwise(x)), 0)


def _comparable(c: Column, steps: list[tuple[str, str]]) -> Column:
    """Typography first: what its steps leave is nothing that an earlier step on markup would have looked for."""
    signs = [x for x in steps if x[0].lstrip("[").startswith("\\u")]
    return F.lower(_given(_given(squeeze(c), _TYPOGRAPHY, signs), _MARKUP, [x for x in steps if x not in signs]))


def compare_text(c: Column) -> Column:
    return _comparable(c, COMPARE_STEPS)


def compare_code(c: Column) -> Column:
    return _comparable(c, CODE_STEPS)


def semantic_text(c: Column) -> Column:
    return squeeze(F.replace(c, F.lit("\u00a0"), F.lit(" ")))


def escape_html(c: Column) -> Column:
    return swap(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_links_notation(c: Column) -> Column:
    return swap(c, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escape_table_cell(c: Column) -> Column:
    return swap(c, ("|", "\\|"), ("\n", "<br>"))


def strip_empty_titles(html: Column) -> Column:
    """Empty ``title`` attributes of images go; others stay. One expression: a title that follows within an image's tag."""
    inside = r"(?i)(<img\b[^>]*?)\s+title\s*=\s*(?:\"\"|'')(?=[^>]*>)"
    return chain(html, (inside, "$1"), (inside, "$1"))  # a tag may repeat the attribute


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, in double quotes, single quotes or none; null where it is absent or empty. Entities are
    decoded."""
    quoted = re.escape(name)
    value = F.regexp_extract(tag, rf"""(?is)\b{quoted}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""", 1)
    ways = [value, *[F.regexp_extract(tag, rf"""(?is)\b{quoted}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""", k) for k in (2, 3)]]
    return F.nullif(decode_common(trim(F.concat(*ways))), F.lit(""))


def decode_common(c: Column) -> Column:
    """The entities that attributes need: the five of XML, the no-break space, and numbers."""
    named = swap(c, ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"))
    # numbers: split at them, so that each is decoded in its place
    number = r"&#(x[0-9a-fA-F]{1,6}|[0-9]{1,7});"
    found = F.transform(F.regexp_extract_all(named, F.lit(number), F.lit(1)), lambda x: F.when(F.startswith(F.lower(x), F.lit("x")), F.conv(F.substring(x, 2, 8), 16, 10)).otherwise(x).cast("int"))
    # a code point as UTF-16, one unit or two
    unit = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0"))
    wide = lambda n: F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000) % 1024))
    char = F.transform(found, lambda n: F.decode(F.when(n < 0x10000, unit(n)).otherwise(wide(n)), "UTF-16BE"))
    joined = F.array_join(F.zip_with(F.split(named, number, -1), char, lambda a, x: F.concat(a, F.coalesce(x, F.lit("")))), "")
    return swap(F.when(F.contains(named, F.lit("&#")), joined).otherwise(named), ("&amp;", "&"))


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1024.0 * 1024.0)), F.lit(" MB")))
    )


def trim_blank_lines(c: Column) -> Column:
    """Lines of white space at either end go."""
    return chain(c, (r"\A(?:[^\S\n]*\n)+", ""), (r"(?:\n[^\S\n]*)+\z", ""))


def break_runs(c: Column) -> Column:
    """Two or more hard breaks in a row are a paragraph's end."""
    return F.regexp_replace(c, r"(?: {2,}\n){2,}", "\n\n")


def clean_markdown(c: Column) -> Column:
    """At most one blank line, ends trimmed, one final newline."""
    return F.concat(trim(F.regexp_replace(c, r"\n{3,}", "\n\n")), F.lit("\n"))


def fence(c: Column) -> Column:
    """A code fence longer than any fence in the text, three backticks at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`{3,}"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest + 1, F.lit(3))))


def with_attachment(markdown: Column, name: Column, raw: Column) -> Column:
    """Markdown followed by a raw text as a titled fenced block."""
    body = chain(raw, (r"\r\n?", "\n"))
    ended = F.when(F.endswith(body, F.lit("\n")), body).otherwise(F.concat(body, F.lit("\n")))
    head = F.concat(F.regexp_replace(markdown, f"{SPACE}+$", ""), F.lit("\n\n## "), name, F.lit("\n\n"))
    return F.concat(head, fence(body), F.lit("text\n"), ended, fence(body), F.lit("\n"))


def normalize_export_markdown(c: Column) -> Column:
    """Export Markdown, basic mode: needless escapes, single tildes as strike-through, blank lines."""
    return chain(c, (r"\\([.!()\[\]])", "$1"), (r"(^|[^\w~])~([^~\n]+)~(?=$|[^\w~])", "$1~~$2~~"), (r"\n{3,}", "\n\n"))


# ---- line machines, in Arrow batches -------------------------------------------------

# Letters (Latin and Russian) and signs that a mark is set off from, on its left and on its right; a formula
# (or a pair of dollars, which is none) and a bold run.
LETTERS = "a-zA-Z\u0430-\u044f\u0410-\u042f\u0451\u0401"
FORMULA_LEFT, FORMULA_RIGHT = rf"[{LETTERS},:;\u00bb)\]]", rf"[{LETTERS}]"
BOLD_LEFT, BOLD_RIGHT = rf"[{LETTERS}0-9).]", rf"[{LETTERS}\[(]"
FORMULA = r"\$\$|(?<!\\)\$((?:[^$]|(?<=\\)\$)*)(?<!\\)\$"
BOLD = r"\*\*(.+?)\*\*"


def _set_off(mark: str, frame: str, left: str, right: str):
    """A function of a line: its marks trimmed inside, framed, and with a space to the letters and signs beside them. Empty
    marks go where ``mark`` can't match them as something else."""
    marks, left_sign, right_sign = re.compile(mark), re.compile(left), re.compile(right)

    def pieces(line: str):
        """(text, whether it is a mark's inside) one after the other."""
        at = 0
        for m in marks.finditer(line):
            if m[1] is not None:
                yield line[at : m.start()], False
                yield m[1].strip(), True
                at = m.end()
        yield line[at:], False

    def run(line: str) -> str:
        done, marked = [], False
        for text, inside in pieces(line):
            if inside:
                if text or frame == "$":
                    before = next((x for x in reversed(done) if x), "")
                    done += [" " if before and left_sign.match(before[-1]) else "", frame + text + frame]
                    marked = True
            else:
                done += [" " if marked and text and right_sign.match(text[0]) else "", text]
                marked = False
        return "".join(done)

    return run


_formulas, _bolds = _set_off(FORMULA, "$", FORMULA_LEFT, FORMULA_RIGHT), _set_off(BOLD, "**", BOLD_LEFT, BOLD_RIGHT)


def formula_line(line: str) -> str:
    """Inline formulas set off; lines of a block formula, quoted or not, as they are."""
    bare = line[1:].lstrip() if line.startswith(">") else line
    return line if "$" not in line or (bare.startswith("$$") and bare.endswith("$$")) else _formulas(line)


def bold_line(line: str) -> str:
    return _bolds(line) if "**" in line else line


def _by_line(name: str, f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "\n".join(f(x) for x in t.split("\n")))

    run.__name__ = name
    return F.pandas_udf(run, "string")


def space_formulas(c: Column) -> Column:
    return _by_line("space_formulas", formula_line)(c)


def space_bold(c: Column) -> Column:
    return _by_line("space_bold", bold_line)(c)


def decode_entities(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else html.unescape(t))

    return F.pandas_udf(run, "string")(c)


def clean_search_text(c: Column) -> Column:
    """Tags to spaces, entities decoded, white space squeezed."""
    return squeeze(decode_entities(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>", " ")))


def double_backslashes(c: Column) -> Column:
    """``\\\\`` before a letter inside ``$...$`` is one backslash."""

    def run(s: pd.Series) -> pd.Series:
        fix = lambda m: re.sub(r"\\\\(?=[a-zA-Z])", r"\\", m.group(0))
        return s.map(lambda t: None if t is None else re.sub(r"\$[^$]+\$", fix, t))

    return F.pandas_udf(run, "string")(c)


# ---- export Markdown, full mode: a pipeline of lines --------------------------------------------

# What is an item of a list, a heading, its closing marks, a starred item, a table's rule.
_ITEM, _HEADING, _CLOSING = re.compile(r"\s*(?:[-+*]|\d+\.)\s+"), re.compile(r"(#{1,6})\s+(.+?)\s*$"), re.compile(r"\s+#{1,6}$")
_STARRED, _RULE = re.compile(r"(\s*)\* "), re.compile(r":?-{3,}:?")
UNDERLINES = {"=": "#", "-": "##"}


def _underlined(lines: list[str]) -> Iterator[str]:
    """Lines over five or more equal or minus signs become headings; a line so used is no heading's text."""
    rest = iter([*zip(lines, [*lines[1:], ""], strict=True)])
    for line, below in rest:
        mark = below.strip()
        if len(mark) >= 5 and mark[0] in UNDERLINES and not mark.strip(mark[0]):
            next(rest)
            yield f"{UNDERLINES[mark[0]]} {line.strip()}"
        else:
            yield line


def _heading(line: str) -> str:
    found = _HEADING.match(line)
    if not found:
        return line
    text = _CLOSING.sub("", found[2].strip()).strip()
    stars = next((n for n in (3, 2, 1) if len(text) > 2 * n and text.startswith("*" * n) and text.endswith("*" * n)), 0)
    return f"{found[1]} {text[stars : len(text) - stars].strip()}"


def _close_items(lines: list[str]) -> Iterator[str]:
    """No blank lines from one list item to the next."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    blanks = set(range(len(lines))) - set(full)
    for a, b in zip(full, full[1:], strict=False):
        if b - a > 1 and _ITEM.match(lines[a]) and _ITEM.match(lines[b]):
            blanks.difference_update(range(a + 1, b))
    return (x for k, x in enumerate(lines) if x.strip() or k in blanks)


def _quotes(lines: Iterable[str]) -> Iterator[str]:
    """Gaps within a quote are one empty quoted line; an empty line follows it."""
    inside = gap = False
    for line in lines:
        bare = line.strip()
        if bare == ">" or (inside and not bare):
            gap = gap or inside
        elif line.startswith("> "):
            yield from [">", line] if gap else [line]
            inside, gap = True, False
        else:
            yield from ["", line] if inside else [line]
            inside = gap = False


def _tables(lines: Iterable[str]) -> Iterator[str]:
    """Rows of tables (with a rule below the first) with one space around each cell."""
    cells = lambda x: [c.strip() for c in x.strip().strip("|").split("|")]
    is_row = lambda x: len(y := x.strip()) > 1 and y[0] == y[-1] == "|"
    for row, block in groupby(lines, is_row):
        held = list(block)
        if row and len(held) > 1 and all(map(_RULE.fullmatch, cells(held[1]))):
            held = [f"| {' | '.join(['---'] * len(cells(x)) if k == 1 else cells(x))} |" for k, x in enumerate(held)]
        yield from held


def export_markdown(text: str) -> str:
    text = re.sub(r"\\([.!()\[\]])", r"\1", text)
    lines = [_STARRED.sub(r"\1- ", _heading(x), count=1) if _STARRED.match(_heading(x)) else _heading(x) for x in _underlined(text.replace("\r\n", "\n").split("\n"))]
    text = "\n".join(_tables(_quotes(_close_items(lines))))
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


def normalize_export_markdown_full(c: Column) -> Column:
    """Full mode: underlined and numbered headings, items, quotes and tables in one form."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else export_markdown(t))

    return F.pandas_udf(run, "string")(c)
