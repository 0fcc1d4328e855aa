"""Page operators: one parse a page in an Arrow function, everything else on its result."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from lintel.functions.text import SPACE, postprocessed
from lintel.functions.urls import resolved
from lintel.html import markdown as md
from lintel.html.rewrite import absolutise, formula_of, pretty, rewritten, without_overlays
from lintel.html.tree import Node, parse

NAMED = "array<struct<name:string,url:string>>"
METADATA = (
    "author string, author_url string, publish_date string, publish_date_text string, date_modified string, author_full_name string, "
    "author_karma string, reading_time string, difficulty string, views string, votes string, comments string, bookmarks string, "
    f"hubs array<string>, hub_urls {NAMED}, tags array<string>, tag_links {NAMED}, is_translation boolean, translation_label string, "
    "original_article_url string, original_authors string, original_author_text string"
)
#: The class of the element that shows a field's text, and other classes that fields come from.
TEXT_FIELDS = {
    "reading_time": "tm-article-reading-time__label", "difficulty": "tm-article-complexity__label", "votes": "tm-votes-meter__value",
    "comments": "tm-article-comments-counter-link__value", "bookmarks": "bookmarks-button__counter", "author_karma": "tm-karma__votes",
    "translation_label": "tm-publication-label_variant-translation",
}
AUTHOR, VIEWS, HUB, ORIGIN = "tm-user-info__username", "tm-icon-counter__value", "tm-publication-hub__link", "tm-article-presenter__origin-link"
TAG_LISTS, TAG_LINK = "tm-article-body__tags-item", "tm-tags-list__link"


def metadata_of(root: Node) -> dict:
    """Article metadata by class; absent fields are null. One walk over the page."""
    out: dict = dict.fromkeys(x.split()[0] for x in METADATA.split(", ") if not x.startswith(("url",)))
    classes: dict[str, list[Node]] = {}
    tags: dict[str, list[Node]] = {}
    for n in root.elements():
        if n.tag in ("time", "meta", "script"):
            tags.setdefault(n.tag, []).append(n)
        for c in dict.fromkeys(n.attrs.get("class", "").split()):
            classes.setdefault(c, []).append(n)
    shown = lambda n: n.content().strip()

    for name, c in TEXT_FIELDS.items():
        out[name] = "".join(n.content() for n in classes[c]).strip() if c in classes else None
    out["is_translation"] = True if out["translation_label"] is not None else None
    for who in classes.get(AUTHOR, [])[:1]:
        out["author"], out["author_url"] = shown(who), who.attrs.get("href")
    for when in [n for n in tags.get("time", []) if "datetime" in n.attrs][:1]:
        out["publish_date"], out["publish_date_text"] = when.attrs["datetime"], shown(when)
    for views in classes.get(VIEWS, [])[:1]:
        out["views"] = views.attrs.get("title") or shown(views)
    hubs = []
    for n in classes.get(HUB, []):
        first = n.first("span")
        hubs.append({"name": shown(first) if first is not None else re.sub(r"\s*\*\s*$", "", shown(n)), "url": n.attrs.get("href")})
    if hubs:
        out["hubs"], out["hub_urls"] = [h["name"] for h in hubs], hubs
    for n in [n for n in tags.get("meta", []) if n.attrs.get("name") == "keywords"][:1]:
        out["tags"] = [t.strip() for t in n.attrs.get("content", "").split(",") if t.strip()] or None
    if TAG_LISTS in classes or TAG_LINK in classes:
        linked = {id(a) for n in classes.get(TAG_LISTS, []) for a in n.find_all("a")} | {id(n) for n in classes.get(TAG_LINK, [])}
        out["tag_links"] = [{"name": shown(n), "url": n.attrs.get("href")} for n in root.elements() if id(n) in linked] or None
    for n in classes.get(ORIGIN, [])[:1]:
        out["original_article_url"], out["original_author_text"] = n.attrs.get("href"), shown(n)
        out["original_authors"] = "".join(s.content() for s in n.find_all("span")).strip() or None
    for n in [n for n in tags.get("script", []) if n.attrs.get("type") == "application/ld+json"][:1]:
        try:
            data = json.loads(n.content())
            out["date_modified"] = data.get("dateModified")
            author = data.get("author")
            out["author_full_name"] = author.get("name") if isinstance(author, dict) else None
        except (ValueError, AttributeError):
            pass
    return out


def figures_of(root: Node, base: str | None) -> list[dict]:
    """The first usable image of each figure, numbered by its caption or else by order."""
    out = []
    for fig in root.find_all("figure"):
        img = fig.first("img")
        src = img.attrs.get("src", "") if img is not None else ""
        if not src or src.startswith("data:") or ".svg" in src:
            continue
        caption = "".join(c.content() for c in fig.find_all("figcaption")).strip()
        number = re.search(r"(?i)(?:Figure|Рис\.?|Рисунок)\s*(\d+)", caption)
        k = len(out) + 1
        out.append({"figure_num": int(number[1]) if number else k, "src": resolved(src, base), "alt": img.attrs.get("alt", ""), "caption": caption, "sequential_index": k})
    return out


PARSED = (
    "title string, markdown string, text string, headings array<struct<level:int,text:string>>, links array<struct<href:string,url:string,text:string>>, "
    "images array<struct<src:string,url:string,alt:string>>, meta_tags array<struct<name:string,content:string>>, stylesheets array<string>, "
    "figures array<struct<figure_num:int,src:string,alt:string,caption:string,sequential_index:int>>, formulas array<struct<kind:string,latex:string>>, "
    f"tables array<struct<n_rows:int,n_columns:int,cells:array<array<string>>,markdown:string>>, json_ld array<string>, warnings array<string>, metadata struct<{re.sub(r'(\w+) (\w+(?:<.*?>+)?)(?=,|$)', r'\1:\2', METADATA)}>"
)
FIELDS = ("title", "markdown", "text", "headings", "links", "images", "meta_tags", "stylesheets", "figures", "formulas", "tables", "json_ld", "warnings", "metadata")


def parsed_page(html: str | None, url: str | None, want: frozenset[str], content: str | None = None, body: str | None = None, clean: bool = False) -> dict:
    out: dict = dict.fromkeys(FIELDS)
    if html is None:
        return out
    if want == {"tables"} and (plain := md.plain_tables(html)) is not None:
        out["tables"] = [_sized(cells, made) for cells, made in plain]
        return out
    root = parse(html)
    if "title" in want:
        n = root.first("title")
        out["title"] = n.content().strip() if n is not None else None
    if "headings" in want:
        out["headings"] = [{"level": int(n.tag[1]), "text": " ".join(n.content().split())} for n in root.find_all("h1", "h2", "h3", "h4", "h5", "h6")]
    if "links" in want:
        out["links"] = [{"href": n.attrs["href"], "url": resolved(n.attrs["href"], url), "text": " ".join(n.content().split())} for n in root.find_all("a") if "href" in n.attrs]
    if "images" in want:
        out["images"] = [{"src": n.attrs["src"], "url": resolved(n.attrs["src"], url), "alt": n.attrs.get("alt", "")} for n in root.find_all("img") if n.attrs.get("src")]
    if "meta_tags" in want:
        out["meta_tags"] = [{"name": n.attrs.get("property") or n.attrs.get("name"), "content": n.attrs.get("content", "")} for n in root.find_all("meta") if n.attrs.get("property") or n.attrs.get("name")]
    if "stylesheets" in want:
        out["stylesheets"] = [n.attrs["href"] for n in root.find_all("link") if "stylesheet" in n.attrs.get("rel", "").split() and n.attrs.get("href")]
    if "figures" in want:
        out["figures"] = figures_of(root, url)
    if "formulas" in want:
        out["formulas"] = [{"kind": n.tag, "latex": tex} for n in root.elements() if (tex := formula_of(n))]
    if "warnings" in want:
        out["warnings"] = warnings_of(html, root)
    if "json_ld" in want:
        out["json_ld"] = [n.content() for n in root.find_all("script") if n.attrs.get("type") == "application/ld+json"]
    if "metadata" in want:
        out["metadata"] = metadata_of(root)
    if "text" in want:
        out["text"] = md.shown_text(root)
    if "tables" in want:
        out["tables"] = [table_of(n) for n in root.find_all("table")]
    if "markdown" in want:  # last: its rewrites change the tree
        made = md.render(rewritten(root, html, url, content, body, enhanced=True)).replace("\u00a0", " ")
        made = re.sub(r"(?: {2,}\n){2,}", "\n\n", made)
        out["markdown"] = postprocessed(made) if clean else made
    return out


def table_of(n: Node) -> dict:
    """Size, cells and Markdown of a table; the tree stays as it is."""
    rows = [[" ".join(c.content().split()) for c in r.kids("td", "th")] for r in md.rows_of(n)]
    return _sized(rows, md.table_markdown(n))


def _sized(rows: list[list[str]], made: str) -> dict:
    return {"n_rows": len(rows), "n_columns": max(map(len, rows), default=0), "cells": rows, "markdown": made}


def warnings_of(html: str, root: Node) -> list[str]:
    """What of a page was dropped or guessed."""
    said = []
    if "\ufffd" in html:
        said.append("the text holds replacement characters")
    if any(n.attrs.get("src", "").startswith("data:") for n in root.find_all("img")):
        said.append("images are embedded")
    if root.find_all("iframe", "object", "embed"):
        said.append("embedded frames were dropped")
    if root.find_all("canvas", "svg"):
        said.append("drawings were dropped")
    return said


#: Inputs of fewer bytes for each core are dealt out before they are parsed.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input, of which a file may be one task, dealt to all cores; a large one as it is read, without a shuffle."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # an estimate from file sizes; runs nothing
    return df.repartition(cores) if size <= cores * SPREAD_BYTES else df


#: Bytes of pages whose results are held at once: cells of a table take some 30 times its bytes in Python.
PIECE_BYTES = 1 << 20


def pieces(html: pa.Array) -> Iterator[slice]:
    """Rows of at most so many bytes, one row at least; a batch has thousands of pages, of any size."""
    size = np.cumsum(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE_BYTES, "right")))
        yield slice(at, end)
        at = end


def parse_pages(pages: DataFrame, want: tuple[str, ...] = FIELDS, html_col: str = "html", url_col: str = "url", content: str | None = None, body: str | None = None, clean: bool = False) -> DataFrame:
    """``pages`` with a struct ``page`` of the wanted fields, from one parse a page. Fields not asked for are null and cost
    nothing. ``clean``: Markdown is post-processed in the same call."""
    wanted = frozenset(want)

    kind = to_arrow_type(DataType.fromDDL(PARSED))

    @F.arrow_udf(PARSED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, url in batches:
            for x in pieces(html):
                yield pa.array([parsed_page(h, u, wanted, content, body, clean) for h, u in zip(html[x].to_pylist(), url[x].to_pylist(), strict=True)], kind)

    return spread(pages).withColumn("page", run(F.col(html_col), F.col(url_col)))


def _string_udf(f):
    return F.pandas_udf(f, "string")


def to_markdown(html: Column, base: Column) -> Column:
    """The basic converter."""

    def convert(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else md.to_markdown(x, y) for x, y in zip(h, b, strict=True)], dtype=object)

    return _string_udf(convert)(html, base)


def absolute_html(html: Column, base: Column) -> Column:
    def convert(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else absolutise(x, y) for x, y in zip(h, b, strict=True)], dtype=object)

    return _string_udf(convert)(html, base)


def pretty_html(html: Column) -> Column:
    def convert(h: pd.Series) -> pd.Series:
        return h.map(lambda x: None if x is None else pretty(x))

    return _string_udf(convert)(html)


def enhanced_markdown(pages: DataFrame, **options) -> DataFrame:
    """Markdown and metadata of each page, post-processed."""
    parsed = parse_pages(pages, ("markdown", "metadata"), clean=True, **options)
    return parsed.withColumn("markdown", F.col("page.markdown")).withColumn("metadata", F.col("page.metadata")).drop("page")


def _linked(text: Column, url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")"))).otherwise(text)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _lines(*lines: Column) -> Column:
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def _stats(*named: tuple[str, Column]) -> Column:
    """``**A: x | B: y**`` of those that are known; null if none is."""
    known = _lines(*[F.concat(F.lit(f"{name}: "), _filled(c)) for name, c in named])
    return F.when(F.size(known) > 0, F.concat(F.lit("**"), F.array_join(known, " | "), F.lit("**")))


def _author(c) -> Column:
    name = F.when(_filled(c("author_full_name")).isNotNull(), F.concat(c("author_full_name"), F.lit(" ("), c("author"), F.lit(")"))).otherwise(c("author"))
    return F.when(_filled(c("author")).isNotNull(), F.concat(F.lit("**Author:** "), _linked(name, c("author_url"))))


def metadata_header(m: str = "metadata") -> Column:
    """The lines above an article: what is known of it."""
    c = lambda name: F.col(f"{m}.{name}")
    day = lambda x: F.date_format(F.try_to_timestamp(x), "MMMM d, yyyy")
    changed = F.when(day(c("date_modified")) != day(c("publish_date")), F.concat(F.lit(" (updated "), day(c("date_modified")), F.lit(")")))
    listed = lambda label, x: F.when(F.size(x) > 0, F.concat(F.lit(f"**{label}:** "), F.array_join(x, ", ")))
    original = F.when(_filled(c("original_article_url")).isNotNull(), F.concat(F.lit("**Original article:** "), _linked(c("original_authors"), c("original_article_url"))))
    return _lines(
        _author(c),
        F.when(c("is_translation"), F.concat(F.lit("**Type:** "), F.coalesce(_filled(c("translation_label")), F.lit("Translation")))),
        F.when(_filled(c("original_authors")).isNotNull(), F.coalesce(original, F.concat(F.lit("**Original authors:** "), c("original_authors")))),
        F.when(_filled(c("publish_date")).isNotNull(), F.concat(F.lit("**Published:** "), F.coalesce(day(c("publish_date")), c("publish_date_text"), c("publish_date")), F.coalesce(changed, F.lit("")))),
        _stats(("Reading time", c("reading_time")), ("Difficulty", c("difficulty")), ("Views", c("views"))),
        listed("Hubs", c("hubs")),
        listed("Tags", c("tags")),
    )


def metadata_footer(m: str = "metadata") -> Column:
    """The lines below an article: a rule, tags and hubs with their links, numbers, the author; an empty line after each."""
    c = lambda name: F.col(f"{m}.{name}")
    links = lambda label, x, plain: F.when(F.size(x) > 0, F.concat(F.lit(f"**{label}:** "), F.array_join(F.transform(x, lambda y: _linked(y["name"], y["url"])), ", "))).when(F.size(plain) > 0, F.concat(F.lit(f"**{label}:** "), F.array_join(plain, ", ")))
    author = F.concat(_author(c), F.when(_filled(c("author_karma")).isNotNull(), F.concat(F.lit(" | Karma: "), c("author_karma"))).otherwise(""))
    stats = _stats(("Votes", c("votes")), ("Views", c("views")), ("Bookmarks", c("bookmarks")), ("Comments", c("comments")))
    lines = _lines(F.lit("---"), links("Tags", c("tag_links"), c("tags")), links("Hubs", c("hub_urls"), c("hubs")), stats, author)
    return F.when(F.col(m).isNotNull(), F.flatten(F.transform(lines, lambda x: F.array(x, F.lit(""))))).otherwise(F.array().cast("array<string>"))


def figure_rows(figures: DataFrame, id_col: str, receipts: DataFrame) -> DataFrame:
    """(id, figure_num, filename, caption, original_url, body, error) of ``figures(id, figure_num, src, caption)``: one row each,
    downloaded or not, from receipts of their addresses."""
    jpeg = F.contains("src", F.lit(".jpeg")) | F.contains("src", F.lit(".jpg"))
    named = figures.withColumn("filename", F.concat(F.lit("figure-"), F.col("figure_num").cast("string"), F.when(jpeg, ".jpg").otherwise(".png")))
    got = receipts.select(F.col("url").alias("src"), "status", F.col("body").alias("_body"), *([F.col("error").alias("_error")] if "error" in receipts.columns else [F.lit(None).cast("string").alias("_error")]))
    ok = F.col("_body").isNotNull() & (F.coalesce("status", F.lit(200)) < 400)
    said = F.coalesce("_error", F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))), F.lit("not fetched"))
    return named.join(got, "src", "left").select(id_col, "figure_num", "filename", "caption", F.col("src").alias("original_url"), F.when(ok, F.col("_body")).alias("body"), F.when(~ok, said).alias("error"))


def without_popups(html: Column) -> Column:
    """The page without consent dialogs, popups and banners, by their classes (the static form of dismissing them)."""

    def convert(h: pd.Series) -> pd.Series:
        return h.map(lambda x: None if x is None else without_overlays(x))

    return _string_udf(convert)(html)


# ---- native forms on the raw text -------------------------------------------------------

RAW_LINK = r"""(?is)<a\b[^>]*?\shref=["']([^"']*)["'][^>]*>"""


def raw_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, ord, href) of each anchor, by pattern and without Python."""
    found = F.regexp_extract_all("html", F.lit(RAW_LINK), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("ord", "href"))


def tag_tokens(pages: DataFrame) -> DataFrame:
    """(page_id, ord, token): the tags of the page in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<[^>]+>"), F.lit(0))).alias("ord", "token"))


def indent_depths(pages: DataFrame) -> DataFrame:
    """Depth before each tag as a running sum that never falls below 0: the sum less its lowest value so far."""
    name = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][\w-]*)", 1))
    void = name.isin("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
    step = F.when(F.startswith("token", F.lit("</")), -1).when(F.endswith("token", F.lit("/>")) | void | (name == ""), 0).otherwise(1)
    order = Window.partitionBy("page_id").orderBy("ord")
    summed = tag_tokens(pages).withColumn("step", step).withColumn("sum", F.sum("step").over(order))
    return summed.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order))).drop("sum")


def page_title(html: Column) -> Column:
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.regexp_replace(F.regexp_replace(title, f"^{SPACE}+|{SPACE}+$", ""), r"(?i)^ChatGPT\s*-\s*", "")
