"""Archives and office documents as bytes, from rows of entries."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.urls import ensure_absolute, host, resolved
from lintel.html import markdown as md
from lintel.html.rewrite import absolutise, absolutise_tree, pretty
from lintel.html.tree import Node, parse, serialize
from lintel.operators.images import embedded, extract_embedded

#: Zip members carry this time, so that equal entries give equal bytes.
WHEN = (1980, 1, 1, 0, 0, 0)


def packed(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in entries:
            z.writestr(zipfile.ZipInfo(path, WHEN), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def zip_entries(entries: DataFrame, key: str) -> DataFrame:
    """(key, zip) from ``entries(key, path, bytes)``; members in order of path."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda rows: packed([(r["path"], bytes(r["bytes"])) for r in rows]))

    return entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "bytes"))).alias("rows")).select(key, pack("rows").alias("zip"))


def page_entries(pages: DataFrame, key: str, markdown: str = "markdown", html: str = "html", images: DataFrame | None = None) -> DataFrame:
    """``document.md``, ``document.html`` and the images of each page as entries."""
    made = [pages.select(key, F.lit(name).alias("path"), F.col(c).cast("binary").alias("bytes")) for name, c in (("document.md", markdown), ("document.html", html))]
    rows = made[0].unionByName(made[1])
    return rows.unionByName(images.select(key, F.concat(F.lit("images/"), F.col("name")).alias("path"), "bytes")) if images is not None else rows


PLAN = "html string, markdown string, images array<struct<url:string,path:string>>, styles array<struct<url:string,path:string>>"
#: Extensions that a hint may name, and that an address may end in.
HINTS, ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "svg"), {".jpg": "jpg", ".jpeg": "jpg", ".gif": "gif", ".webp": "webp", ".svg": "svg"}


def planned(html: str | None, url: str, as_html: bool, local: bool, hint_attribute: str = "data-extension") -> dict:
    """A page's document and what its archive is to hold besides: images in order of their first occurrence, one path for each
    address, and (of an HTML document) its stylesheets."""
    out: dict = {"html": None, "markdown": None, "images": [], "styles": []}
    if html is None:
        return out
    root = parse(html)
    paths: dict[str, str] = {}
    hints: dict[str, str] = {}
    seen = []
    for n in root.find_all("img"):
        src = n.attrs.get("src", "")
        if src and not src.startswith(("data:", "blob:")):
            at = resolved(src, url)
            seen.append((n, at))
            hint = n.attrs.get(hint_attribute, "").lower().removeprefix(".")
            if hint in HINTS:
                hints.setdefault(at, hint)
    if local:
        for _, at in seen:
            if at not in paths:
                ending = next((x for e, x in ENDINGS.items() if re.split("[?#]", at)[0].lower().endswith(e)), "png")
                paths[at] = f"images/image-{len(paths) + 1}.{hints.get(at, ending)}"
    out["images"] = [{"url": k, "path": v} for k, v in paths.items()]
    if not as_html:
        text = md.to_markdown(html, url)
        for k in sorted(paths, key=len, reverse=True):  # an address may begin another one
            text = text.replace(k, paths[k])
        out["markdown"], out["html"] = text, pretty(absolutise(html, url))
        return out
    absolutise_tree(root, url)
    for n in root.find_all("script", "noscript"):
        n.remove()
    for n, at in seen:
        n.attrs["src"] = paths.get(at, n.attrs["src"])
    if local:
        for n in root.find_all("link"):
            href = n.attrs.get("href", "")
            if n.attrs.get("rel") == "stylesheet" and href and not href.startswith("data:"):
                path = f"css/style-{len(out['styles']) + 1}.css"
                out["styles"].append({"url": href, "path": path})
                n.attrs["href"] = path
    out["html"] = pretty(serialize(root))
    return out


def plan(pages: DataFrame, html_col: str = "html", url_col: str = "url", document: str = "markdown", local_images: bool = True, keep_links: bool = False, hint_attribute: str = "data-extension") -> DataFrame:
    """``pages`` with a struct ``plan``; ``document`` is markdown or html. Original links are kept by keeping images remote.
    ``hint_attribute`` of an image names its extension where the address doesn't."""

    @F.pandas_udf(PLAN)
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [planned(h, u, document == "html", local_images and not keep_links, hint_attribute) for h, u in zip(html, url, strict=True)]
        return pd.DataFrame(rows, columns=["html", "markdown", "images", "styles"])

    return pages.withColumn("plan", run(F.col(html_col), ensure_absolute(F.col(url_col))))


def archive_entries(pages: DataFrame, key: str, receipts: DataFrame, document: str = "markdown", embed_images: bool = False, keep_links: bool = False, **options) -> DataFrame:
    """(key, path, bytes): a page's documents, and of the images and stylesheets of its plan those that receipts have.

    Base64 images of a Markdown document become files, unless images are embedded or links kept."""
    rows = plan(pages, document=document, keep_links=keep_links, **options)
    texts = rows.select(key, F.lit("document.html").alias("path"), F.col("plan.html").alias("text"))
    parts = []
    if document != "html":
        made = rows.select(key, F.col("plan.markdown").alias("markdown"))
        if not (embed_images or keep_links):
            parts.append(embedded(made, key).select(key, F.concat(F.lit("images/"), F.col("name")).alias("path"), "bytes").distinct())
            made = made.withColumn("markdown", extract_embedded(F.col("markdown")))
        texts = texts.unionByName(made.select(key, F.lit("document.md").alias("path"), F.col("markdown").alias("text")))
    wanted = rows.select(key, F.explode(F.concat("plan.images", "plan.styles")).alias("x")).select(key, "x.url", "x.path")
    got = receipts.where("body is not null and coalesce(status, 200) < 400").select("url", F.col("body").alias("bytes"))
    out = texts.where("text is not null").select(key, "path", F.col("text").cast("binary").alias("bytes")).unionByName(wanted.join(got, "url").select(key, "path", "bytes"))
    for x in parts:
        out = out.unionByName(x)
    return out


def archive_name(url: Column) -> Column:
    return F.concat(F.replace(host(url), F.lit("."), F.lit("-")), F.lit("-archive.zip"))


def paste_entries(pastes: DataFrame, key: str, least: int = 1_500) -> DataFrame:
    """Long text pastes as an index, the page and the raw text; shorter ones have no archive."""
    long = pastes.where(F.size(F.split("raw", "\n")) >= least)
    index = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n- [Page](page.md)\n- [Raw text]("), F.col("name"), F.lit(")\n"))
    parts = [("index.md", index), ("page.md", F.col("markdown"))]
    rows = [long.select(key, F.lit(p).alias("path"), c.cast("binary").alias("bytes")) for p, c in parts] + [long.select(key, F.col("name").alias("path"), F.col("raw").cast("binary").alias("bytes"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ---- office documents -----------------------------------------------------------------------

BLOCKS = "array<struct<kind:string,level:int,text:string,href:string>>"


def blocks_of(html: str | None) -> list[dict]:
    """Typed rows of a page: title, headings, paragraphs, bullets, code, figures, links."""
    root, out = parse(html), []
    title = root.first("title")
    if title is not None and title.content().strip():
        out.append({"kind": "title", "level": 0, "text": title.content().strip(), "href": None})

    def visit(n: Node) -> None:
        for c in n.kids():
            text = " ".join(c.content().split())
            if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append({"kind": "heading", "level": int(c.tag[1]), "text": text, "href": None})
            elif c.tag == "pre":
                out.append({"kind": "code", "level": 0, "text": c.content(), "href": None})
            elif c.tag == "img":
                out.append({"kind": "figure", "level": 0, "text": c.attrs.get("alt", ""), "href": c.attrs.get("src")})
            elif c.tag == "li" and not c.kids("ul", "ol", "p"):
                out.append({"kind": "bullet", "level": 0, "text": text, "href": None})
            elif c.tag == "p":
                links = c.find_all("a")
                out.append({"kind": "paragraph", "level": 0, "text": text, "href": links[0].attrs.get("href") if links else None})
                visit(c)
            elif c.tag not in ("script", "style", "noscript", "head"):
                visit(c)

    visit(root)
    return [b for b in out if b["text"] or b["href"]]


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def docx_of(blocks: list[dict]) -> bytes:
    body = ""
    for b in blocks:
        style = {"title": "Title", "heading": f"Heading{b['level']}", "bullet": "ListBullet"}.get(b["kind"])
        look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        font = '<w:rPr><w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/></w:rPr>' if b["kind"] == "code" else ""
        text = b["text"] + (f" ({b['href']})" if b["href"] else "")
        runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\n"))
        body += f"<w:p>{look}<w:r>{font}{runs}</w:r></w:p>"
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    return packed([("[Content_Types].xml", _TYPES.encode()), ("_rels/.rels", _RELS.encode()), ("word/document.xml", document.encode())])


def document_blocks(html: Column) -> Column:
    @F.pandas_udf(BLOCKS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(blocks_of)

    return run(html)


def docx(blocks: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda rows: docx_of([dict(r) for r in rows]) if rows is not None else None)

    return run(blocks)
