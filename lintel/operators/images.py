"""Images in Markdown: references, base64 stripping and extraction, numbering, localising."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.urls import host, image_extension

REFERENCE = r"""!\[([^\]]*)\]\((https?://[^\s)]+)(?:\s+["'][^"']*["'])?\)"""
EMBEDDED = r"""!\[([^\]]*)\]\(data:image/([a-zA-Z0-9.+-]+);base64,([A-Za-z0-9+/=\s]+?)(?:\s+"[^"]*")?\)"""


def _each(c: Column, pattern: str, **groups: int) -> Column:
    lists = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()]
    return F.arrays_zip(*lists)


def references(df: DataFrame, id_col: str, md_col: str = "markdown") -> DataFrame:
    """(id, ord, full_match, alt_text, url) of remote images in order."""
    found = df.select(id_col, _each(F.col(md_col), REFERENCE, full_match=0, alt_text=1, url=2).alias("r"))
    return found.select(id_col, F.posexplode("r").alias("ord", "r")).select(id_col, "ord", "r.*")


def strip_embedded(c: Column) -> Column:
    """Base64 images leave their alternative text, or an empty mark."""
    data = r"\(data:image/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=\s]+?(?:\s+\"[^\"]*\")?\)"
    return F.regexp_replace(F.regexp_replace(c, r"!\[\]" + data, "![]()"), r"!\[([^\]]+)\]" + data, r"*[image: $1]*")


def count_embedded(c: Column) -> Column:
    return F.regexp_count(c, F.lit(EMBEDDED))


def _kind(subtype: Column) -> Column:
    return F.when(subtype == "jpeg", "jpg").when(subtype == "svg+xml", "svg").otherwise(subtype)


def embedded(df: DataFrame, id_col: str, md_col: str = "markdown") -> DataFrame:
    """(id, ord, alt_text, name, bytes): names carry the first eight hex digits of the content's SHA-256."""
    found = df.select(id_col, _each(F.col(md_col), EMBEDDED, alt_text=1, subtype=2, data=3).alias("r"))
    rows = found.select(id_col, F.posexplode("r").alias("ord", "r")).withColumn("bytes", F.expr("try_to_binary(regexp_replace(r.data, '\\\\s+', ''), 'base64')"))
    name = F.concat(F.lit("image-"), F.substring(F.sha2("bytes", 256), 1, 8), F.lit("."), _kind(F.col("r.subtype")))
    return rows.where("bytes is not null").select(id_col, "ord", F.col("r.alt_text").alias("alt_text"), name.alias("name"), "bytes")


def extract_embedded(c: Column, folder: str = "images") -> Column:
    """Markdown with base64 images replaced by references to their files."""
    import base64
    import hashlib
    import re

    pattern = re.compile(EMBEDDED)

    def run(s: pd.Series) -> pd.Series:
        def named(m: re.Match) -> str:
            try:
                raw = base64.b64decode(re.sub(r"\s+", "", m[3]), validate=True)
            except ValueError:
                return m[0]
            ext = {"jpeg": "jpg", "svg+xml": "svg"}.get(m[2], m[2])
            return f"![{m[1]}]({folder}/image-{hashlib.sha256(raw).hexdigest()[:8]}.{ext})"

        return s.map(lambda t: None if t is None else pattern.sub(named, t))

    return F.pandas_udf(run, "string")(c)


def image_name(number: Column, ext: Column) -> Column:
    return F.format_string("image-%02d%s", number.cast("int"), ext)


def mode(embed: Column, extract: Column) -> Column:
    """Embedding wins over extraction; else images are stripped."""
    return F.when(embed, "embed").when(extract, "extract").otherwise("default")


def apply_mode(c: Column, chosen: str) -> Column:
    return c if chosen == "embed" else extract_embedded(c) if chosen == "extract" else strip_embedded(c)


def numbered(refs: DataFrame, id_col: str, keep_jpeg: bool = True) -> DataFrame:
    """One number for each distinct URL of a document, in order of first occurrence; every reference gets its local name."""
    first = Window.partitionBy(id_col, "url")
    order = Window.partitionBy(id_col).orderBy("first")
    seen = refs.withColumn("first", F.min("ord").over(first)).withColumn("n", F.dense_rank().over(order))
    return seen.withColumn("local", F.concat(F.lit("images/"), image_name(F.col("n"), image_extension(F.col("url"), keep_jpeg)))).drop("first")


def plan_every(df: DataFrame, id_col: str, md_col: str = "markdown", folder: str = "images") -> DataFrame:
    """``df`` with every remote reference, repeated ones too, renumbered in order, and ``pending``: what is to be fetched
    (url, filename), one for each. Native: the text between references is kept as it is."""
    between = F.split(F.col(md_col), REFERENCE, -1)
    found = _each(F.col(md_col), REFERENCE, alt=1, url=2)
    named = F.transform(found, lambda x, k: F.struct(x["alt"].alias("alt"), x["url"].alias("url"), image_name(k + 1, image_extension(x["url"], True)).alias("filename")))
    rows = df.withColumns({"_between": between, "_named": named})
    marks = F.transform("_named", lambda x: F.concat(F.lit("!["), x["alt"], F.lit(f"]({folder}/"), x["filename"], F.lit(")")))
    text = F.array_join(F.zip_with("_between", marks, lambda a, m: F.concat(a, F.coalesce(m, F.lit("")))), "")
    pending = F.transform("_named", lambda x: F.struct(x["url"].alias("url"), x["filename"].alias("filename")))
    return rows.withColumns({md_col: text, "pending": pending}).drop("_between", "_named")


#: An ``<img>`` with a base64 source.
EMBEDDED_TAG = r'''(?i)(<img\s[^>]*src=")data:image/(png|jpeg|jpg|gif|webp|svg\+xml);base64,([^"]+)(")'''


def embedded_in_html(df: DataFrame, id_col: str, html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Pages whose base64 images point to ``images/image-NN.ext``, numbered from 1, and the images' rows (id, ord, filename,
    mime_type, bytes; null bytes where the data isn't base64)."""
    found = _each(F.col(html_col), EMBEDDED_TAG, head=1, subtype=2, data=3)
    kinds = F.lower(F.col("r.subtype"))
    name = lambda k, subtype: image_name(k, F.concat(F.lit("."), _kind(F.lower(subtype))))
    between = F.split(F.col(html_col), EMBEDDED_TAG, -1)
    tags = F.transform(found, lambda x, k: F.concat(x["head"], F.lit("images/"), name(k + 1, x["subtype"]), F.lit('"')))
    pages = df.withColumns({"_between": between, "_tags": tags})
    pages = pages.withColumn(html_col, F.array_join(F.zip_with("_between", "_tags", lambda a, t: F.concat(a, F.coalesce(t, F.lit("")))), "")).drop("_between", "_tags")
    rows = df.select(id_col, F.posexplode(found).alias("ord", "r"))
    data = F.expr("try_to_binary(regexp_replace(r.data, '\\\\s+', ''), 'base64')")
    return pages, rows.select(id_col, "ord", name(F.col("ord") + 1, F.col("r.subtype")).alias("filename"), F.concat(F.lit("image/"), kinds).alias("mime_type"), data.alias("bytes"))


def present_in(refs: DataFrame, known: DataFrame, url_col: str = "url") -> DataFrame:
    """References whose URL is in the map of downloaded images: a semi join."""
    return refs.join(known.select(url_col).distinct(), url_col, "left_semi")


def localisable(refs: DataFrame, excluded: DataFrame | None = None, local: str = "images/") -> DataFrame:
    """References that are neither local yet nor at an excluded domain or below one: an anti join on the host (``excluded(domain)``, of any size)."""
    out = refs.where(~F.startswith("url", F.lit(local)))
    if excluded is None:
        return out
    # a host is excluded by one of its own endings: an equality for each label of it, over distinct hosts
    hosts = out.select(host(F.col("url")).alias("_host")).distinct()
    labels = F.split("_host", "\\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    known = excluded.select(F.lower("domain").alias("_end")).distinct()
    refused = hosts.select("_host", F.explode(endings).alias("_end")).join(known, "_end", "left_semi").select("_host").distinct()
    return out.withColumn("_host", host(F.col("url"))).join(refused, "_host", "left_anti").select(*out.columns)


def localise_document(df: DataFrame, id_col: str, images: DataFrame, receipts: DataFrame, md_col: str = "markdown", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Rich documents with every image of ``images(id, ord, url)`` by its local name in Markdown and HTML, downloaded or
    not, and the rows of those that were (id, filename, url, body)."""
    named = numbered(images.where("url is not null"), id_col).withColumn("filename", F.substring_index("local", "/", -1))
    rows = named.select(id_col, "url", "local", "filename").distinct()
    swaps = rows.groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct((-F.length("url")).alias("k"), "url", "local"))).alias("_swaps"))
    none = F.array().cast("array<struct<k:int,url:string,local:string>>")
    out = df.join(swaps, id_col, "left")
    for c in (md_col, html_col):
        out = out.withColumn(c, F.aggregate(F.coalesce("_swaps", none), F.col(c), lambda t, s: F.replace(t, s["url"], s["local"])))
    got = rows.join(receipts.where("body is not null and coalesce(status, 200) < 400").select("url", "body"), "url").select(id_col, "filename", "url", "body")
    return out.drop("_swaps"), got


def localise(df: DataFrame, id_col: str, receipts: DataFrame, md_col: str = "markdown") -> tuple[DataFrame, DataFrame]:
    """Markdown with downloaded images by local name (failed ones keep their URL), and the images' rows."""
    rows = numbered(references(df, id_col, md_col), id_col).join(receipts.select(F.col("url"), "body", "status"), "url", "left")
    rows = rows.withColumn("ok", F.col("body").isNotNull() & (F.coalesce("status", F.lit(200)) < 400))
    swaps = rows.where("ok").groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct((-F.length("url")).alias("k"), "url", "local"))).alias("swaps"))
    joined = df.join(swaps, id_col, "left")
    text = F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<k:int,url:string,local:string>>")), F.col(md_col), lambda t, s: F.replace(t, s["url"], s["local"]))
    return joined.withColumn(md_col, text).drop("swaps"), rows
