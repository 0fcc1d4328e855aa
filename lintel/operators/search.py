"""Search results from provider bodies: parse, limit, diagnose, render."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.predicates import is_captcha
from lintel.functions.urls import search_url
from lintel.html.tree import Node, parse, select

RESULTS = "array<struct<rank:int,title:string,url:string,snippet:string>>"
PAGES = "pages array<struct<key:string,title:string,excerpt:string,description:string>>"

#: Where providers' pages hold results: item, link, title, snippet.
SHAPES = {
    "duckduckgo": (".result__body", "a.result__a", "a.result__a", ".result__snippet"),
    "google": ("div.g, div.tF2Cxc, div.MjjYud", 'a[href^="http"]', "h3", ".VwiC3b, .IsZvec, .aCOpRe"),
    "bing": ("li.b_algo", "h2 a", "h2 a", ".b_caption p, p"),
    "brave": ("div.snippet", 'a[href^="http"]', ".title", ".snippet-description, .snippet-content"),
}
INSTEAD = {"duckduckgo": ".web-result"}


def _squeezed(n: Node | None) -> str:
    return " ".join(n.content().split()) if n is not None else ""


def html_results(provider: str, body: str | None, k: int) -> list[dict]:
    """Ranked results of a provider's page; entries without title or address are passed over before counting."""
    if not body or provider not in SHAPES:
        return []
    item, link, title, snippet = SHAPES[provider]
    root = parse(body)
    blocks = select(root, item) or (select(root, INSTEAD[provider]) if provider in INSTEAD else [])
    out: list[dict] = []
    first = lambda n, s: next(iter(select(n, s)), None)
    for block in blocks:
        a = first(block, link)
        if a is None:
            continue
        name = _squeezed(first(block, title)) or (_squeezed(a) if provider == "brave" else "")
        url = a.attrs.get("href", "")
        if provider == "duckduckgo":
            full = "https:" + url if url.startswith("//") else url
            url = parse_qs(urlsplit(full).query).get("uddg", [full])[0]
        if name and url:
            out.append({"rank": len(out) + 1, "title": name, "url": url, "snippet": _squeezed(first(block, snippet))})
        if len(out) == k:
            break
    return out


def json_results(body: Column, k: Column | int = 10) -> Column:
    """Results of the JSON provider, natively: title or key, excerpt or description."""
    pages = F.from_json(body, PAGES)["pages"]
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>", " "), r"\s+", " "))
    made = F.transform(
        pages,
        lambda p, i: F.struct(
            (i + 1).cast("int").alias("rank"),
            bare(F.coalesce(F.nullif(p["title"], F.lit("")), p["key"])).alias("title"),
            F.concat(F.lit("https://en.wikipedia.org/wiki/"), p["key"]).alias("url"),
            bare(F.coalesce(F.nullif(p["excerpt"], F.lit("")), p["description"])).alias("snippet"),
        ),
    )
    return F.coalesce(F.slice(made, 1, k), F.array().cast(RESULTS))


def page_results(provider: Column, body: Column, k: int) -> Column:
    @F.pandas_udf(RESULTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, bodies in batches:
            yield pd.Series([html_results(p, b, k) for p, b in zip(names, bodies, strict=True)])

    return run(provider, body)


def run_searches(queries: DataFrame, receipts: DataFrame, k: int = 10, captured_at: str | None = None) -> DataFrame:
    """``queries(query, provider)`` joined to their receipts by URL; failures give no results and a diagnosis."""
    asked = queries.withColumn("source_url", search_url(F.col("provider"), F.col("query"), k))
    got = asked.join(receipts.select(F.col("url").alias("source_url"), "status", F.col("body").cast("string").alias("body"), "error", "error_kind"), "source_url", "left")
    json_rows = json_results(F.col("body"), k)
    results = F.when(F.col("provider") == "wikipedia", json_rows).otherwise(page_results(F.col("provider"), F.col("body"), k))
    missing = F.when(F.col("source_url").isNull(), "Unknown search provider").when(F.col("body").isNull(), F.coalesce("error", F.lit("no response")))
    return got.select(
        "query", "provider", F.lit("http").alias("capture_mode"), F.lit(captured_at).alias("captured_at"),
        F.coalesce(results, F.array().cast(RESULTS)).alias("results"),
        F.struct(F.col("status"), (F.col("error_kind") == "cors_or_transport").alias("blocked_by_cors"), is_captcha(F.col("body")).alias("blocked_by_captcha"), "source_url", missing.alias("error"), "error_kind").alias("diagnostics"),
    )


def first_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; the limit is pushed below the shuffle as a group limit."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def results_markdown(query: Column, provider: Column, results: Column) -> Column:
    lines = F.transform(results, lambda r: F.concat(r["rank"].cast("string"), F.lit(". ["), r["title"], F.lit("]("), r["url"], F.lit(")"), F.when(r["snippet"] != "", F.concat(F.lit("\n   "), r["snippet"])).otherwise("")))
    head = F.concat(F.lit("# Search results: "), query, F.lit("\n\nProvider: "), provider, F.lit("\n\n"))
    return F.concat(head, F.when(F.size(results) > 0, F.array_join(lines, "\n")).otherwise("No results."), F.lit("\n"))
