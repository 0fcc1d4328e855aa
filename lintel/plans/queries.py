"""Registered queries over the tables, and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.functions import predicates as P
from lintel.functions import text as X
from lintel.functions import urls as U
from lintel.operators import archive, batch, dialog, frames, images, pages, relational, repo, richdoc, search, verify
from lintel.sources import receipts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def mapped(name: str, of: str, key: str, sql: str | None = None, /, **columns):
    """A query of columns of one table."""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, of).select(key, *[(c() if callable(c) else c).alias(n) for n, c in columns.items()])

    return run


SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_rx = lambda s: s.replace("'", "''")


def h() -> Column:
    return F.col("html")


def t() -> Column:
    return F.col("text")



# ---- pages ------------------------------------------------------------------------------

mapped("page_title", "pages", "page_id", r"SELECT page_id, regexp_replace(regexp_extract(html, '<title[^>]*>([\s\S]*?)</title>', 1, 'i'), '^\s+|\s+$', '', 'g') AS title FROM pages", title=lambda: pages.page_title(h()))
mapped("h1_is_complete", "pages", "page_id", r"SELECT page_id, regexp_matches(html, '<html[\s>][\s\S]*</html>', 'i') AS complete FROM pages", complete=lambda: P.is_complete_html(h()))
mapped("h2_has_script", "pages", "page_id", r"SELECT page_id, regexp_matches(html, '<script[^>]*>[\s\S]*?</script>|<script[^>]*/>|javascript:', 'i') AS scripted FROM pages", scripted=lambda: P.has_script(h()))
mapped("h3_client_markers", "pages", "page_id", f"SELECT page_id, regexp_matches(html, '{_rx(P.RENDERED.removeprefix('(?i)'))}', 'i') AS marked FROM pages", marked=lambda: P.has_client_markers(h()))
_BARE = r"regexp_replace(regexp_replace(html, '<script\b[\s\S]*?</script\s*>|<style\b[\s\S]*?</style\s*>|<noscript\b[\s\S]*?</noscript\s*>|<template\b[\s\S]*?</template\s*>|<!--[\s\S]*?-->|<head\b[\s\S]*?</head>', '', 'gi'), '<[^>]*>', '', 'g')"
mapped("h4_static_text_length", "pages", "page_id", f"SELECT page_id, CAST(length(trim(regexp_replace({_BARE}, '{SPACE}+', ' ', 'g'), ' ')) AS INTEGER) AS n FROM pages", n=lambda: P.static_text_length(h()))
mapped("h5_should_render", "pages", "page_id", r"SELECT page_id, NOT regexp_matches(html, '<html[\s>][\s\S]*</html>', 'i') OR regexp_matches(html, '<script[^>]*>[\s\S]*?</script>|<script[^>]*/>|javascript:', 'i') AS renders FROM pages", renders=lambda: P.html_route_renders(h()))
mapped("h6_captcha", "documents", "doc_id", f"SELECT doc_id, regexp_matches(text, '{_rx(P.CAPTCHA.removeprefix('(?i)'))}', 'i') AS captcha FROM documents", captcha=lambda: P.is_captcha(t()))
mapped(
    "h7_interstitial", "documents", "doc_id",
    "SELECT doc_id, contains(text, 'share.google/aimode') OR (contains(text, 'Google Search') AND contains(text, 'If you''re having trouble accessing Google Search')) OR (contains(text, '/search?q=') AND contains(text, 'enablejs')) OR (contains(text, '/httpservice/retry/enablejs') AND contains(text, 'Google Search')) AS blocked FROM documents",
    blocked=lambda: P.is_interstitial(t()),
)
mapped(
    "h8_unsupported_reason", "documents", "doc_id",
    f"SELECT doc_id, CASE WHEN regexp_matches(text, '{P.LOGIN.removeprefix('(?i)')}', 'i') THEN 'login_required' WHEN regexp_matches(text, '{P.GONE.removeprefix('(?i)')}', 'i') THEN 'deleted_or_expired_share' WHEN source = 'src1' THEN 'unsupported_provider_format' ELSE 'no_transcript_in_captured_dom' END AS reason FROM documents",
    reason=lambda: P.unsupported_reason(t(), F.when(F.col("source") == "src1", "unknown").otherwise("chatgpt")),
)
mapped("h10_charset", "pages", "page_id", """SELECT page_id, lower(regexp_extract(html, '<meta[^>]+charset=["'']?([^"''>\\s]+)', 1, 'i')) AS charset FROM pages""", charset=lambda: P.declared_charset(h()))
mapped("t2_utf8_charset", "pages", "page_id", """SELECT page_id, md5(regexp_replace(html, '(<meta[^>]+charset=["'']?)[^"''>\\s]+', '\\1utf-8', 'gi')) AS digest FROM pages""", digest=lambda: F.md5(P.with_utf8_charset(h())))
mapped("k1_output_path", "pages", "page_id", r"SELECT page_id, 'data/' || lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) || CASE WHEN trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') = '' THEN '' ELSE '/' || trim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/') END || '/document.md' AS path FROM pages", path=lambda: U.output_path("data", F.col("url"), "md"))
mapped("u1_absolute", "pages", "page_id", r"SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS bare, 'https://' || regexp_replace(url, '^[a-z]+://', '') AS url FROM pages", bare=lambda: F.regexp_replace("url", "^[a-z]+://", ""), url=lambda: U.ensure_absolute(F.regexp_replace("url", "^[a-z]+://", "")))
mapped("k12_text_file_name", "pages", "page_id", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') || '-' || trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), '[^A-Za-z0-9._-]+', '-', 'g'), '-+$', '') || '.txt' AS name FROM pages", name=lambda: U.text_file_name(F.col("url")))

_LINKS = """SELECT page_id, url, unnest(l) AS href, unnest(range(len(l))) AS ord FROM (SELECT page_id, url, regexp_extract_all(html, '<a\\b[^>]*?\\shref=["'']([^"'']*)["''][^>]*>', 1, 'i') AS l FROM pages)"""


@query("x10_links", f"SELECT page_id, CAST(ord AS INTEGER) AS ord, href FROM ({_LINKS})")
def _links(spark: SparkSession, d: str) -> DataFrame:
    return pages.raw_links(table(spark, d, "pages")).select("page_id", "ord", "href")


@query("page_link_hosts_topk", f"""
WITH l AS ({_LINKS}), c AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, href, count(*) AS n FROM l GROUP BY ALL)
SELECT host, href, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, href) AS rank FROM c) WHERE rank <= 3""")
def _link_hosts(spark: SparkSession, d: str) -> DataFrame:
    links = pages.raw_links(table(spark, d, "pages")).groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "href").agg(F.count("*").alias("n"))
    return search.first_k(links, ["host"], [F.desc("n"), "href"], 3).select("host", "href", "n", "rank")


@query("u2_root_relative", f"SELECT page_id, CAST(ord AS INTEGER) AS ord, CASE WHEN href LIKE '/%' AND href NOT LIKE '//%' THEN regexp_extract(url, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) || replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%27', ''''), '%21', '!'), '%28', '('), '%29', ')'), '%2A', '*'), '%3A', ':'), '%40', '@'), '%26', '&'), '%3F', '?'), '%3D', '='), '%2B', '+'), '%24', '$'), '%3B', ';'), '%23', '#'), '%25', '%') END AS url FROM ({_LINKS})")
def _root_relative(spark: SparkSession, d: str) -> DataFrame:
    links = pages.raw_links(table(spark, d, "pages"))
    return links.select("page_id", "ord", U.resolve_root_relative(F.col("href"), F.col("url")).alias("url"))


_TOKENS = "SELECT page_id, unnest(l) AS token, CAST(unnest(range(len(l))) AS INTEGER) AS ord FROM (SELECT page_id, regexp_extract_all(html, '<[^>]+>') AS l FROM pages)"


@query("x21_tag_histogram", f"SELECT lower(regexp_extract(token, '^</?([a-zA-Z][A-Za-z0-9_-]*)', 1)) AS tag, starts_with(token, '</') AS closing, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL")
def _tags(spark: SparkSession, d: str) -> DataFrame:
    tags = pages.tag_tokens(table(spark, d, "pages")).select(F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][A-Za-z0-9_-]*)", 1)).alias("tag"), F.startswith("token", F.lit("</")).alias("closing"))
    return tags.groupBy("tag", "closing").agg(F.count("*").alias("n"))


@query("r6_indent_depth", f"""
WITH s AS (SELECT page_id, ord, CASE WHEN starts_with(token, '</') THEN -1 WHEN ends_with(token, '/>') OR lower(regexp_extract(token, '^</?([a-zA-Z][A-Za-z0-9_-]*)', 1)) IN ('', 'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr') THEN 0 ELSE 1 END AS step FROM ({_TOKENS})),
r AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY ord) AS total FROM s)
SELECT page_id, ord, CAST(total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY ord)) AS BIGINT) AS depth FROM r""")
def _depth(spark: SparkSession, d: str) -> DataFrame:
    return pages.indent_depths(table(spark, d, "pages")).select("page_id", "ord", F.col("depth").cast("long").alias("depth"))


@query("m2_page_markdown")
def _markdown(spark: SparkSession, d: str) -> DataFrame:
    made = pages.enhanced_markdown(table(spark, d, "pages"))
    return made.select("page_id", F.length("markdown").alias("n_chars"), F.regexp_count("markdown", F.lit(r"(?m)^#{1,6} ")).alias("n_headings"), F.sha2("markdown", 256).alias("digest"))


# The basic converter on pages built of all words of a text, whose Markdown has a closed form.
@query("m1_basic_markdown", f"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS w FROM documents)
SELECT doc_id, md5('# ' || source || CASE WHEN len(w) > 0 THEN chr(10) || chr(10) || array_to_string(w, ' ') || ' **' || w[1] || '**' || chr(10) || chr(10) || array_to_string(list_transform(w, lambda x: '-   ' || x), chr(10)) ELSE '' END) AS digest FROM w""")
def _basic(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", "source", F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    items = F.array_join(F.transform("w", lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "")
    bold = F.concat(F.lit(" <b>"), F.coalesce(F.get("w", F.lit(0)), F.lit("")), F.lit("</b></p><ul>"))
    html = F.concat(F.lit("<html><body><h1>"), "source", F.lit("</h1><p>"), F.array_join("w", " "), bold, items, F.lit("</ul></body></html>"))
    return pages.spread(w).select("doc_id", F.md5(pages.to_markdown(html, F.lit(None).cast("string"))).alias("digest"))


_TRIMMED = f"regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')"


@query("t4_pretty_html", f"""
WITH t AS (SELECT page_id, list_concat(regexp_extract_all(html, '<[^>]+>'), regexp_split_to_array(html, '<[^>]+>')) AS t FROM pages)
SELECT page_id, CAST(coalesce(list_sum(list_transform(list_filter(t, lambda x: {_TRIMMED} <> ''), lambda x: len(string_split({_TRIMMED}, chr(10))))), 0) AS INTEGER) AS n_lines FROM t""")
def _pretty(spark: SparkSession, d: str) -> DataFrame:
    return pages.spread(table(spark, d, "pages")).select("page_id", F.size(F.split(pages.pretty_html(h()), "\n")).alias("n_lines"))


# ---- text functions ---------------------------------------------------------------------

_UNICODE = "replace(replace(replace(replace(replace(replace(replace(replace(text, chr(160), '&nbsp;'), chr(8216), ''''), chr(8217), ''''), chr(8220), '\"'), chr(8221), '\"'), chr(8212), ' ' || chr(8212) || ' '), chr(8211), '-'), chr(8230), '...')"
mapped("p2_unicode", "documents", "doc_id", f"SELECT doc_id, md5({_UNICODE}) AS digest FROM documents", digest=lambda: F.md5(X.normalize_unicode(t())))
_TRIMMED = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _sql_chain(start: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        pattern = pattern.removeprefix("(?i)")
        for u in ("2000", "200F", "2028", "202F", "00A0", "2018", "2019", "201C", "201D", "00D7", "2192", "21A6", "2212"):
            pattern = pattern.replace(f"\\u{u}", f"\\x{{{u}}}")
        start = f"regexp_replace({start}, '{_rx(pattern)}', '{_rx(to.replace('$1', chr(92) + '1'))}', '{flags}')"
    return start


_SQUEEZED = f"regexp_replace({_TRIMMED}, '{SPACE}+', ' ', 'g')"
mapped("p7_compare_text", "documents", "doc_id", f"SELECT doc_id, md5(lower({_sql_chain(_SQUEEZED, X.COMPARE_STEPS)})) AS digest FROM documents", digest=lambda: F.md5(X.compare_text(t())))
mapped("p8_compare_code", "documents", "doc_id", f"SELECT doc_id, md5(lower({_sql_chain(_SQUEEZED, X.CODE_STEPS)})) AS digest FROM documents", digest=lambda: F.md5(X.compare_code(t())))
mapped("p9_semantic_text", "documents", "doc_id", f"SELECT doc_id, md5(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'), ' ')) AS digest FROM documents", digest=lambda: F.md5(X.semantic_text(t())))
mapped("p12_escape_html", "documents", "doc_id", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM documents", digest=lambda: F.md5(X.escape_html(t())))
_LINO = "replace(replace(replace(replace(replace({}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
mapped("p13_links_notation", "documents", "doc_id", f"SELECT doc_id, md5({_LINO.format('text')}) AS digest FROM documents", digest=lambda: F.md5(X.escape_links_notation(t())))
mapped("p14_table_cell", "documents", "doc_id", "SELECT doc_id, md5(replace(replace(text, '|', '\\|'), chr(10), '<br>')) AS digest FROM documents", digest=lambda: F.md5(X.escape_table_cell(t())))
mapped("p15_byte_size", "documents", "doc_id", "SELECT doc_id, CASE WHEN n_chars * 97 < 1024 THEN (n_chars * 97) || ' B' WHEN n_chars * 97 < 1048576 THEN printf('%.1f KB', floor(n_chars * 970 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars * 970 / 1048576.0 + 0.5) / 10) END AS size FROM documents", size=lambda: X.byte_size(F.col("n_chars") * 97))
mapped("p4_percent", "documents", "doc_id", "SELECT doc_id, '$' || (doc_id % 90) || '\\\\%$ of $' || (doc_id % 90) || '\\\\%$' AS fixed FROM documents", fixed=lambda: X.percent_in_formulas(F.concat(F.lit("$"), F.col("doc_id") % 90, F.lit("\\%$ of $"), F.col("doc_id") % 90, F.lit("\\text{%}$"))))
mapped("p3_formula_spacing", "documents", "doc_id", "SELECT doc_id, w || ' $' || doc_id || '$ ' || w AS fixed FROM (SELECT doc_id, lang AS w FROM documents)", fixed=lambda: X.space_formulas(F.concat("lang", F.lit("$ "), "doc_id", F.lit(" $"), "lang")))
mapped("p5_bold_spacing", "documents", "doc_id", "SELECT doc_id, lang || ' **' || source || '** ' || lang AS fixed FROM documents", fixed=lambda: X.space_bold(X.drop_empty_bold(F.concat("lang", F.lit("** "), "source", F.lit(" **"), "lang"))))
mapped("p6_tidy_spaces", "documents", "doc_id", "SELECT doc_id, lang || ' ' || source || '  ' || chr(10) || lang || ' ' || chr(8212) || ' ' || source AS tidy FROM documents", tidy=lambda: X.tidy_spaces(F.concat("lang", F.lit("   "), "source", F.lit("  \n"), "lang", F.lit("  \u2014   "), "source")))
mapped("m6_break_runs", "documents", "doc_id", "SELECT doc_id, md5(regexp_replace(replace(text, '.' || chr(10), '  ' || chr(10) || '  ' || chr(10)), '(?: {2,}\\n){2,}', chr(10) || chr(10), 'g')) AS digest FROM documents", digest=lambda: F.md5(X.break_runs(F.replace(t(), F.lit(".\n"), F.lit("  \n  \n")))))
mapped("m7_clean_markdown", "documents", "doc_id", f"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(10), repeat(chr(10), 3)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{SPACE}+|{SPACE}+$', '', 'g') || chr(10)) AS digest FROM documents", digest=lambda: F.md5(X.clean_markdown(F.replace(t(), F.lit("\n"), F.lit("\n\n\n")))))
mapped("m10_fence", "documents", "doc_id", "SELECT doc_id, CASE WHEN doc_id % 7 >= 3 THEN repeat('`', CAST(doc_id % 7 + 1 AS INTEGER)) ELSE '```' END AS fence FROM documents", fence=lambda: X.fence(F.concat("lang", F.expr("repeat('`', cast(doc_id % 7 as int))"), "lang")))
mapped("b5_retry_schedule", "documents", "doc_id", "SELECT doc_id, array_to_string(list_transform(range(0, doc_id % 9), lambda i: CAST(least(500 * (2 ** i), 30000) AS BIGINT)), ',') AS delays FROM documents", delays=lambda: F.array_join(F.transform(batch.retry_delays((F.col("doc_id") % 9).cast("int"), F.lit(500)), lambda x: x.cast("string")), ","))

# ---- URLs built from ids, valid forms and near misses ------------------------------------


def _case(n: int, *shapes: str) -> str:
    """The same CASE in both engines: ``{i}`` is the id."""
    quoted = ["'" + s.replace("{i}", "' || CAST(doc_id AS STRING) || '") + "'" for s in shapes]
    whens = " ".join(f"WHEN {k} THEN {q}" for k, q in enumerate(quoted[:-1]))
    return f"CASE doc_id % {n} {whens} ELSE {quoted[-1]} END"


_DRIVE = _case(6, "https://drive.google.com/file/d/f{i}_-x/view", "https://drive.google.com/open?id=o{i}", "https://drive.google.com/uc?id=u{i}&export=download", "https://drive.usercontent.google.com/download?id=d{i}", "https://drive.google.com/drive/folders/{i}", "https://example.com/file/d/{i}/view")
_PASTE = _case(6, "https://xpaste.pro/p/p{i}", "https://xpaste.pro/en/p/p{i}/raw", "https://xpaste.pro/ru/p/p{i}", "https://xpaste.pro/p/p{i}/other", "https://example.com/p/p{i}", "https://www.xpaste.pro/p/p{i}/raw")
_QUESTION = _case(4, "https://stackoverflow.com/questions/{i}/a-title", "https://www.stackoverflow.com/questions/{i}", "https://stackoverflow.com/tags/{i}", "https://example.com/questions/{i}")
_REPO = _case(5, "https://github.com/owner{i}/name", "https://www.github.com/owner{i}/name.git", "https://github.com/owner{i}", "https://github.com/owner{i}/name/tree", "https://example.com/owner{i}/name")
_DOCS = _case(3, "https://docs.google.com/document/d/D{i}/edit", "https://docs.google.com/spreadsheets/d/D{i}/edit", "http://docs.google.com/document/d/D{i}")
_SHARE = _case(4, "https://chatgpt.com/share/s{i}", "https://sub.chatgpt.com/share/s{i}/x", "https://share.google/aimode/s{i}", "https://example.com/share/s{i}")
_REDIRECT = _case(3, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fe.com%2F{i}&rut=1", "https://e.com/{i}", "//e.com/{i}")
_IMAGE = _case(6, "https://e.com/a{i}.PNG?x=1", "https://e.com/a{i}.jpeg", "https://e.com/a{i}.jpg#f", "https://e.com/a{i}.webp", "https://e.com/a{i}", "https://e.com/a.svg/b{i}.tiff")


def url_query(name: str, shapes: str, sql: str, /, **columns):
    @query(name, f"SELECT doc_id, {sql} FROM (SELECT doc_id, {shapes} AS u FROM documents)")
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "documents").select("doc_id", F.expr(shapes).alias("u"))
        return rows.select("doc_id", *[c(F.col("u")).alias(n) for n, c in columns.items()])

    return run


_by = lambda n, *xs: "CASE doc_id % " + str(n) + " " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END"
url_query("u3_drive_id", _DRIVE, f"{_by(6, chr(39) + 'f' + chr(39) + ' || doc_id || ' + chr(39) + '_-x' + chr(39), chr(39) + 'o' + chr(39) + ' || doc_id', chr(39) + 'u' + chr(39) + ' || doc_id', chr(39) + 'd' + chr(39) + ' || doc_id')} AS id", id=U.drive_file_id)
url_query("u4_drive_download", _DRIVE, "CASE WHEN doc_id % 6 < 4 THEN true ELSE false END AS drive", drive=lambda u: U.drive_download_url(u).isNotNull())
url_query("u7_question_id", _QUESTION, "CASE WHEN doc_id % 4 < 2 THEN CAST(doc_id AS VARCHAR) END AS id", id=U.question_id)
url_query("u8_question_print", _QUESTION, "CASE WHEN doc_id % 4 < 2 THEN 'https://www.stackprinter.com/export?question=' || doc_id || '&format=HTML&language=en&printer=false&service=stackoverflow&width=640' END AS url", url=U.question_print_url)
url_query("u10_paste", _PASTE, "CASE WHEN doc_id % 6 IN (0, 1, 2, 5) THEN 'p' || doc_id END AS id, CASE WHEN doc_id % 6 IN (0, 1, 2, 5) THEN 'https://xpaste.pro/p/p' || doc_id || '/raw' END AS raw", id=U.paste_id, raw=U.paste_raw_url)
url_query("u12_repository", _REPO, "CASE WHEN doc_id % 5 < 2 THEN 'owner' || doc_id || '/name' END AS repo", repo=U.repository)
url_query("u13_document", _DOCS, "doc_id % 3 <> 1 AS is_document, CASE WHEN doc_id % 3 <> 1 THEN 'https://docs.google.com/document/d/D' || doc_id || '/export?format=md' END AS export", is_document=U.is_document_url, export=lambda u: U.document_export_url(U.document_id(u), "md"))
url_query("u14_capture_method", _case(4, "browser", "api", "api", "other"), "CASE doc_id % 4 WHEN 0 THEN 'browser-model' WHEN 1 THEN 'docs-api' WHEN 2 THEN 'public-export' END AS method", method=lambda u: U.capture_method(u, F.when(F.col("doc_id") % 4 == 1, "token")))
url_query("u15_image_extension", _IMAGE, "CASE doc_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpg' WHEN 3 THEN '.webp' ELSE '.png' END AS ext, CASE doc_id % 6 WHEN 1 THEN '.jpeg' WHEN 2 THEN '.jpg' WHEN 3 THEN '.webp' ELSE '.png' END AS kept", ext=U.image_extension, kept=lambda u: U.image_extension(u, keep_jpeg=True))
url_query("u16_mime_type", _case(4, "a{i}.PNG", "a.b.jpeg", "x.md", "none"), "CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime", mime=U.mime_type)
url_query("u18_redirect", _REDIRECT, "'https://e.com/' || doc_id AS url", url=U.redirect_target)
url_query("u19_unwrap", _case(2, "https://www.google.com/url?q=https%3A%2F%2Fe.com%2F{i}&sa=D", "https://e.com/{i}"), "'https://e.com/' || doc_id AS url", url=U.unwrapped)
url_query("u20_dialog_provider", _SHARE, "CASE doc_id % 4 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'chatgpt' WHEN 2 THEN 'google_ai_mode' END AS provider", provider=U.dialog_provider)
url_query("u21_share_id", _SHARE, "CASE WHEN doc_id % 4 <> 2 THEN 's' || doc_id END AS id", id=U.share_id)
url_query("u22_browser_engine", _case(4, "pw", "Playwright", "pptr", "unknown"), "CASE WHEN doc_id % 4 < 2 THEN 'playwright' ELSE 'puppeteer' END AS engine", engine=lambda u: U.browser_engine(u))
url_query("u6_image_type", _case(4, "image/png; charset=x", "IMAGE/JPEG", "text/html", "image/unknown"), "doc_id % 4 <> 2 AS image, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'bin' END AS ext", image=U.is_image_type, ext=U.image_type_extension)
url_query("k5_archive_extension", _case(4, "zip", "7z", "tar.gz", "tar"), "CASE doc_id % 4 WHEN 1 THEN '.7z' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.tar' ELSE '.zip' END AS ext", ext=U.archive_extension)
url_query("s5_error_kind", _case(4, "AbortError", "TimeoutError", "TypeError", "Other"), "CASE doc_id % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'timeout' WHEN 2 THEN 'cors_or_transport' ELSE 'transport' END AS kind", kind=lambda u: P.error_kind(u))
url_query("k9_image_quality", _case(3, "-5", "55", "500"), "CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 55 ELSE 100 END AS quality", quality=lambda u: P.image_quality(u.cast("int")))


@query("u17_search_url", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://en.wikipedia.org/w/rest.php/v1/search/page?q=' || q || '&limit=7' WHEN 1 THEN 'https://html.duckduckgo.com/html/?q=' || q WHEN 2 THEN 'https://www.google.com/search?q=' || q || '&num=7' WHEN 3 THEN 'https://www.bing.com/search?q=' || q || '&count=7' ELSE 'https://search.brave.com/search?q=' || q END AS url
FROM (SELECT doc_id, replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS q FROM documents)""")
def _search_url(spark: SparkSession, d: str) -> DataFrame:
    provider = F.element_at(F.lit(list(U.PROVIDERS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", U.search_url(provider, F.col("text"), 7).alias("url"))


@query("s4_receipt_headers", "SELECT doc_id, 'content-type=text/' || lang || ',etag=' || source AS kept FROM documents")
def _receipt_headers(spark: SparkSession, d: str) -> DataFrame:
    made = F.create_map(F.lit("content-type"), F.concat(F.lit("text/"), "lang"), F.lit("x-other"), F.lit("1"), F.lit("etag"), F.col("source"), F.lit("connection"), F.lit("close"))
    return table(spark, d, "documents").select("doc_id", _entries(P.receipt_headers(made)).alias("kept"))


def _entries(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("s9_proxy_headers", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'content-length=5,' ELSE '' END || 'content-type=t,etag=' || source AS kept FROM documents")
def _proxy_headers(spark: SparkSession, d: str) -> DataFrame:
    fixed = F.create_map(*[F.lit(x) for kv in {"content-type": "t", "connection": "close, X-Drop", "x-drop": "1", "te": "x", "content-length": "5"}.items() for x in kv], F.lit("etag"), F.col("source"))
    encoded = F.when(F.col("doc_id") % 2 == 1, F.map_concat(fixed, F.create_map(F.lit("content-encoding"), F.lit("gzip")))).otherwise(fixed)
    return table(spark, d, "documents").select("doc_id", _entries(P.proxy_headers(encoded, keep_length=True)).alias("kept"))


# ---- images -------------------------------------------------------------------------------

def _md() -> Column:
    return F.concat(F.lit("a ![one "), "page_id", F.lit("](https://e.com/"), "page_id", F.lit('.png "t") b ![](https://e.com/x.jpeg) c ![two]('), F.lit("data:image/png;base64,"), F.base64(F.col("url").cast("binary")), F.lit(") d ![](data:image/jpeg;base64,QUJD)"))


def _md_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.regexp_replace(_md(), "[\r\n]", "").alias("markdown"))


@query("x4_image_references", "SELECT page_id, 0 AS ord, 'one ' || page_id AS alt_text, 'https://e.com/' || page_id || '.png' AS url FROM pages UNION ALL SELECT page_id, 1, '', 'https://e.com/x.jpeg' FROM pages")
def _references(spark: SparkSession, d: str) -> DataFrame:
    return images.references(_md_pages(spark, d), "page_id").select("page_id", "ord", "alt_text", "url")


@query("i1_strip_images", """SELECT page_id, 'a ![one ' || page_id || '](https://e.com/' || page_id || '.png "t") b ![](https://e.com/x.jpeg) c *[image: two]* d ![]()' AS markdown, 2 AS n FROM pages""")
def _strip(spark: SparkSession, d: str) -> DataFrame:
    return _md_pages(spark, d).select("page_id", images.strip_embedded(F.col("markdown")).alias("markdown"), images.count_embedded(F.col("markdown")).alias("n"))


@query("x20_image_hash_names", "SELECT page_id, 'image-' || sha256(url)[1:8] || '.png' AS name FROM pages UNION ALL SELECT page_id, 'image-' || sha256('ABC')[1:8] || '.jpg' FROM pages")
def _hash_names(spark: SparkSession, d: str) -> DataFrame:
    return images.embedded(_md_pages(spark, d), "page_id").select("page_id", "name")


@query("i2_extract_images", """SELECT page_id, 'a ![one ' || page_id || '](https://e.com/' || page_id || '.png "t") b ![](https://e.com/x.jpeg) c ![two](images/image-' || sha256(url)[1:8] || '.png) d ![](images/image-' || sha256('ABC')[1:8] || '.jpg)' AS markdown FROM pages""")
def _extract(spark: SparkSession, d: str) -> DataFrame:
    return _md_pages(spark, d).select("page_id", images.apply_mode(F.col("markdown"), "extract").alias("markdown"))


@query("r3_number_images", "SELECT page_id, 1 AS n, 'images/image-01.png' AS local FROM pages UNION ALL SELECT page_id, 2, 'images/image-02.jpeg' FROM pages")
def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return images.numbered(images.references(_md_pages(spark, d), "page_id"), "page_id").select("page_id", "n", "local")


@query("i7_localise", "SELECT page_id, page_id % 2 = 0 AS first_local FROM pages")
def _localise(spark: SparkSession, d: str) -> DataFrame:
    made = _md_pages(spark, d)
    receipts = made.where("page_id % 2 = 0").select(F.concat(F.lit("https://e.com/"), "page_id", F.lit(".png")).alias("url"), F.lit("x").cast("binary").alias("body"), F.lit(200).alias("status"))
    out, _ = images.localise(made, "page_id", receipts)
    return out.select("page_id", F.contains("markdown", F.lit("(images/image-01.png")).alias("first_local"))


@query("r4_excluded_hosts", """
WITH e AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS domain FROM pages WHERE page_id % 40 = 0)
SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM e WHERE lower(regexp_extract(p.url, '^[a-z]+://([^/?#:]+)', 1)) = domain OR ends_with(lower(regexp_extract(p.url, '^[a-z]+://([^/?#:]+)', 1)), '.' || domain))""")
def _excluded(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "pages").select("page_id", "url")
    domains = refs.where("page_id % 40 = 0").select(U.host(F.col("url")).alias("domain"))
    return images.localisable(refs, domains)


@query("r4c_known_images", "SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE length(html) % 2 = 0)")
def _known(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "pages").select("page_id", "url")
    return images.present_in(refs, table(spark, d, "pages").where(F.length("html") % 2 == 0).select("url")).select("page_id", "url")


@query("i4_plan_images", """SELECT doc_id, md5('![' || lang || '](images/image-01.png) ' || t || ' ![](images/image-02.jpg)![x](images/image-03.png)') AS digest,
  array_to_string(['https://h/' || doc_id || '.png image-01.png', 'https://h/' || source || '.jpg image-02.jpg', 'https://h/' || doc_id || '.png image-03.png'], ',') AS pending
FROM (SELECT *, replace(text, '!', '') AS t FROM documents)""")
def _plan_images(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("t", F.replace("text", F.lit("!"), F.lit("")))
    png = F.concat(F.lit("](https://h/"), "doc_id", F.lit(".png)"))
    made = docs.withColumn("markdown", F.concat(F.lit("!["), "lang", png, F.lit(" "), "t", F.lit(" ![](https://h/"), "source", F.lit('.jpg "t")![x'), png))
    out = images.plan_every(made, "doc_id")
    return out.select("doc_id", F.md5("markdown").alias("digest"), F.array_join(F.transform("pending", lambda x: F.concat(x["url"], F.lit(" "), x["filename"])), ",").alias("pending"))


@query("t19_embedded_html", """SELECT page_id, 0 AS ord, 'image-01.png' AS filename, 'image/png' AS mime_type, sha256(html) AS digest FROM pages
UNION ALL SELECT page_id, 1, 'image-02.jpg', 'image/jpeg', sha256(url) FROM pages""")
def _embedded_html(spark: SparkSession, d: str) -> DataFrame:
    data = lambda c: F.base64(F.col(c).cast("binary"))
    html = F.concat(F.lit('<p><img alt=a src="data:image/png;base64,'), data("html"), F.lit('">x<img src="data:image/jpeg;base64,'), data("url"), F.lit('"></p>'))
    _, rows = images.embedded_in_html(table(spark, d, "pages").select("page_id", html.alias("html")), "page_id")
    return rows.select("page_id", "ord", "filename", "mime_type", F.sha2("bytes", 256).alias("digest"))


@query("x3_figure_rows", """
WITH f AS (SELECT page_id, CAST(page_id % 50 AS INTEGER) AS figure_num, url || CASE page_id % 3 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.png' ELSE '' END AS src, length(html) AS n FROM pages),
r AS (SELECT src, CASE WHEN min(n) % 5 = 0 THEN 404 ELSE 200 END AS status FROM f WHERE n % 2 = 0 GROUP BY src)
SELECT f.page_id, f.figure_num, 'figure-' || f.figure_num || CASE WHEN contains(f.src, '.jpeg') OR contains(f.src, '.jpg') THEN '.jpg' ELSE '.png' END AS filename, f.src AS original_url,
  CASE WHEN r.src IS NULL THEN 'not fetched' WHEN r.status = 404 THEN 'HTTP 404' END AS error FROM f LEFT JOIN r ON f.src = r.src""")
def _figure_rows(spark: SparkSession, d: str) -> DataFrame:
    src = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".jpeg").when(F.col("page_id") % 3 == 1, ".png").otherwise(""))
    figures = table(spark, d, "pages").select("page_id", (F.col("page_id") % 50).cast("int").alias("figure_num"), src.alias("src"), F.lit(None).cast("string").alias("caption"), F.length("html").alias("n"))
    got = figures.where("n % 2 = 0").groupBy(F.col("src").alias("url")).agg(F.min("n").alias("n")).select("url", F.when(F.col("n") % 5 == 0, 404).otherwise(200).alias("status"), F.lit("x").cast("binary").alias("body"))
    return pages.figure_rows(figures, "page_id", got).select("page_id", "figure_num", "filename", "original_url", "error")


_HREF = "nullif(regexp_extract(tag, '\\bhref\\s*=\\s*{}', 1, 'i'), '')"
_HREFS = ", ".join(_HREF.format(x) for x in ('"([^"]*)"', "\\x27([^\\x27]*)\\x27", "([^\\s\"\\x27=<>`]+)"))


@query("t17_attribute", f"""SELECT page_id, nullif(trim(replace(replace(replace(replace(coalesce({_HREFS}), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')), '') AS href
FROM (SELECT page_id, regexp_extract(html, '<a\\s[^>]*>', 0, 'i') AS tag FROM pages)""")
def _attribute(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.attribute(F.regexp_extract("html", r"(?i)<a\s[^>]*>", 0), "href").alias("href"))


mapped("t16_empty_titles", "pages", "page_id", """SELECT page_id, md5('<img src="' || url || '">' || regexp_replace(html, '\\stitle\\s*=', ' name=', 'gi') || '<IMG alt="x">') AS digest FROM pages""",
       digest=lambda: F.md5(X.strip_empty_titles(F.concat(F.lit('<img src="'), "url", F.lit('" title="">'), F.regexp_replace("html", r"(?i)\stitle\s*=", " name="), F.lit("<IMG alt=\"x\"  title = ''>")))))


def _chunks() -> Column:
    return F.split(t(), " ")


mapped("c7_model_fingerprint", "documents", "doc_id", "SELECT doc_id, CAST(len(l) AS INTEGER) AS chunks, CAST(list_sum(list_transform(l, lambda x: strlen(x))) AS BIGINT) AS payload_bytes, len(l) % 2 = 0 AS same FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)",
       chunks=lambda: richdoc.model_fingerprint(_chunks())["chunks"], payload_bytes=lambda: richdoc.model_fingerprint(_chunks())["payload_bytes"],
       same=lambda: richdoc.same_fingerprint(richdoc.model_fingerprint(_chunks()), richdoc.model_fingerprint(F.when(F.size(_chunks()) % 2 == 0, _chunks()))))


@query("a4_animation_options", """SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE 'Invalid `format`: must be "gif" or "png-sequence"' END AS error,
  CASE WHEN n_chars % 4 = 0 THEN 1024 ELSE n_chars END AS "maxSize", CASE WHEN n_chars % 3 = 0 THEN 0.99 ELSE (n_chars % 100 + 1) / 100.0 END AS similarity, 120 AS "minFrames" FROM documents WHERE lang IS NOT NULL""")
def _animation_options(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "documents").where("lang is not null").select(
        "doc_id",
        F.when(F.col("lang") == "en", "GIF").otherwise(F.col("lang")).alias("format"),
        F.when(F.col("n_chars") % 4 == 0, "0").otherwise(F.concat("n_chars", F.lit("px"))).alias("maxSize"),
        F.when(F.col("n_chars") % 3 != 0, F.concat(((F.col("n_chars") % 100 + 1) / 100).cast("string"), F.lit(" of 1"))).alias("similarity"),
    )
    return batch.animation_options(asked).select("doc_id", "error", F.col("maxSize").cast("long").alias("maxSize"), "similarity", "minFrames")


@query("m14_header_footer", """SELECT doc_id, array_to_string(list_filter(['**Author:** ' || CASE WHEN n_chars % 2 = 0 THEN '[' || source || '](u/' || doc_id || ')' ELSE source END,
    CASE WHEN n_chars % 3 = 0 THEN '**Type:** Translation' END, '**Views: ' || n_chars || '**', '**Tags:** ' || coalesce(lang || ', ', '') || source], lambda x: x IS NOT NULL), chr(10)) AS header,
  '---' || chr(10) || chr(10) || '**Tags:** [' || source || '](t)' || chr(10) || chr(10) || '**Votes: ' || doc_id || ' | Views: ' || n_chars || '**' || chr(10) || chr(10)
    || '**Author:** ' || CASE WHEN n_chars % 2 = 0 THEN '[' || source || '](u/' || doc_id || ')' ELSE source END || chr(10) AS footer
FROM documents""")
def _header_footer(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    known = {
        "author": F.col("source"), "author_url": F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("u/"), "doc_id")), "views": text("n_chars"), "votes": text("doc_id"),
        "is_translation": F.col("n_chars") % 3 == 0, "tags": F.array_compact(F.array("lang", "source")), "tag_links": F.array(F.struct(F.col("source").alias("name"), F.lit("t").alias("url"))),
    }
    fields = T.StructType.fromDDL(pages.METADATA).fields
    made = table(spark, d, "documents").select("doc_id", F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).alias("metadata"))
    return made.select("doc_id", F.array_join(pages.metadata_header(), "\n").alias("header"), F.array_join(pages.metadata_footer(), "\n").alias("footer"))


@query("s1_routes", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'drive_image' WHEN 1 THEN 'question' ELSE 'page' END AS route,
  CASE doc_id % 3 WHEN 0 THEN 'https://drive.usercontent.google.com/download?id=' || sha256(text)[1:30] || '&export=view&authuser=0'
    WHEN 1 THEN 'https://www.stackprinter.com/export?question=' || n_chars || '&format=HTML&language=en&printer=false&service=stackoverflow&width=640' ELSE 'https://e.com/' || n_chars END AS fetch_url FROM documents""")
def _routes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    drive = F.concat(F.lit("https://drive.google.com/file/d/"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 30), F.lit("/view"))
    url = F.when(kind == 0, drive).when(kind == 1, F.concat(F.lit("https://stackoverflow.com/questions/"), "n_chars", F.lit("/a-title"))).otherwise(F.concat(F.lit("https://e.com/"), "n_chars"))
    return receipts.routed(table(spark, d, "documents").select("doc_id", url.alias("url"))).select("doc_id", "route", "fetch_url")


@query("s6_decoded_text", "SELECT page_id, md5(html) AS digest FROM pages WHERE page_id % 4 <> 3")
def _decoded(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("page_id") % 4
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode("html", "UTF-16BE"))
    made = table(spark, d, "pages").select(
        "page_id",
        F.create_map(F.lit("content-type"), F.when(kind == 1, "text/html; charset=utf-16").when(kind == 3, "image/png").otherwise("Text/HTML")).alias("headers"),
        F.when(kind == 1, wide).otherwise(F.col("html").cast("binary")).alias("body"),
    )
    return receipts.text_only(made).select("page_id", F.md5("text").alias("digest"))


@query("m3_tables", """SELECT doc_id, CAST(1 + len(w) AS INTEGER) AS n_rows, md5('| n | word |' || chr(10) || '| --- | --- |' || array_to_string(list_transform(w, lambda x, i: chr(10) || '| ' || i || ' | ' || x || ' |'), '')) AS digest
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM documents)""")
def _tables(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda x, i: F.concat(F.lit("<tr><td>"), (i + 1).cast("string"), F.lit("<td>"), x))
    html = F.concat(F.lit("<table><tr><th>n<th>word"), F.array_join(rows, ""), F.lit("</table>"))
    made = pages.parse_pages(table(spark, d, "documents").select("doc_id", html.alias("html"), F.lit(None).cast("string").alias("url")), ("tables",))
    return made.select("doc_id", F.get("page.tables", F.lit(0)).alias("t")).select("doc_id", "t.n_rows", F.md5("t.markdown").alias("digest"))


@query("k4_archive_entries", """
SELECT page_id, 'document.html' AS path FROM pages UNION ALL SELECT page_id, 'images/image-1.jpg' FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'images/image-2.png' FROM pages UNION ALL SELECT page_id, 'css/style-1.css' FROM pages WHERE page_id % 2 = 0""")
def _archive_entries(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit('<link rel="stylesheet" href="/'), "page_id", F.lit('.css"><img src="'), "page_id", F.lit('.jpeg?x"><img src="k"><img src="/d/'), "page_id", F.lit('.jpeg?x">'))
    rows = table(spark, d, "pages").select("page_id", F.lit("https://h.org/d/").alias("url"), html.alias("html"))
    own = F.array(F.concat(F.lit("https://h.org/"), "page_id", F.lit(".css")), F.concat(F.lit("https://h.org/d/"), "page_id", F.lit(".jpeg?x")))
    got = rows.where("page_id % 2 = 0").select(F.explode(own).alias("url")).unionByName(spark.range(1).select(F.lit("https://h.org/d/k").alias("url")))
    bodies = got.select("url", F.lit(200).alias("status"), F.lit("x").cast("binary").alias("body"))
    return archive.archive_entries(rows, "page_id", bodies, document="html").select("page_id", "path")


# ---- operators on inputs that vary with the row --------------------------------------------------

_PLAIN = "regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')"


def _plain() -> Column:
    return F.regexp_replace("text", "[^A-Za-z0-9]+", " ")


mapped("t1_absolutise", "documents", "doc_id", f"""SELECT doc_id, md5('<a href="https://h' || doc_id % 7 || '.org/x/' || doc_id || '">' || {_PLAIN} || '</a><img src="https://h' || doc_id % 7 || '.org/a/' || source || '.png"><!-- <a href="https://h' || doc_id % 7 || '.org/a/b"> --><i style="background:url("https://h' || doc_id % 7 || '.org/k")">') AS digest FROM documents""",
       digest=lambda: F.md5(pages.absolute_html(F.concat(F.lit('<a href="/x/'), "doc_id", F.lit('">'), _plain(), F.lit('</a><img src="'), "source", F.lit('.png"><!-- <a href="b"> --><i style="background:url(/k)">')), F.concat(F.lit("https://h"), F.col("doc_id") % 7, F.lit(".org/a/p?q")))))


@query("t5_page_rewrites", f"""
SELECT doc_id, md5('### ' || source || chr(10) || chr(10) || trim({_PLAIN}) || CASE WHEN trim({_PLAIN}) = '' THEN '' ELSE chr(10) || chr(10) END
  || array_to_string(list_transform(range(1, CAST(doc_id % 4 + 2 AS BIGINT)), lambda i: i || '.  a' || i), chr(10)) || chr(10) || chr(10) || 'between' || chr(10) || chr(10)
  || (doc_id % 4 + 2) || '.  last' || chr(10) || chr(10) || '**' || (doc_id % 9 + 1) || '.' || doc_id || ' part**' || chr(10) || chr(10) || 'by $x^' || doc_id || '$ so') AS digest FROM documents""")
def _rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Empty headings and links go, lists count on, numbered headings are bold, formulas are LaTeX, scripts go."""
    items = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("<li>a"), i.cast("string"))), "")
    html = F.concat(
        F.lit("<h2> </h2><h3>"), "source", F.lit('</h3><p onclick="x()">'), _plain(), F.lit('<a href="u"> </a></p><script>no</script><ol>'), items, F.lit("</ol><p>between</p><ol><li>last</ol><h4>"),
        F.col("doc_id") % 9 + 1, F.lit("."), "doc_id", F.lit(' part</h4><p>by <img class="formula" source="x^'), "doc_id", F.lit('"> so</p>'),
    )
    made = pages.parse_pages(table(spark, d, "documents").select("doc_id", html.alias("html"), F.lit(None).cast("string").alias("url")), ("markdown",), clean=False)
    return made.select("doc_id", F.md5("page.markdown").alias("digest"))


@query("x1_article", f"""
SELECT doc_id, source AS author, '/u/' || source AS author_url, CASE WHEN doc_id % 2 = 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS publish_date, trim({_PLAIN}) AS reading_time,
  'h' || doc_id % 3 || ',h' || doc_id % 5 AS hubs, lang || ',' || source AS tags, 'n' || doc_id AS author_full_name, CAST(doc_id % 6 AS INTEGER) AS figure_num, 'https://e.org/p/' || doc_id || '.png' AS src
FROM documents WHERE lang IS NOT NULL""")
def _article(spark: SparkSession, d: str) -> DataFrame:
    when = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<time datetime="2024-01-'), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit('">x</time>'))).otherwise("<time>x</time>")
    html = F.concat(
        F.lit('<html><head><meta name="keywords" content="'), "lang", F.lit(" ,"), "source", F.lit('"><script type="application/ld+json">{"author":{"name":"n'), "doc_id", F.lit('"}}</script></head><a class="x tm-user-info__username" href="/u/'),
        "source", F.lit('"> '), "source", F.lit("</a>"), when, F.lit('<span class="tm-article-reading-time__label">'), _plain(), F.lit('</span><a class="tm-publication-hub__link"><span>h'),
        F.col("doc_id") % 3, F.lit('</span></a><a class="tm-publication-hub__link">h'), F.col("doc_id") % 5, F.lit(' * </a><figure><img src="/i.svg"></figure><figure><img src="p/'), "doc_id", F.lit('.png"><figcaption>Figure '), F.col("doc_id") % 6, F.lit(". c</figcaption></figure></html>"),
    )
    made = table(spark, d, "documents").where("lang is not null").select("doc_id", html.alias("html"), F.lit("https://e.org/a").alias("url"))
    page = pages.parse_pages(made, ("metadata", "figures")).select("doc_id", F.col("page.metadata").alias("m"), F.get("page.figures", F.lit(0)).alias("f"))
    names = ["author", "author_url", "publish_date", "reading_time"]
    return page.select("doc_id", *[F.col(f"m.{x}").alias(x) for x in names], F.array_join("m.hubs", ",").alias("hubs"), F.array_join("m.tags", ",").alias("tags"), "m.author_full_name", "f.figure_num", "f.src")


@query("x13_streamed_chat", """
SELECT doc_id, role, md5(trim(content, ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM (SELECT doc_id, 'user' AS role, text AS content FROM documents UNION ALL SELECT doc_id, 'assistant', 'of ' || source FROM documents)
WHERE trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def _streamed(spark: SparkSession, d: str) -> DataFrame:
    said = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.substring(said(c), F.lit(2), F.length(said(c)) - 2)
    turns = '[{"_1":2},"linear_conversation",[3,9],{"_4":5},"message",{"_6":7,"_8":12},"author",{"_10":11},"content",{"_4":13},"role","user",{"_14":15},{"_6":16,"_8":17},"parts",[18],{"_10":19},{"_14":20},'
    stream = F.concat(F.lit(turns), inner(F.col("text")), F.lit(',"assistant",[21],'), inner(F.concat(F.lit("of "), "source")), F.lit("]"))
    html = F.concat(F.lit(f"<p>x<script>{P.ENQUEUE}"), inner(stream), F.lit(")</script>"))
    chats = pages.spread(table(spark, d, "documents").select("doc_id", html.alias("html"))).select("doc_id", F.explode(dialog.parse_chat(F.col("html"))["turns"]).alias("t"))
    return chats.select("doc_id", "t.role", F.md5("t.content").alias("digest"))


@query("q6_searches", """
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 + CAST(doc_id % 3 AS INTEGER) END AS n_results, CASE WHEN n_chars % 3 = 0 THEN 'no response' END AS error, n_chars % 5 = 0 AND n_chars % 3 <> 0 AS captcha FROM documents""")
def _searches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.concat(F.lit("q "), "doc_id").alias("query"), F.lit("bing").alias("provider"))
    item = F.concat(F.lit('<li class="b_algo"><h2><a href="https://e.com/'), "doc_id", F.lit('">T</a></h2><p>s</p>'))
    body = F.concat(F.repeat(item, (F.col("doc_id") % 3 + 1).cast("int")), F.when(F.col("n_chars") % 5 == 0, "<b>unusual traffic</b>").otherwise(""))
    got = docs.where("n_chars % 3 <> 0").select(U.search_url(F.col("provider"), F.col("query"), 10).alias("url"), F.lit(200).alias("status"), body.alias("body"), *[F.lit(None).cast("string").alias(x) for x in ("error", "error_kind")])
    found = search.run_searches(docs.select("query", "provider"), got)
    number = F.substring_index("query", " ", -1).cast("long").alias("doc_id")
    return found.select(number, F.size("results").alias("n_results"), "diagnostics.error", F.coalesce("diagnostics.blocked_by_captcha", F.lit(False)).alias("captcha"))


# ---- documents: lines, samples, verification ------------------------------------------------

_LINES = "SELECT doc_id, unnest(l) AS line, CAST(unnest(range(len(l))) AS INTEGER) AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


@query("r10_head_tail_sample", f"WITH l AS ({_LINES}) SELECT doc_id, ord FROM (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM l) WHERE k <= 5 UNION ALL SELECT doc_id, ord FROM (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS k FROM l) WHERE k <= 5")
def _ends(spark: SparkSession, d: str) -> DataFrame:
    return verify.sample_ends(_lines(spark, d), "doc_id").select("doc_id", "ord")


@query("r7_prev_next_line", f"WITH l AS ({_LINES}) SELECT doc_id, ord, coalesce(last_value(CASE WHEN trim(line) <> '' THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS previous, coalesce(first_value(CASE WHEN trim(line) <> '' THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next FROM l")
def _prev_next(spark: SparkSession, d: str) -> DataFrame:
    out = relational.neighbours(_lines(spark, d).withColumn("at", F.col("ord")), "doc_id", "ord", "at", F.trim("line") == "")
    return out.select("doc_id", "ord", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("next", F.lit(-1)).alias("next"))


@query("r14_islands", f"WITH l AS (SELECT doc_id, ord, length(line) > 200 AS long FROM ({_LINES})), f AS (SELECT *, CASE WHEN lag(long) OVER (PARTITION BY doc_id ORDER BY ord) IS NOT DISTINCT FROM long AND row_number() OVER (PARTITION BY doc_id ORDER BY ord) > 1 THEN 0 ELSE 1 END AS fresh FROM l) SELECT doc_id, ord, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS island FROM f")
def _islands(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select("doc_id", "ord", (F.length("line") > 200).alias("long"))
    return relational.islands(rows, "doc_id", "ord", "long").select("doc_id", "ord", "island")


@query("r4d_contains_benchmark", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def _contains(spark: SparkSession, d: str) -> DataFrame:
    return verify.containing(table(spark, d, "documents"), table(spark, d, "benchmark"))


_EXPECTED = f"SELECT doc_id, CASE WHEN ord = 0 THEN 'title' WHEN ord % 3 = 1 THEN 'paragraph' ELSE 'list_item' END AS kind, ord, line AS text FROM ({_LINES})"
_NORM = lambda c: f"lower({_sql_chain(f'regexp_replace(regexp_replace({c}, {chr(39)}^{SPACE}+|{SPACE}+${chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)}), {chr(39)}{SPACE}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})', X.COMPARE_STEPS)})"


@query("v1_verify", f"""
WITH e AS ({_EXPECTED}),
s AS (
  SELECT doc_id, kind, text FROM e WHERE kind = 'title'
  UNION ALL SELECT doc_id, kind, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM e WHERE kind = 'paragraph') WHERE k <= 5
  UNION ALL SELECT doc_id, kind, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS k FROM e WHERE kind = 'paragraph') WHERE k <= 5
  UNION ALL SELECT doc_id, kind, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM e WHERE kind = 'list_item') WHERE k <= 10),
m AS (SELECT doc_id, {_NORM("substring(text, 1, length(text) * 3 // 4)")} AS hay FROM documents),
n AS (SELECT s.doc_id, kind, {_NORM("s.text")} AS needle, hay FROM s JOIN m USING (doc_id)),
w AS (SELECT *, list_filter(string_split(needle, ' '), lambda x: length(x) > 2) AS words FROM n),
f AS (SELECT doc_id, CASE WHEN kind = 'title' THEN contains(hay, needle)
  ELSE (len(words) > 0 AND len(list_filter(words, lambda x: contains(hay, x))) >= 0.6 * len(words))
    OR (length(needle) > CASE kind WHEN 'paragraph' THEN 20 ELSE 15 END AND contains(hay, substring(needle, 1, CASE kind WHEN 'paragraph' THEN 50 ELSE 40 END))) END AS ok FROM w)
SELECT doc_id, CAST(count(*) AS BIGINT) AS total_checks, CAST(count(*) FILTER (ok) AS BIGINT) AS passed_checks,
  count(*) FILTER (ok) = count(*) OR count(*) FILTER (ok) / count(*) >= 0.85 AS success FROM f GROUP BY doc_id""")
def _verify(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("ord") == 0, "title").when(F.col("ord") % 3 == 1, "paragraph").otherwise("list_item")
    expected = _lines(spark, d).select("doc_id", kind.alias("kind"), "ord", F.col("line").alias("text"))
    docs = table(spark, d, "documents").select("doc_id", F.expr("substring(text, 1, cast(length(text) * 3 / 4 as int))").alias("markdown"))
    return verify.verify(docs, expected).select("doc_id", F.col("total_checks").cast("long").alias("total_checks"), F.col("passed_checks").cast("long").alias("passed_checks"), "success")


# ---- search -------------------------------------------------------------------------------


@query("q1_json_results", "SELECT doc_id, CAST(r AS INTEGER) AS rank, 'Title ' || doc_id || '-' || r AS title, 'https://en.wikipedia.org/wiki/key' || r AS url, 'found ' || lang AS snippet FROM documents, range(1, 4) x(r)")
def _json_results(spark: SparkSession, d: str) -> DataFrame:
    page = lambda k: F.concat(F.lit(f'{{"key":"key{k}","title":"Title '), "doc_id", F.lit(f'-{k}","excerpt":"<b>found</b>  '), "lang", F.lit('"}'))
    body = F.concat(F.lit('{"pages":['), F.concat_ws(",", *[page(k) for k in (1, 2, 3, 4)]), F.lit("]}"))
    return table(spark, d, "documents").select("doc_id", F.explode(search.json_results(body, 3)).alias("r")).select("doc_id", "r.*")


@query("q8_first_k", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def _first_k(spark: SparkSession, d: str) -> DataFrame:
    return search.first_k(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), "doc_id"], 5).select("source", "doc_id", "rank")


@query("m11_results_markdown", "SELECT doc_id, '# Search results: ' || lang || chr(10) || chr(10) || 'Provider: x' || chr(10) || chr(10) || '1. [' || source || '](u)' || chr(10) || '   s' || chr(10) AS markdown FROM documents")
def _results_md(spark: SparkSession, d: str) -> DataFrame:
    results = F.array(F.struct(F.lit(1).alias("rank"), F.col("source").alias("title"), F.lit("u").alias("url"), F.lit("s").alias("snippet")))
    return table(spark, d, "documents").select("doc_id", search.results_markdown(F.col("lang"), F.lit("x"), results).alias("markdown"))


@query("q2_html_results", "SELECT doc_id, CAST(1 AS INTEGER) AS rank, source AS title, 'https://e.com/' || doc_id AS url, 'snip ' || lang AS snippet FROM documents")
def _html_results(spark: SparkSession, d: str) -> DataFrame:
    block = {"duckduckgo": ('<div class="result__body"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fe.com%2F', '">', "</a><div class='result__snippet'>"), "bing": ('<li class="b_algo"><h2><a href="https://e.com/', '">', "</a></h2><div class='b_caption'><p>")}
    provider = F.when(F.col("doc_id") % 2 == 0, "duckduckgo").otherwise("bing")
    shape = lambda p: F.concat(F.lit(block[p][0]), "doc_id", F.lit(block[p][1]), "source", F.lit(block[p][2] + "snip  "), "lang")
    rows = table(spark, d, "documents").select("doc_id", F.explode(search.page_results(provider, F.when(F.col("doc_id") % 2 == 0, shape("duckduckgo")).otherwise(shape("bing")), 5)).alias("r"))
    return rows.select("doc_id", "r.*")


# ---- conversations --------------------------------------------------------------------------

_TURNS = f"SELECT conv_id, place, role, content FROM (SELECT conv_id, role, regexp_replace(coalesce(text, ''), '^{SPACE}+|{SPACE}+$', '', 'g') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations) WHERE role IN ('user', 'assistant') AND content <> ''"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return dialog.visible_turns(table(spark, d, "conversations"))


@query("x14_visible_turns", f"SELECT conv_id, 'chatgpt-turn-' || place AS id, role, md5(content) AS digest FROM ({_TURNS})")
def _visible(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "id", "role", F.md5("content").alias("digest"))


_WHO = "CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END"


@query("m12_dialog_text", f"SELECT conv_id, md5(string_agg({_WHO} || ':' || chr(10) || content || chr(10), chr(10) ORDER BY place)) AS digest FROM ({_TURNS}) GROUP BY conv_id")
def _dialog_text(spark: SparkSession, d: str) -> DataFrame:
    return dialog.gathered(_turns(spark, d)).select("conv_id", F.md5(dialog.as_text(F.col("turns"))).alias("digest"))


@query("m12_dialog_markdown", f"""SELECT conv_id, md5('# Shared Dialog Capture' || chr(10) || chr(10) || '- Provider: `chatgpt`' || chr(10) || '- Source: u' || chr(10) || '- Capture method: `static`' || chr(10) || '- Status: `ok`' || chr(10) || '- Conversation ID: `' || conv_id || '`' || chr(10) || chr(10) || string_agg('**' || {_WHO} || '**' || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY place) || chr(10)) AS digest FROM ({_TURNS}) GROUP BY conv_id""")
def _dialog_markdown(spark: SparkSession, d: str) -> DataFrame:
    made = dialog.as_markdown(F.col("turns"), F.lit(None).cast("string"), F.lit("chatgpt"), F.lit("u"), F.lit("static"), F.col("conv_id").cast("string"))
    return dialog.gathered(_turns(spark, d)).select("conv_id", F.md5(made).alias("digest"))


@query("m12_demo_memory", f"""SELECT conv_id, md5('demo_memory' || chr(10) || string_agg('  event "chatgpt-turn-' || place || '"' || chr(10) || '    role "' || role || '"' || chr(10) || '    content "' || {_LINO.format("content")} || '"' || chr(10) || '    demoLabel "shared-dialog"' || chr(10) || '    conversationId "' || conv_id || '"' || chr(10) || '    evidence "u"', chr(10) ORDER BY place) || chr(10)) AS digest FROM ({_TURNS}) GROUP BY conv_id""")
def _demo_memory(spark: SparkSession, d: str) -> DataFrame:
    made = dialog.as_demo_memory(F.col("turns"), F.lit(None).cast("string"), F.lit("u"), F.col("conv_id").cast("string"))
    return dialog.gathered(_turns(spark, d)).select("conv_id", F.md5(made).alias("digest"))


# No SQL: a line of a turn that begins like a role opens a turn of its own.
@query("x15_transcript_turns")
def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("A: "), "content")
    joined = _turns(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))
    return dialog.transcript_turns(joined, "conv_id", "text").select("conv_id", "n", "role", F.md5("content").alias("digest"))


# ---- repositories, batches, frames ------------------------------------------------------------


@query("r11_sorted_tree", """
SELECT p_brand, string_agg(p_name || CASE WHEN p_size % 2 = 0 THEN '/' ELSE ' ' || p_partkey END, ',' ORDER BY p_size % 2, lower(p_name), p_partkey) AS tree FROM (SELECT *, p_name || p_partkey AS n FROM part) GROUP BY p_brand""".replace("p_name ||", "n ||", 1).replace("lower(p_name)", "lower(n)"))
def _tree(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("n", F.concat("p_name", "p_partkey"))
    entry = F.struct(F.col("n").alias("name"), F.when(F.col("p_size") % 2 == 0, "dir").otherwise("file").alias("type"), F.col("p_partkey").cast("long").alias("size"))
    repos = parts.groupBy("p_brand").agg(F.to_json(F.shuffle(F.collect_list(entry))).alias("body")).withColumn("slug", F.replace("p_brand", F.lit("#"), F.lit("-")))
    api = F.concat(F.lit("https://api.github.com/repos/o/"), "slug")
    record = repos.select(api.alias("url"), F.concat(F.lit('{"full_name":"'), "p_brand", F.lit('"}')).alias("body"))
    bodies = record.unionByName(repos.select(F.concat(api, F.lit("/contents")).alias("url"), "body"))
    made = repo.snapshots(repos.select(F.concat(F.lit("https://github.com/o/"), "slug").alias("url")), bodies)
    shown = F.transform("tree", lambda x: F.concat(x["name"], F.when(x["type"] == "dir", "/").otherwise(F.concat(F.lit(" "), x["size"].cast("string")))))
    return made.select(F.col("repository.full_name").alias("p_brand"), F.array_join(shown, ",").alias("tree"))


@query("b1_defaults_merge", "SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 3 = 0 THEN 'fallback' ELSE 'own ' || page_id END AS title, 'en' AS language FROM pages")
def _defaults(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("own "), "page_id")).alias("title"), F.lit(None).cast("string").alias("language"))
    return batch.with_defaults(articles, spark.range(1).select(F.lit("fallback").alias("title"), F.lit("en").alias("language")))


@query("b3_from_urls", r"SELECT CAST(page_id + 1 AS VARCHAR) AS id, url, 'archive/' || replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', ''), '.', '-') || '/' || (page_id + 1) AS archivePath FROM pages")
def _from_urls(spark: SparkSession, d: str) -> DataFrame:
    return batch.from_urls(table(spark, d, "pages"), "url", "page_id")


@query("b4_validate", "SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 4 = 0 THEN 'missing url' ELSE 'invalid url' END AS error FROM pages WHERE page_id % 4 IN (0, 1)")
def _validate(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, "not a url").otherwise(F.col("url")).alias("url"))
    return batch.errors(made)


_SAMPLES = "SELECT user_id, CAST(epoch_ms(ts) AS BIGINT) AS ms, event_type FROM events"


@query("z1_quiescence_batch", f"""
WITH s AS ({_SAMPLES}), o AS (SELECT *, min(ms) OVER (PARTITION BY user_id) AS start, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_type)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_type ROWS UNBOUNDED PRECEDING) AS island FROM o),
r AS (SELECT user_id, min(ms) AS at FROM (SELECT *, min(ms) OVER (PARTITION BY user_id, island) AS since FROM i) WHERE ms - since >= 60000 AND ms - start < 864000000 GROUP BY user_id)
SELECT s.user_id, count(*) AS n_samples, CASE WHEN any_value(r.at) IS NULL THEN 'timeout' ELSE 'settled' END AS status FROM s LEFT JOIN r USING (user_id) GROUP BY s.user_id""")
def _quiescence(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_type")
    return frames.settled(samples, "user_id", "ms", "event_type", 60_000, 864_000_000).select("user_id", "n_samples", "status")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("capture_id"), F.col("turn").alias("idx")).agg(F.lit(1).alias("_")).select("capture_id", F.col("idx").cast("int").alias("idx"), (F.col("idx") * 100).alias("ts_ms"), F.when(F.col("idx") % 4 == 0, F.lit("same")).otherwise(F.lpad(F.col("idx").cast("string"), 4, "0")).cast("binary").alias("bytes"))


@query("a2_frame_loops", "WITH f AS (SELECT DISTINCT conv_id AS capture_id, turn AS idx FROM conversations) SELECT capture_id, count(*) AS n_frames, CAST(min(CASE WHEN idx >= 3 AND idx % 4 = 0 AND 0 = (SELECT min(g.idx) FROM f g WHERE g.capture_id = f.capture_id) THEN idx END) AS INTEGER) AS loop_at FROM f GROUP BY capture_id")
def _loops(spark: SparkSession, d: str) -> DataFrame:
    return frames.loops(_frames(spark, d)).select("capture_id", "n_frames", "loop_at")


@query("a3_keyframes", "WITH f AS (SELECT DISTINCT conv_id AS capture_id, turn AS idx FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY capture_id) AS n FROM f) SELECT capture_id, CAST(idx AS INTEGER) AS idx, CASE WHEN k = 1 THEN 'first' WHEN k = n // 2 + 1 THEN 'middle' ELSE 'last' END AS which FROM k WHERE n >= 3 AND (k = 1 OR k = n OR k = n // 2 + 1)")
def _keyframes(spark: SparkSession, d: str) -> DataFrame:
    return frames.keyframes(_frames(spark, d)).select("capture_id", "idx", "which")


@query("a1_frame_similarity", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 3 = 1 THEN 0.75 ELSE 0.0 END AS similarity FROM documents")
def _similarity(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("doc_id") % 3 == 0, "abcd").when(F.col("doc_id") % 3 == 1, "abcX").otherwise("abc")
    return table(spark, d, "documents").select("doc_id", frames.similarity(F.lit("abcd").cast("binary"), other.cast("binary")).alias("similarity"))


@query("k3_archives")
def _archives(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.page_entries(table(spark, d, "pages").select("page_id", "html", F.lit("# x").alias("markdown")), "page_id")
    return archive.zip_entries(rows, "page_id").select("page_id", F.octet_length("zip").alias("n_bytes"))


@query("k7_docx_blocks", r"SELECT page_id, kind, text FROM (SELECT page_id, 'title' AS kind, 'T' || page_id AS text FROM pages UNION ALL SELECT page_id, 'heading', 'H' || page_id FROM pages UNION ALL SELECT page_id, 'bullet', 'b' FROM pages)")
def _docx(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<title>T"), "page_id", F.lit("</title><h1>H"), "page_id", F.lit("</h1><ul><li>b</ul>"))
    rows = table(spark, d, "pages").select("page_id", F.explode(archive.document_blocks(html)).alias("b"))
    return rows.select("page_id", "b.kind", "b.text")


@query("x18_api_document", "SELECT doc_id, '# ' || source || chr(10) || chr(10) || lang || chr(10) AS markdown FROM documents")
def _api_document(spark: SparkSession, d: str) -> DataFrame:
    run = lambda c, style: F.concat(F.lit(f'{{"paragraph":{{"paragraphStyle":{{"namedStyleType":"{style}"}},"elements":[{{"textRun":{{"content":"'), c, F.lit('\\n"}}]}}'))
    made = F.concat(F.lit('{"body":{"content":['), run(F.col("source"), "TITLE"), F.lit(","), run(F.col("lang"), "NORMAL_TEXT"), F.lit("]}}"))
    return table(spark, d, "documents").select("doc_id", richdoc.render_api_document(made)["markdown"].alias("markdown"))


@query("x17_model_blocks", "SELECT doc_id, '## ' || source || chr(10) || chr(10) || '**' || lang || '** x' || chr(10) AS markdown FROM documents")
def _model(spark: SparkSession, d: str) -> DataFrame:
    n, m = F.length("source"), F.length("lang")
    made = F.concat(
        F.lit('[{"ty":"is","s":"'), "source", F.lit("\\n"), "lang", F.lit(' x\\n"},{"ty":"as","st":"paragraph","si":1,"ei":'), n + 1, F.lit(',"sm":{"ps_hd":2}},{"ty":"as","st":"text","si":'), n + 2, F.lit(',"ei":'), n + 1 + m, F.lit(',"sm":{"ts_bd":true}}]')
    )
    chunks = F.concat(F.lit("["), made, F.lit("]"))
    return table(spark, d, "documents").select("doc_id", richdoc.render_model(chunks, F.lit(None).cast("string"), F.lit(None).cast("string"))["markdown"].alias("markdown"))


@query("r4b_range_join", "SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 100 AND o_totalprice < p_retailprice * 100 + 50")
def _range(spark: SparkSession, d: str) -> DataFrame:
    ranges = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + 50).alias("hi"))
    points = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return relational.range_join(points, ranges, "o_totalprice", "lo", "hi", 50).select("o_orderkey", "p_partkey")


@query("r5_running_numbers", "SELECT o_orderkey, CAST(1 + coalesce(sum(k) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_number FROM (SELECT o_orderkey, o_custkey, o_orderkey % 7 AS k FROM orders)")
def _running(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 7).alias("items"), F.lit(None).cast("long").alias("start"))
    return relational.running_numbers(lists, "o_custkey", "o_orderkey", "items", "start").select("o_orderkey", "first_number")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
