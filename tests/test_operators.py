"""Operators over tables, with odd rows; sources and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lintel.functions import predicates as P
from lintel.functions import text as X
from lintel.functions import urls as U
from lintel.operators import archive, batch, dialog, images, pages, repo, search, verify


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (X.normalize_unicode, "a b—c–d…“e”", 'a&nbsp;b — c-d..."e"'),
        (X.percent_in_formulas, r"$5\%$ $6\text{%}$", r"$5\\%$ $6\\%$"),
        (X.tidy_spaces, "a   b  \nc", "a b  \nc"),
        (X.space_formulas, "word$ x $word", "word $x$ word"),
        (X.space_bold, "x** a **y", "x **a** y"),
        (X.drop_empty_bold, "a****b", "a b"),
        (X.compare_text, "  A  \\times $b$ ", "a x b"),
        (X.clean_markdown, "\n\na\n\n\n\nb\n", "a\n\nb\n"),
        (X.fence, "x ```` y", "`````"),
        (X.escape_html, "<a&'\">", "&lt;a&amp;&#39;&quot;&gt;"),
        (X.normalize_export_markdown, "a\\. ~b~ c\n\n\n\nd", "a. ~~b~~ c\n\nd"),
        (X.clean_search_text, "<b>a</b> &amp;  b", "a & b"),
        (U.repository, "https://github.com/a/b", "a/b"),
        (U.repository, "not a url", None),
        (U.redirect_target, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fe.com", "https://e.com"),
        (P.declared_charset, '<meta charset="UTF-8">', "utf-8"),
        (images.strip_embedded, "![a](data:image/png;base64,QQ==) ![](data:image/png;base64,QQ==)", "*[image: a]* ![]()"),
    ],
)
def test_functions(spark, f, given, want):
    assert value(spark, f(F.lit(given))) == want
    value(spark, f(F.lit(None).cast("string")))


def test_pages_of_a_batch_are_parsed_in_pieces(spark):
    """The results of a whole batch, up to 10,000 pages of tables, don't fit an executor."""
    import pyarrow as pa

    rows = [f"<table><tr><th>n{''.join(f'<tr><td>{i}<td>{k}' for i in range(2000))}</table>" for k in range(120)]
    rows += [None, "", "<p>no table</p>", f"<table><tr><td>{'x' * 3_000_000}</table>"]
    html = pa.array(rows)
    cuts = list(pages.pieces(html))
    assert [i for x in cuts for i in range(x.start, x.stop)] == list(range(len(rows)))
    assert all(html[x].nbytes <= 2 * pages.PIECE_BYTES or x.stop - x.start == 1 for x in cuts) and len(cuts) > 3
    assert not list(pages.pieces(pa.array([], pa.string()))) and len(list(pages.pieces(pa.nulls(3, pa.string())))) == 1
    df = spark.createDataFrame(list(enumerate(rows)), "k long, html string").withColumn("url", F.lit(None).cast("string")).coalesce(1)
    got = {r["k"]: r["t"] for r in pages.parse_pages(df, ("tables",)).select("k", F.get("page.tables", F.lit(0)).alias("t")).collect()}
    assert len(got) == len(rows) and got[120] is got[122] is None and got[123]["cells"] == [["x" * 3_000_000]]
    assert all(got[k]["n_rows"] == 2001 and got[k]["cells"][2000] == ["1999", str(k)] for k in range(120))


def test_parse_pages_prunes_and_survives(spark):
    df = spark.createDataFrame([(1, "<title>T</title><h1>H</h1><a href='/x'>y</a>", "http://e.com/"), (2, None, None), (3, "<<<", "x")], "page_id long, html string, url string")
    rows = {r["page_id"]: r["page"] for r in pages.parse_pages(df, ("title", "links")).collect()}
    assert rows[1]["title"] == "T" and rows[1]["links"][0]["url"] == "http://e.com/x" and rows[1]["markdown"] is None
    assert rows[2]["title"] is None and rows[3]["links"] == []


def test_streamed_chat(spark):
    table = [{"_1": 2}, "linear_conversation", [3, 9], {"_4": 5}, "message", {"_6": 7, "_8": 12}, "author", {"_10": 11}, "content", {"_4": 13}, "role", "user", {"_14": 15}, {"_6": 16, "_8": 17}, "parts", [18], {"_10": 19}, "hello", "question", "assistant"]
    html = f"<script>{P.ENQUEUE}{json.dumps(json.dumps(table))})</script>"
    df = spark.createDataFrame([(html, None, "https://chatgpt.com/share/1"), (None, "please log in", "https://e.com"), (None, html, "https://e.com")], "static_html string, rendered_html string, url string")
    got = dialog.capture_dialogs(df).collect()
    assert [(r["status"], r["capture_method"], r["provider"]) for r in got] == [("ok", "static", "chatgpt"), ("unsupported", "none", "unknown"), ("ok", "browser", "chatgpt")]
    assert [(t["role"], t["content"]) for t in got[0]["turns"]] == [("user", "question"), ("assistant", "hello")] and got[1]["unsupported_reason"] == "login_required"


def test_stream_table_cycles_end():
    assert dialog.resolve_table([{"_1": 0, "_2": -5}, "a", "b"]) == {"a": None, "b": None}


def test_searches(spark):
    queries = spark.createDataFrame([("a b", "wikipedia"), ("a b", "google"), ("x", "nowhere")], "query string, provider string")
    body = json.dumps({"pages": [{"key": "K", "title": "", "excerpt": "<i>e</i>", "description": None}]})
    receipts = spark.createDataFrame([("https://en.wikipedia.org/w/rest.php/v1/search/page?q=a%20b&limit=10", 200, body, None, None), ("https://www.google.com/search?q=a%20b&num=10", 429, "unusual traffic", None, None)], "url string, status int, body string, error string, error_kind string")
    got = {r["provider"]: r for r in search.run_searches(queries, receipts).collect()}
    assert got["wikipedia"]["results"][0]["title"] == "K" and got["wikipedia"]["results"][0]["snippet"] == "e"
    assert got["google"]["diagnostics"]["blocked_by_captcha"] and got["google"]["results"] == []
    assert got["nowhere"]["diagnostics"]["error"] == "Unknown search provider"


def test_verify(spark):
    docs = spark.createDataFrame([(1, "# Title\n\nsome words are here\n\n> $x + y$\n\n```\nfoo(bar)\n```"), (2, "")], "doc_id long, markdown string")
    want = [(1, "title", 0, "Title"), (1, "paragraph", 1, "some words are missing"), (1, "code", 2, "foo(bar)\n}"), (1, "quoted_formula", 3, "x + y"), (2, "title", 0, "T")]
    got = {r["doc_id"]: r for r in verify.verify(docs, spark.createDataFrame(want, "doc_id long, kind string, ord int, text string")).collect()}
    # one paragraph lies in both samples
    assert (got[1]["total_checks"], got[1]["passed_checks"], got[1]["success"]) == (5, 5, True) and not got[2]["success"]


def test_archive_and_docx(spark):
    df = spark.createDataFrame([(1, "<title>T</title><h1>H</h1>", "# T")], "page_id long, html string, markdown string")
    raw = archive.zip_entries(archive.page_entries(df, "page_id"), "page_id").first()["zip"]
    assert zipfile.ZipFile(io.BytesIO(raw)).namelist() == ["document.html", "document.md"]
    made = df.select(archive.docx(archive.document_blocks(F.col("html"))).alias("d")).first()["d"]
    assert b"Heading1" in zipfile.ZipFile(io.BytesIO(made)).read("word/document.xml")


def test_repository(spark):
    import base64

    urls = spark.createDataFrame([("https://github.com/a/b",)], "url string")
    api = "https://api.github.com/repos/a/b"
    bodies = [(api, json.dumps({"full_name": "a/b", "html_url": "h", "stargazers_count": 1234, "default_branch": "main"})), (f"{api}/readme", json.dumps({"path": "README.md", "content": base64.b64encode(b"hi").decode()})), (f"{api}/contents", json.dumps([{"name": "z", "type": "file", "size": 2048, "html_url": "u"}, {"name": "d", "type": "dir", "html_url": "v"}]))]
    out = repo.snapshots(urls, spark.createDataFrame(bodies, "url string, body string")).select(repo.as_markdown().alias("m"), repo.as_text().alias("t")).first()
    assert "- Stars: 1,234" in out["m"] and out["m"].index("[d/](v)") < out["m"].index("- [z](u) (2.0 KB)") and out["m"].endswith("hi\n")
    assert "Repository: a/b" in out["t"]


def test_batch(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"articles": {"a": {"url": "https://e.com/1"}, "b": {"url": "", "title": "own"}}, "defaults": {"title": "d", "format": "md"}}))
    articles, defaults = batch.load(spark, str(tmp_path / "c.json"))
    got = {r["id"]: r for r in batch.with_defaults(articles, defaults).collect()}
    assert got["a"]["title"] == "d" and got["b"]["title"] == "own" and got["b"]["format"] == "md"
    assert [(r["id"], r["error"]) for r in batch.errors(articles).collect()] == [("b", "missing url")]
    assert batch.errors(articles.where("false")).first()["error"] == "no articles"
    assert "a, b" in batch.article(articles, defaults, "nope").first()["error"]


def test_receipt_source(spark):
    from lintel.sources import receipts

    def transport(url):
        if "bad" in url:
            raise TimeoutError("late")
        return {"status": 200, "headers": {"content-type": "text/html; charset=latin1"}, "body": "é".encode("latin-1")}

    urls = spark.createDataFrame([(1, "http://a"), (2, "http://bad"), (3, None)], "n long, url string")
    got = {r["url"]: r for r in receipts.fetch(urls, transport).collect()}
    assert got["http://bad"]["error_kind"] == "timeout" and got["http://a"]["status"] == 200 and got["http://a"]["n"] == 1
    assert got[None]["outcome"] == "error"
    assert receipts.text_only(receipts.fetch(urls.limit(1), transport)).first()["text"] == "é"
    spark.dataSource.register(receipts.ReceiptSource)
    read = spark.read.format("receipts").option("urls", "http://a").option("transport", receipts.portable(transport)).load()
    assert read.first()["headers"] == {"content-type": "text/html; charset=latin1"}


def test_routes(spark):
    from lintel.sources import receipts

    rows = [("https://drive.google.com/file/d/abcDEF123456789/view",), ("https://stackoverflow.com/questions/7/x",), ("https://e.com/",)]
    out = receipts.routed(spark.createDataFrame(rows, "url string")).withColumns({"headers": F.create_map(F.lit("content-type"), F.lit("image/png")), "body": F.lit("<p>").cast("binary")})
    got = {r["route"]: r for r in receipts.page_html(out).collect()}
    assert set(got) == {"drive_image", "question", "page"} and got["page"]["html"] == "<p>" and got["page"]["fetch_url"] == "https://e.com/"
    assert "abcDEF123456789" in got["drive_image"]["html"] and got["drive_image"]["html"].startswith("<!doctype html>")


def test_containing(spark):
    """Against a plain search: items inside of words, of one word, short, with line ends, and empty ones."""
    docs = [(1, "the cat sat on the mat today again"), (2, "scathed mats"), (3, "a\nb c d"), (4, ""), (5, None), (6, "xx yy zz"), (6, "the cat")]
    items = ["the mat", "cat sat on the ma", "the", "a\nb", "y z", "q", "mat today again", "no such words here", None, "he cat sat o"]
    for own in (items, [*items, ""]):
        got = verify.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in own], "text string"))
        assert sorted(r[0] for r in got.collect()) == sorted({d for d, t in docs if t is not None and any(x is not None and x in t for x in own)})


def test_verify_row_by_row_agrees(spark):
    """One array of snippets a document, or a row for each snippet: the same answers."""
    words = "alpha beta gamma delta \u00d7 \u2014 \\times $x$ caf\u00e9 \u2019s".split()
    docs = [(k, "\n".join(" ".join(words[(k * 7 + j * 3 + i) % len(words)] for i in range(9)) for j in range(5))) for k in range(12)] + [(99, None)]
    kinds = ["title", "heading", "paragraph", "list_item", "code", "quoted_formula", "other"]
    want = [(k, kinds[(k + j) % 7], j, " ".join(words[(k * 5 + j * (1 + i)) % len(words)] for i in range(6))) for k in range(14) for j in range(9)]
    documents = spark.createDataFrame(docs, "doc_id long, markdown string")
    expected = spark.createDataFrame(want, "doc_id long, kind string, ord int, text string").where("kind not in ('paragraph', 'list_item')")
    rows = verify.check_snippets(expected.join(documents, "doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("found").alias("ok"))
    plain = {r["doc_id"]: (r["n"], r["ok"]) for r in rows.collect()}
    got = {r["doc_id"]: (r["total_checks"], r["passed_checks"]) for r in verify.verify(documents, expected).collect()}
    assert got == {k: plain.get(k, (0, 0)) for k, _ in docs} and len({ok for _, ok in got.values()}) > 1


def test_images_of_html_and_markdown(spark):
    html = '<p><img alt="a" src="data:image/jpeg;base64,QUI="><IMG src="data:image/svg+xml;base64,PHN2Zz4=" id=x><img src="/k.png"></p>'
    df = spark.createDataFrame([(1, html, "![a](http://h/1.png) x ![](http://h/2.jpg \"t\") ![b](http://h/1.png)y"), (2, None, "no image"), (3, "<p>", None)], "id long, html string, markdown string")
    out, rows = images.embedded_in_html(df, "id")
    assert {r["id"]: r["html"] for r in out.collect()}[1] == '<p><img alt="a" src="images/image-01.jpg"><IMG src="images/image-02.svg" id=x><img src="/k.png"></p>'
    assert sorted((r["filename"], r["mime_type"], bytes(r["bytes"])) for r in rows.collect()) == [("image-01.jpg", "image/jpeg", b"AB"), ("image-02.svg", "image/svg+xml", b"<svg>")]
    got = {r["id"]: r for r in images.plan_every(df, "id").collect()}
    assert got[1]["markdown"] == "![a](images/image-01.png) x ![](images/image-02.jpg) ![b](images/image-03.png)y"
    assert [(x["url"][-5:], x["filename"]) for x in got[1]["pending"]] == [("1.png", "image-01.png"), ("2.jpg", "image-02.jpg"), ("1.png", "image-03.png")]
    assert got[2]["markdown"] == "no image" and got[2]["pending"] == [] and got[3]["markdown"] is None
    refs = images.references(df, "id")
    excluded = spark.createDataFrame([(f"d{k}.org",) for k in range(20)] + [("H",)], "domain string")
    assert images.localisable(refs, excluded).count() == 0 and images.localisable(refs, excluded.where("domain <> 'H'")).count() == 3
    below = spark.createDataFrame([(1, 0, "https://a.b.c.org/x.png"), (1, 1, "https://xc.org/y.png"), (1, 2, "images/z.png")], "id long, ord int, url string")
    assert [r["url"] for r in images.localisable(below, spark.createDataFrame([("c.org",)], "domain string")).collect()] == ["https://xc.org/y.png"]
    assert images.present_in(refs, refs.where("url like '%1.png'")).count() == 2


def test_localised_document_keeps_failed_names(spark):
    df = spark.createDataFrame([(1, "![](u/1) ![](u/12)", '<img src="u/1"><img src="u/12">')], "id long, markdown string, html string")
    refs = spark.createDataFrame([(1, 0, "u/1"), (1, 1, "u/12"), (1, 2, "u/1"), (1, 3, None)], "id long, ord int, url string")
    receipts = spark.createDataFrame([("u/1", 200, b"x"), ("u/12", 404, b"y")], "url string, status int, body binary")
    out, rows = images.localise_document(df, "id", refs, receipts)
    r = out.first()
    assert r["markdown"] == "![](images/image-01.png) ![](images/image-02.png)" and r["html"].count("images/image-0") == 2
    assert [(x["filename"], bytes(x["body"])) for x in rows.collect()] == [("image-01.png", b"x")]


def test_archives_of_pages(spark):
    html = '<html><head><link rel="stylesheet" href="/s.css"></head><body><script>1</script><p>x <img src="a.gif?v=1"><img src="b" data-extension=".JPG"><img src="/d/a.gif?v=1"></p></body></html>'
    df = spark.createDataFrame([(1, "e.com/d/p", html), (2, "e.com", None)], "page_id long, url string, html string")
    receipts = spark.createDataFrame([("https://e.com/d/a.gif?v=1", 200, b"G"), ("https://e.com/d/b", 500, b""), ("https://e.com/s.css", 200, b"C")], "url string, status int, body binary")
    got = {r["path"]: bytes(r["bytes"]).decode() for r in archive.archive_entries(df, "page_id", receipts, document="html").collect()}
    assert set(got) == {"document.html", "images/image-1.gif", "css/style-1.css"} and "<script" not in got["document.html"]
    assert got["document.html"].count('src="images/image-1.gif"') == 2 and 'src="images/image-2.jpg"' in got["document.html"] and 'href="css/style-1.css"' in got["document.html"]
    got = {r["path"]: bytes(r["bytes"]).decode() for r in archive.archive_entries(df, "page_id", receipts).collect()}
    assert set(got) == {"document.html", "document.md", "images/image-1.gif"} and got["document.md"].count("(images/image-1.gif)") == 2 and "script" in got["document.html"]
    got = {r["path"]: bytes(r["bytes"]).decode() for r in archive.archive_entries(df, "page_id", receipts, keep_links=True).collect()}
    assert set(got) == {"document.html", "document.md"} and "https://e.com/d/a.gif?v=1" in got["document.md"]
    assert value(spark, archive.archive_name(F.lit("https://www.e.com/x"))) == "www-e-com-archive.zip"


def test_metadata_lines(spark):
    m = {"author": "nick", "author_full_name": "N. Ick", "author_url": "u", "author_karma": "5", "publish_date": "2024-03-01T10:00:00Z", "date_modified": "2024-04-02T10:00:00Z", "reading_time": "3 min", "views": "9", "votes": "1", "hubs": ["H"], "hub_urls": [{"name": "H", "url": "h"}], "tags": ["a", "b"], "is_translation": True, "original_authors": "O", "original_article_url": "o"}
    kind = f"struct<{pages.PARSED.split('metadata struct<')[1]}"
    df = spark.createDataFrame([(json.dumps(m),), (json.dumps({"tag_links": [{"name": "t", "url": None}]}),), (None,)], "j string").select(F.from_json("j", kind).alias("metadata"))
    rows = df.select(pages.metadata_header().alias("h"), pages.metadata_footer().alias("f")).collect()
    assert rows[0]["h"] == ["**Author:** [N. Ick (nick)](u)", "**Type:** Translation", "**Original article:** [O](o)", "**Published:** March 1, 2024 (updated April 2, 2024)", "**Reading time: 3 min | Views: 9**", "**Hubs:** H", "**Tags:** a, b"]
    assert rows[0]["f"] == ["---", "", "**Tags:** a, b", "", "**Hubs:** [H](h)", "", "**Votes: 1 | Views: 9**", "", "**Author:** [N. Ick (nick)](u) | Karma: 5", ""]
    assert rows[1]["h"] == [] and rows[1]["f"] == ["---", "", "**Tags:** t", ""] and rows[2]["h"] == [] and rows[2]["f"] == []


def test_metadata_tables_and_warnings_of_one_parse(spark):
    html = "<TIME DATETIME='2024-01-01'>New Year</TIME><table><tr><th>a<th>b<tr><td>1|2<td><b>x</b></table><iframe></iframe><p>end <a href='/q'>l</a>"
    page = pages.parse_pages(spark.createDataFrame([(1, "http://h/d/", html)], "page_id long, url string, html string"), pages.FIELDS).first()["page"]
    assert page["metadata"]["publish_date"] == "2024-01-01" and page["links"][0]["href"] == "/q"
    assert page["tables"][0]["cells"] == [["a", "b"], ["1|2", "x"]] and page["tables"][0]["markdown"] == "| a | b |\n| --- | --- |\n| 1\\|2 | **x** |"
    assert page["warnings"] == ["embedded frames were dropped"] and "[l](http://h/q)" in page["markdown"] and page["text"].startswith("New Year")


def test_figures_of_receipts(spark):
    figures = spark.createDataFrame([(1, 3, "http://h/a.jpeg", "c"), (1, 4, "http://h/b", None), (1, 5, "http://h/c.png", "d")], "id long, figure_num int, src string, caption string")
    receipts = spark.createDataFrame([("http://h/a.jpeg", 200, b"x"), ("http://h/b", 404, b"")], "url string, status int, body binary")
    got = {r["figure_num"]: (r["filename"], r["error"]) for r in pages.figure_rows(figures, "id", receipts).collect()}
    assert got == {3: ("figure-3.jpg", None), 4: ("figure-4.png", "HTTP 404"), 5: ("figure-5.png", "not fetched")}


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (X.strip_empty_titles, "<img src=a title=\"\" alt='x' title=''><p title=\"\"><img title=\"t\">", "<img src=a alt='x'><p title=\"\"><img title=\"t\">"),
        (lambda c: X.attribute(c, "href"), "<a class=x HREF = 'a&amp;b&#233;&#x1F600;&#97;'>", "a&b\u00e9\U0001f600a"),
        (lambda c: X.attribute(c, "href"), "<a href=/x?y>", "/x?y"),
        (lambda c: X.attribute(c, "href"), '<a href=" ">', None),
        (lambda c: X.attribute(c, "href"), "<a data-x=1>", None),
        (pages.without_popups, '<div class="fc-consent-root">x</div><div class="Cookie-bar" style="position: fixed">y</div><p class="popup">z</p>', '<html><head></head><body><p class="popup">z</p></body></html>'),
        (batch.snake_json, '{"aB": [{"cDe": 1, "x_y": null}], "k": "aB"}', '{"a_b":[{"c_de":1,"x_y":null}],"k":"aB"}'),
        (batch.snake_json, "{", None),
    ],
)
def test_further_functions(spark, f, given, want):
    assert value(spark, f(F.lit(given))) == want
    value(spark, f(F.lit(None).cast("string")))


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Title\n=====\ntext\n-----\n=======", "# Title\n## text\n=======\n"),
        ("## **a \\(b\\)** ##\n###   *c*\n#no", "## a (b)\n### c\n#no\n"),
        ("* a\n\n\n  * b\n\n1. c\n\ntext\n\n+ d", "- a\n  - b\n1. c\n\ntext\n\n+ d\n"),
        ("> a\n\n>\n> b\n>\nafter\n>\nend", "> a\n>\n> b\n\nafter\nend\n"),
        ("|a|b |\n|:---|---|\n| 1|2|3\n|x|y|\n\n|no\n|rule|", "| a | b |\n| --- | --- |\n| 1|2|3\n|x|y|\n\n|no\n|rule|\n"),
        ("|a|\n|:---:|\n|  c |", "| a |\n| --- |\n| c |\n"),
        ("", "\n"),
    ],
)
def test_export_markdown(given, want):
    assert X.export_markdown(given) == want


def test_documents_from_receipts(spark):
    from lintel.operators import richdoc

    url = "https://docs.google.com/document/d/abcDEF_1234567890/edit"
    docs = spark.createDataFrame([(1, url), (2, "https://e.com/x"), (3, url.replace("abc", "xyz"))], "n long, url string")
    made = docs.select(U.document_export_url(U.document_id(F.col("url")), "md").alias("url")).first()["url"]
    receipts = spark.createDataFrame([(made, 200, "a &amp; b".encode()), (made.replace("abc", "xyz"), 403, b"")], "url string, status int, body binary")
    got = {r["n"]: r for r in richdoc.exports(docs, receipts, "md").collect()}
    assert got[1]["content"] == "a & b" and got[1]["error"] is None and got[1]["format"] == "md" and "403" in got[3]["error"] and got[2]["error"].endswith("https://e.com/x")
    assert {r["error"] is None for r in richdoc.api_documents(docs, receipts).collect()} == {False}


def test_dialog_as_json(spark):
    made = value(spark, dialog.as_json(title=F.lit("t"), status=F.lit(None).cast("string"), turns=F.array(F.struct(F.lit("1").alias("id")))))
    assert json.loads(made) == {"title": "t", "status": None, "turns": [{"id": "1"}]} and made.endswith("}\n") and "\n  " in made


def test_options(spark):
    asked = spark.createDataFrame([("GIF", "12px", "0", "true"), ("bmp", "x", ".5", None), (None, None, None, "TRUE")], "format string, maxSize string, similarity string, extractKeyframes string")
    got = [(r["error"] is None, r["format"], r["maxSize"], r["similarity"], r["minFrames"], r["extractKeyframes"]) for r in batch.animation_options(asked).collect()]
    assert got == [(True, "gif", 12, 0.99, 120, True), (False, "bmp", 1024, 0.5, 120, False), (True, "gif", 1024, 0.99, 120, False)]
    o = batch.EngineOptions.from_env({"LINTEL_EMBED_IMAGES": "TRUE", "LINTEL_ENGINE": "playwright", "LINTEL_FORMAT": "txt"}, format="html")
    assert (o.embed_images, o.engine, o.format, o.local_images) == (True, "playwright", "html", True)
    nested = spark.createDataFrame([((1, [(2,)]),)], "camelCase struct<innerField:int,listOf:array<struct<deepField:int>>>")
    assert batch.snake_columns(nested).schema.simpleString() == "struct<camel_case:struct<inner_field:int,list_of:array<struct<deep_field:int>>>>"


def test_model_samples(spark):
    from pyspark.sql import Observation  # noqa: F401

    from lintel.operators import richdoc

    df = spark.createDataFrame([(["{}", "\u00e9"], ["{}", "ab"]), (None, None), (["a"], ["bb"])], "a array<string>, b array<string>")
    a, b = richdoc.model_fingerprint(F.col("a")), richdoc.model_fingerprint(F.col("b"))
    assert [(r["x"]["chunks"], r["x"]["payload_bytes"], r["s"]) for r in df.select(a.alias("x"), richdoc.same_fingerprint(a, b).alias("s")).collect()] == [(2, 4, True), (0, 0, True), (1, 1, False)]
    seen = Observation("blocks")
    blocks = spark.createDataFrame([("table", "x"), ("paragraph", "\u00e9"), ("image", None)], "kind string, text string")
    richdoc.observed(blocks, seen).collect()
    assert seen.get == {"blocks": 3, "tables": 1, "images": 1, "text_bytes": 3}
    items = spark.createDataFrame([(1, "c1"), (1, "c2")], "doc_id long, cid string")
    got = richdoc.with_image_urls(items, spark.createDataFrame([(1, "c1", "u")], "doc_id long, cid string, url string"))
    assert sorted((r["cid"], r["url"]) for r in got.collect()) == [("c1", "u"), ("c2", None)]


def test_table_places_cut_in_a_cycle_are_whole_elsewhere():
    table = [{"_5": 1, "_6": 3}, {"_7": 2}, {"_8": 1, "_9": 4}, [2, 1], "leaf", "first", "second", "down", "up", "more"]
    two = {"up": None, "more": "leaf"}
    assert dialog.resolve_table(table) == {"first": {"down": two}, "second": [{"up": {"down": None}, "more": "leaf"}, {"down": two}]}


def test_silent_keys_time_out(spark, tmp_path):
    """A key whose samples stop is a timeout by the clock; then its state goes."""
    import time

    from lintel.streaming.receipts import settle

    df = spark.createDataFrame([("a", 0, "x"), ("b", 0, "x"), ("b", 600, "x")], "key string, ts_ms long, fingerprint string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = settle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), stable_ms=500, most_ms=1500)
    q = stream.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and (spark.table("silent").count() < 2 or q.lastProgress["stateOperators"][0]["numRowsTotal"]):
            time.sleep(0.3)
        assert {(r["key"], r["at_ms"], r["status"]) for r in spark.table("silent").collect()} == {("b", 600, "settled"), ("a", 1500, "timeout")}
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    from lintel.operators.frames import settled
    from lintel.streaming.receipts import settle

    rows = [("a", 0, "x"), ("a", 1000, "y"), ("a", 2600, "y"), ("b", 0, "x"), ("b", 900, "y"), ("b", 1800, "z")]
    df = spark.createDataFrame(rows, "key string, ts_ms long, fingerprint string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = settle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), most_ms=900_000)  # beyond what the test takes
    q = stream.writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["key"], r["at_ms"], r["status"]) for r in spark.table("settled").collect()}
    want = {(r["key"], r["settled_ms"], "settled") for r in settled(df, "key", "ts_ms", "fingerprint").where("settled_ms is not null").collect()}
    assert got == want == {("a", 2600, "settled")}


def test_queries_without_filters(spark, tmp_path):
    """Links with query values, role-like lines in turns, and all parts of the range join, against plain versions."""
    import hashlib
    import re
    from urllib.parse import quote

    from lintel.plans import queries as plans

    hrefs = ["/a?x=1&y=2#f", "/p%20q%3Fr%23s", "/a+b;c=$~", "//h/x", "b", "/é x"]
    html = "".join(f'<a href="{x}">x</a>' for x in hrefs)
    spark.createDataFrame([(1, "https://h.org/d/e?z", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["ord"]: r["url"] for r in plans.QUERIES["u2_root_relative"](spark, str(tmp_path)).collect()}
    assert got == {k: "https://h.org" + quote(x, safe="/,'!()*:@&=+$;~%?#") if re.match("/(?!/)", x) else None for k, x in enumerate(hrefs)}

    turns = [(1, 0, "user", "hi\nA: no\nmore"), (1, 1, "assistant", "user:\n\nu: x\n  Assistant:  y"), (1, 2, "user", "bye"), (2, 0, "assistant", "plain")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = []
    for conv in (1, 2):
        text, parts = "\n\n".join(("User: " if r == "user" else "A: ") + x for c, _, r, x in turns if c == conv), []
        for line in text.split("\n"):
            m = re.match(r"\s*(user:|assistant:|u:|a:)", line, re.I)
            if m:
                parts.append(["user" if m[1].lower()[0] == "u" else "assistant", line[m.end() :].lstrip()])
            elif parts:
                parts[-1][1] += "\n" + line
        kept = [(r, x.strip()) for r, x in parts if x.strip()]
        want += [(conv, n, r, hashlib.md5(x.encode()).hexdigest()) for n, (r, x) in enumerate(kept, 1)]
    assert sorted(map(tuple, plans.QUERIES["x15_transcript_turns"](spark, str(tmp_path)).collect())) == want and len(want) == 7

    parts, orders = [(k, 900.0 + k / 10) for k in range(1, 801)], [(k, 90_000.0 + 37 * k) for k in range(300)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    met = sorted(map(tuple, plans.QUERIES["r4b_range_join"](spark, str(tmp_path)).collect()))
    assert met == sorted((o, p) for o, x in orders for p, y in parts if y * 100 <= x < y * 100 + 50) and any(p > 400 for _, p in met)
