"""Content verification: expected snippets in long form, joined to the Markdown, checked and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.text import compare_code, compare_text


def sample_ends(rows: DataFrame, id_col: str, ord_col: str = "ord", k: int = 5) -> DataFrame:
    """The first k and the last k rows of each document; a row within both counts twice."""
    up, down = Window.partitionBy(id_col).orderBy(ord_col), Window.partitionBy(id_col).orderBy(F.desc(ord_col))
    head = rows.withColumn("_n", F.row_number().over(up)).where(F.col("_n") <= k).drop("_n")
    tail = rows.withColumn("_n", F.row_number().over(down)).where(F.col("_n") <= k).drop("_n")
    return head.unionByName(tail)


def words_found(needle: Column, hay: Column, least: float = 0.6) -> Column:
    words = F.filter(F.split(needle, " "), lambda w: F.length(w) > 2)
    hits = F.filter(words, lambda w: F.contains(hay, w))
    return (F.size(words) > 0) & (F.size(hits) >= least * F.size(words))


def _code_lines(text: Column) -> Column:
    """A snippet's lines that say something, in comparable form."""
    said = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 3) & ~F.regexp_like(x, F.lit(r"^[{}\[\](),;]+$")))
    return F.transform(said, compare_code)


def _found(kind: Column, text: Column, needle: Column, hay: Column, code_hay: Column, markdown: Column) -> Column:
    """Whether the snippet is in the Markdown, by the rule of its kind. ``needle``, ``hay`` and ``code_hay`` are comparable forms."""

    def loose(over: int, first: int) -> Column:
        return words_found(needle, hay) | ((F.length(needle) > over) & F.contains(hay, F.substring(needle, 1, first)))

    def code_in(lines: Column) -> Column:
        held = F.size(F.filter(lines, lambda x: F.contains(code_hay, x)))
        return (F.size(lines) == 0) | (held >= 0.6 * F.size(lines)) | F.contains(code_hay, compare_code(text))

    return (
        F.when(kind.isin("title", "heading"), F.contains(hay, needle))
        .when(kind == "paragraph", loose(20, 50))
        .when(kind == "list_item", loose(15, 40))
        .when(kind == "code", F.get(F.transform(F.array(_code_lines(text)), code_in), 0))
        .when(kind == "quoted_formula", quoted_formula(text, markdown))
    )


def check_snippets(rows: DataFrame, kind: str = "kind", text: str = "text", markdown: str = "markdown") -> DataFrame:
    """``rows`` with ``found``: whether each expected snippet is in its Markdown."""
    code = F.when(F.col(kind) == "code", compare_code(F.col(markdown)))
    sides = rows.withColumns({"_needle": compare_text(F.col(text)), "_hay": compare_text(F.col(markdown)), "_code_hay": code})
    found = _found(F.col(kind), F.col(text), F.col("_needle"), F.col("_hay"), F.col("_code_hay"), F.col(markdown))
    return sides.withColumn("found", found).drop("_needle", "_hay", "_code_hay")


def quoted_formula(formula: Column, markdown: Column) -> Column:
    """In a quoted line with a ``$``: two of the formula's parts (or all, if fewer), or the formula itself."""
    plain = F.trim(F.regexp_replace(formula, r"\s+", " "))
    bare = F.regexp_replace(F.regexp_replace(plain, r"\\(?:mathbf|textbf)\{([^}]*)\}", "$1"), r"[{}\\]", "")
    parts = F.filter(F.split(bare, r"\s+"), lambda p: F.length(p) > 1)
    lines = F.filter(F.regexp_extract_all(markdown, F.lit(r"(?m)^>.*$"), F.lit(0)), lambda x: F.contains(x, F.lit("$")))

    def in_line(x: Column) -> Column:
        n = F.size(F.filter(parts, lambda p: F.contains(F.lower(x), F.lower(p))))
        return ((F.size(parts) > 0) & (n >= F.least(F.lit(2), F.size(parts)))) | F.contains(x, plain)

    return F.exists(lines, in_line)


def containing(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "text") -> DataFrame:
    """(id) of documents that hold an item's text somewhere.

    Every word of an item but the first and the last, which may be parts of longer words, stands in such a document as a
    word: the documents' words are joined with each item's rarest one. Items without such a word are joined by their first
    characters with all stretches of that length. Candidates are compared in full.
    """
    wanted = items.select(F.col(item_col).alias("_item")).where("_item is not null").distinct()
    parts = F.split("_item", " ")
    inner = F.array_remove(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "")
    tokens = wanted.select("_item", F.explode(inner).alias("_tok")).distinct()
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    words = texts.select("_id", F.explode(F.array_distinct(F.split("_text", " "))).alias("_tok")).join(_small(tokens.select("_tok").distinct()), "_tok", "left_semi")
    often = words.groupBy("_tok").agg(F.count("*").alias("_n"))
    rarest = tokens.join(often, "_tok").groupBy("_item").agg(F.min_by("_tok", F.struct("_n", "_tok")).alias("_tok"))
    pairs = words.join(rarest, "_tok").select("_id", "_item")
    short = wanted.join(tokens, "_item", "left_anti").where("_item <> ''").withColumn("_tok", F.substring("_item", 1, 12))
    sizes = [r[0] for r in short.select(F.length("_tok")).distinct().collect()]  # at most twelve

    def stretches(n: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.length("_text") - (n - 1))
        return texts.where(F.length("_text") >= n).select("_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("_text", i, F.lit(n))))).alias("_tok"))

    for n in sizes:
        pairs = pairs.unionByName(stretches(n).join(_small(short.where(F.length("_tok") == n)), "_tok").select("_id", "_item"))
    held = texts.join(pairs.distinct(), "_id").where(F.contains("_text", "_item")).select("_id")
    if wanted.where("_item = ''").limit(1).count():
        held = held.unionByName(texts.where("_text is not null").select("_id"))
    return held.distinct().select(F.col("_id").alias(id_col))


def _small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """For a broadcast where the rows are few, as counted."""
    return F.broadcast(df) if df.count() <= most else df


FIGURE = r"(?i)!\[(?:\*\*)?(?:Figure|Рис\.?|Рисунок)\s*\d+[\s\S]*?\]\(images/figure-\d+\.(?:png|jpg)\)"


def verify(documents: DataFrame, expected: DataFrame, id_col: str = "doc_id", md_col: str = "markdown", figures_col: str | None = None) -> DataFrame:
    """Counts, pass rate and success of each document.

    ``expected(id, kind, ord, text)`` holds the snippets; paragraphs are sampled at both ends
    and list items are the first ten, by windows. A document's snippets travel to it as one
    array, so that its Markdown is normalised once, however many snippets there are, and isn't
    shuffled with each of them.
    """
    paragraphs = sample_ends(expected.where("kind = 'paragraph'"), id_col)
    ten = Window.partitionBy(id_col).orderBy("ord")
    items = expected.where("kind = 'list_item'").withColumn("_n", F.row_number().over(ten)).where("_n <= 10").drop("_n")
    wanted = expected.where("kind not in ('paragraph', 'list_item')").unionByName(paragraphs).unionByName(items)
    wanted = wanted.select(id_col, F.struct("kind", "text", compare_text(F.col("text")).alias("needle")).alias("s"))
    snippets = wanted.groupBy(id_col).agg(F.collect_list("s").alias("_s"))
    any_code = F.exists("_s", lambda x: x["kind"] == "code")
    sides = documents.join(snippets, id_col, "left").withColumns({"_hay": compare_text(F.col(md_col)), "_code_hay": F.when(any_code, compare_code(F.col(md_col)))})
    found = F.filter("_s", lambda x: _found(x["kind"], x["text"], x["needle"], F.col("_hay"), F.col("_code_hay"), F.col(md_col)))
    counts = sides.withColumns({"n": F.size("_s"), "ok": F.size(found)})
    figures = F.lit(None).cast("int") if figures_col is None else F.col(figures_col)
    shown = F.regexp_count(md_col, F.lit(FIGURE))
    out = counts.withColumns({"_wanted": F.coalesce(figures, F.lit(0)), "_shown": shown, "n": F.greatest("n", F.lit(0)).cast("long"), "ok": F.greatest("ok", F.lit(0)).cast("long")})
    total = F.coalesce("n", F.lit(0)) + (F.col("_wanted") > 0).cast("int")
    passed = F.coalesce("ok", F.lit(0)) + ((F.col("_wanted") > 0) & (F.col("_shown") >= F.col("_wanted"))).cast("int")
    rate = F.when(total > 0, passed / total).otherwise(0.0)
    return out.select(id_col, total.alias("total_checks"), passed.alias("passed_checks"), F.round(rate, 6).alias("pass_rate"), (passed < total).alias("has_missing_content"), ((passed == total) | (rate >= 0.85)).alias("success"))
