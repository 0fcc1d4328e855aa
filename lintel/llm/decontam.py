"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Each benchmark item becomes windows of ``width`` consecutive words. Containment asks
for all words of a window, so with the words ordered by rarity its prefix is one
token: the window's rarest word in the corpus (counted over every document). Document
words join that prefix; the offset of the token gives the only start where the window
can lie (positional bound), which must fit the document (length bound), and the words
there are compared with the window (exact check).

Windows come in blocks of at most ``block`` rows, each broadcast; a benchmark of any
size is taken in several blocks.

Defined results: null or empty texts have no words and no hits; a null item id is
ignored; repeated items count once per id; repeated document rows are kept apart by a
row number; an empty benchmark gives no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import BROADCAST_ROWS, alnum_words, staged

WIDTH = 10


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(item string, win array<string>): every window of every item, an item's whole text if it is shorter."""
    words = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), alnum_words(F.col(text_col)).alias("words")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    return (
        words.where(F.size("words") > 0)
        .withColumn("at", F.explode(starts))
        .select("item", F.expr(f"slice(words, at, {width})").alias("win"))
        .distinct()
    )


def _exploded(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("_words", alnum_words(F.col(text_col)))


def rarest_tokens(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """(win, items, tok, off, len): each distinct window with its rarest word and that word's offset."""
    vocabulary = windows.select(F.explode("win").alias("tok")).distinct()
    occurrences = docs.select(F.explode(alnum_words(F.col(text_col))).alias("tok"))
    if vocabulary.count() <= BROADCAST_ROWS:
        vocabulary = F.broadcast(vocabulary)
    counts = occurrences.join(vocabulary, "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("n"))
    distinct = windows.groupBy("win").agg(F.collect_set("item").alias("items"))
    tokens = distinct.select("win", "items", F.posexplode("win").alias("off", "tok")).join(counts, "tok", "left")
    order = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "tok", "off")
    first = tokens.withColumn("rank", F.row_number().over(order)).where("rank = 1 and n > 0")
    return first.select("win", "items", "tok", "off", F.size("win").alias("len"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted), spans of hit words [start, end)."""
    windows = staged(item_windows(items, item_col, item_text, width))
    prefixes = staged(rarest_tokens(docs, windows, text_col))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_rid"))
    n = prefixes.count()
    blocks = max(1, -(-n // block))
    if blocks > 1:
        base = staged(base)  # each block reads the same row numbers
    found = []
    for k in range(blocks):
        part = prefixes.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k) if blocks > 1 else prefixes
        words = base.withColumn("_words", alnum_words(F.col("_text"))).select(
            "_rid", "_id", "_words", F.posexplode_outer("_words").alias("_pos", "tok")
        )
        joined = words.join(F.broadcast(part), "tok", "left")
        at = F.col("_pos") - F.col("off")
        held = (
            F.col("len").isNotNull()
            & (at >= 0)
            & (at + F.col("len") <= F.size("_words"))
            & (F.slice("_words", F.greatest(at, F.lit(0)) + 1, F.coalesce("len", F.lit(1))) == F.col("win"))
        )
        size = F.coalesce(F.size("_words"), F.lit(0))
        marker = F.col("_pos").isNull() | (F.col("_pos") == size - 1)  # one row of each document carries its length
        found.append(
            joined.where(held | marker).select(
                "_rid",
                "_id",
                size.cast("long").alias("n_words"),
                F.when(held, F.struct(at.alias("s"), (at + F.col("len")).alias("e"))).alias("span"),
                F.when(held, F.col("items")).alias("items"),
            )
        )
    rows = reduce(DataFrame.unionByName, found)
    per_doc = rows.groupBy("_rid").agg(
        F.first("_id").alias(id_col),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # spans are sorted by start: each adds what lies past the furthest end so far
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["e"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["upto"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return per_doc.select(id_col, "n_words", covered.alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without documents that hold any benchmark window; columns as they were. Rows go by their text, so rows with
    a null or a repeated id are each judged on their own."""
    key = F.struct(F.xxhash64(F.lit(1), F.col(text_col)).alias("g"), F.xxhash64(F.lit(2), F.col(text_col)).alias("h"))
    found = contamination(docs.select(key.alias("__lx_key"), F.col(text_col).alias("__lx_text")), items, "__lx_key", "__lx_text", **options)
    hit = staged(found.where("n_hit > 0").select(F.col("__lx_key").alias("__lx_hit")).distinct())
    if hit.count() <= BROADCAST_ROWS:
        hit = F.broadcast(hit)
    kept = docs.withColumn("__lx_key", key).join(hit, F.col("__lx_key") == F.col("__lx_hit"), "left_anti")
    return kept.select(*[docs[c] for c in docs.columns])
