"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary of the text digests (``approx_top_k``, whose sketch is the
mergeable form of that algorithm) names every digest that may hold more than
``1 / tracked`` of the rows. An exact count verifies them; those that do repeat
often enough are broadcast (at most ``tracked`` rows) and their losing copies go
map-side, before any shuffle. All other digests use an ordinary shuffle.

Defined results: a null text counts as empty; a null id is the smallest; rows that
agree in text and id are told apart by a row number, so one of them stays; an
empty table gives an empty result; extra columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import BROADCAST_ROWS, ascii_lower, staged

#: Counters of the Misra-Gries summary; also the most rows broadcast.
TRACKED = 4096


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def heavy_digests(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Verified frequent digests of ``rows(_dg, _id, _rid)``: ``_dg, _size, _keep``; at most ``tracked`` rows.

    The sketch misses no digest above ``1 / tracked`` of the rows. Its estimates only
    nominate; sizes and winners come from an exact, map-side combined aggregation.
    """
    sketch = F.expr(f"approx_top_k(hex(_dg), {tracked}, {tracked})")
    named = rows.agg(sketch.alias("top")).select(F.explode("top").alias("top"))
    named = named.where(F.col("top.count") > 1).select(F.unhex("top.item").alias("_dg"))
    counted = rows.join(F.broadcast(named), "_dg", "left_semi").groupBy("_dg")
    return counted.agg(F.count("*").alias("_size"), F.max(F.struct("_id", "_rid")).alias("_keep")).where("_size > 1")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_dg"), F.monotonically_increasing_id().alias("_rid")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = staged(_keyed(docs, id_col, text_col))
    heavy = staged(heavy_digests(rows, tracked))
    split = rows.join(F.broadcast(heavy), "_dg", "left")
    group = Window.partitionBy("_dg")
    rare = (
        split.where("_size is null")
        .select("_id", "_dg", "_rid")
        .withColumn("_size", F.count("*").over(group))
        .withColumn("_keep", F.max(F.struct("_id", "_rid")).over(group))
    )
    # nulls compare as smallest inside max(struct), so a null id wins only among nulls
    return split.where("_size is not null").select("_id", "_dg", "_rid", "_size", "_keep").unionByName(rare).select(
        F.col("_id").alias(id_col),
        F.col("_keep._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_keep._rid") == F.col("_rid")).alias("kept"),
        F.lower(F.hex("_dg")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """``docs`` without its exact copies; the row with the largest id stays. Columns as they were.

    Digests and ids are grouped, not texts; the rows that lose are anti-joined by digest and id, broadcast where they
    are few. Of rows that agree in text and id, which such a join can't tell apart, one stays.
    """
    rows = staged(_keyed(docs, id_col, text_col))
    heavy = staged(heavy_digests(rows, tracked))
    split = rows.join(F.broadcast(heavy), "_dg", "left")
    rare = split.where("_size is null").groupBy("_dg").agg(F.count("*").alias("_size"), F.max(F.struct("_id", "_rid")).alias("_keep")).where("_size > 1")
    many = heavy.select("_dg", "_keep").unionByName(rare.select("_dg", "_keep"))
    losing = staged(rows.join(staged(many), "_dg").where(F.col("_rid") != F.col("_keep._rid")).select("_dg", "_id", (F.col("_id").eqNullSafe(F.col("_keep._id"))).alias("_tie")))
    gone = staged(losing.where("not _tie").select(F.struct("_dg", "_id").alias("__lx_gone")).distinct())
    key = F.struct(digest(F.col(text_col)).alias("_dg"), F.col(id_col).alias("_id"))
    tagged = docs.withColumn("__lx_key", key)
    kept = tagged.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col("__lx_key").eqNullSafe(F.col("__lx_gone")), "left_anti")
    if losing.where("_tie").limit(1).count():
        kept = kept.withColumn("__lx_rank", F.row_number().over(Window.partitionBy("__lx_key").orderBy(F.lit(0)))).where("__lx_rank = 1")
    return kept.select(*[docs[c] for c in docs.columns])
