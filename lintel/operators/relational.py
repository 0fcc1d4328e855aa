"""Relational forms that page operators are made of, over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: str, order: str, same: str) -> DataFrame:
    """Neighbouring rows of one kind get one island number."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = (~F.col(same).eqNullSafe(F.lag(same).over(w))) | (F.row_number().over(w) == 1)
    return rows.withColumn("_fresh", fresh.cast("int")).withColumn("island", F.sum("_fresh").over(w)).drop("_fresh")


def neighbours(rows: DataFrame, key: str, order: str, value: str, empty: Column) -> DataFrame:
    """The nearest values before and after that aren't empty."""
    w = Window.partitionBy(key).orderBy(order)
    shown = F.when(~empty, F.col(value))
    before = F.last(shown, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(shown, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"previous": before, "next": after})


def first_of(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def running_numbers(lists: DataFrame, key: str, order: str, items: str, start: str) -> DataFrame:
    """Lists that count on from each other; an explicit start begins anew."""
    w = Window.partitionBy(key).orderBy(order)
    group = F.sum(F.col(start).isNotNull().cast("int")).over(w)
    inner = Window.partitionBy(key, "_g").orderBy(order)
    counted = lists.withColumn("_g", group)
    base = F.coalesce(F.first(start).over(inner), F.lit(1))
    before = F.coalesce(F.sum(items).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("first_number", base + before).drop("_g")


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points within [start, end): ranges are dealt to buckets of ``width``, so an equality joins them and the range is checked after."""
    dealt = ranges.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = points.withColumn("_bucket", F.floor(F.col(point) / width))
    return placed.join(dealt, "_bucket").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bucket")


def histogram(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
