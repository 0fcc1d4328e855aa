"""Animation frames: similarity, loops, keyframes; and when a changing thing has come to rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def similarity(a: Column, b: Column) -> Column:
    """Share of equal bytes; 0 for empty frames or different lengths."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: bytes | None, q: bytes | None) -> float:
            if not p or not q or len(p) != len(q):
                return 0.0
            return float(np.mean(np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)))

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def loops(frames: DataFrame, least: int = 3, alike: float = 0.99, static_ms: int = 5_000, total_ms: int = 30_000) -> DataFrame:
    """Per capture: where it loops back to its first frame, stops moving, or runs out; and how many frames stay."""
    order = Window.partitionBy("capture_id").orderBy("idx")
    seen = frames.withColumns({"first": F.first("bytes").over(order), "start": F.first("ts_ms").over(order), "last": F.lag("bytes").over(order)})
    seen = seen.withColumns({"back": similarity(F.col("bytes"), F.col("first")) >= alike, "still": similarity(F.col("bytes"), F.col("last")) >= alike})
    moved = F.max(F.when(~F.col("still"), F.col("ts_ms"))).over(order)
    seen = seen.withColumn("rest_ms", F.col("ts_ms") - F.coalesce(moved, F.col("start")))
    ends = seen.groupBy("capture_id").agg(
        F.count("*").alias("n_frames"),
        F.min(F.when((F.col("idx") >= least) & F.col("back"), F.col("idx"))).alias("loop_at"),
        F.min(F.when(F.col("rest_ms") >= static_ms, F.col("idx"))).alias("static_at"),
        F.min(F.when(F.col("ts_ms") - F.col("start") >= total_ms, F.col("idx"))).alias("timeout_at"),
    )
    stop = F.least("loop_at", "static_at", "timeout_at")
    reason = F.when(stop.isNull(), "end").when(stop == F.col("loop_at"), "loop").when(stop == F.col("static_at"), "static").otherwise("timeout")
    return ends.select("*", reason.alias("reason"), F.coalesce(stop, "n_frames").alias("kept"))


def keyframes(frames: DataFrame) -> DataFrame:
    """First, middle and last frame of captures of three or more."""
    order = Window.partitionBy("capture_id")
    k, n = F.row_number().over(order.orderBy("idx")), F.count("*").over(order)
    named = F.when(F.col("k") == 1, "first").when(F.col("k") == F.floor(F.col("n") / 2) + 1, "middle").when(F.col("k") == F.col("n"), "last")
    return frames.withColumns({"k": k, "n": n}).withColumn("which", named).where("n >= 3 and which is not null").drop("k", "n")


def settled(samples: DataFrame, key: str, ts_ms: str, value: str, stable_ms: int = 1_500, most_ms: int = 30_000) -> DataFrame:
    """Per key: when its value had stayed the same for long enough, or that it never did (batch twin of the stream's operator)."""
    order = Window.partitionBy(key).orderBy(ts_ms)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(order))
    seen = samples.withColumns({"_start": F.first(ts_ms).over(order), "_new": changed.cast("int")}).withColumn("_island", F.sum("_new").over(order))
    since = F.min(ts_ms).over(Window.partitionBy(key, "_island"))
    rested = seen.withColumn("_since", since).where((F.col(ts_ms) - F.col("_since") >= stable_ms) & F.col(value).isNotNull() & (F.col(ts_ms) - F.col("_start") < most_ms))
    first = rested.groupBy(key).agg(F.min(ts_ms).alias("settled_ms"))
    return samples.groupBy(key).agg(F.count("*").alias("n_samples"), F.min(ts_ms).alias("start_ms")).join(first, key, "left").withColumn("status", F.when(F.col("settled_ms").isNotNull(), "settled").otherwise("timeout"))
