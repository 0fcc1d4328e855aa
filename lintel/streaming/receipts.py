"""Streams of receipts and of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lintel.sources.receipts import SCHEMA


def receipts(spark: SparkSession, path: str, files_a_trigger: int = 8) -> DataFrame:
    """Receipts as files arrive. All column functions apply to it unchanged."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def once_per_url(stream: DataFrame, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """The first receipt of each URL within the watermark (a feature of Spark's own)."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["url"])


def windowed_counts(stream: DataFrame, time_col: str, key: str, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by time window and key (a feature of Spark's own)."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    counted = stream.withWatermark(time_col, delay).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_counts(stream: DataFrame, time_col: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    counted = stream.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def settle(samples: DataFrame, key: str = "key", ts_ms: str = "ts_ms", value: str = "fingerprint", stable_ms: int = 1_500, most_ms: int = 30_000) -> DataFrame:
    """Per key, once: when its value had stayed the same long enough (``settled``), or that time ran out (``timeout``).

    State is a value's fingerprint, the time since when it stands, and the start. A timer ends
    a key whose samples stop coming: after ``most_ms`` without the rest it is a ``timeout``. A
    key that is done with is remembered for as long again, so that late samples don't begin it
    anew, and then its state goes. Samples may come in several batches.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since, start, done = state.get if state.exists else (None, 0, -1, False)
        out, last = [], start
        if state.hasTimedOut:
            if not done:
                out.append((k[0], start + most_ms, "timeout"))
                done = True
                state.update((now, since, start, done))
                state.setTimeoutDuration(most_ms)
            else:
                state.remove()
            yield pd.DataFrame(out, columns=["key", "at_ms", "status"])
            return
        for ts, v in pd.concat(list(frames)).sort_values(ts_ms)[[ts_ms, value]].itertuples(index=False):
            if done:
                break
            last = int(ts)
            if start < 0:
                start = last
            if v is None or v != now:
                now, since = v, last
            if now is not None and ts - since >= stable_ms and ts - start < most_ms:
                out.append((k[0], last, "settled"))
                done = True
            elif ts - start >= most_ms:
                out.append((k[0], last, "timeout"))
                done = True
        state.update((now, since, start, done))
        state.setTimeoutDuration(most_ms if done else max(1, most_ms - (last - start)))
        yield pd.DataFrame(out, columns=["key", "at_ms", "status"])

    kind = samples.schema[key].dataType.simpleString()
    chosen = samples.select(F.col(key), F.col(ts_ms).cast("long").alias(ts_ms), F.col(value).cast("string").alias(value))
    return chosen.groupBy(key).applyInPandasWithState(
        step, f"key {kind}, at_ms long, status string", "now string, since long, start long, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def animation_stops(frames: DataFrame, stable_ms: int = 5_000, most_ms: int = 30_000) -> DataFrame:
    """Captures whose frames stand still or run out of time: the same operator over frame digests."""
    digests = frames.select("capture_id", "ts_ms", F.sha2("bytes", 256).alias("fingerprint"))
    return settle(digests, "capture_id", stable_ms=stable_ms, most_ms=most_ms)


def page_settles(samples: DataFrame, least: int = 200, stable_ms: int = 1_000, most_ms: int = 5_000) -> DataFrame:
    """Rendered pages whose text has a stable length of at least ``least`` characters."""
    sized = samples.select("key", "ts_ms", F.when(F.length("text") >= least, F.length("text").cast("string")).alias("fingerprint"))
    return settle(sized, stable_ms=stable_ms, most_ms=most_ms)
