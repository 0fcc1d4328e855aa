"""Batch configurations: load, merge with defaults, validate, build from addresses; retry schedules."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.functions.urls import bare_host

FIELDS = "url string, title string, language string, archivePath string, markdownFile string, screenshotLightFile string, screenshotDarkFile string, imagesDir string, hasLocalImages boolean, expectedFigures int, format string"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles with ``id``, defaults) of JSON configurations at ``path``."""
    kind = f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>"
    read = spark.read.schema(f"articles map<string,{kind}>, defaults {kind}").json(path, multiLine=True)
    return read.select(F.explode("articles").alias("id", "a")).select("id", "a.*"), read.select("defaults.*").limit(1)


def with_defaults(articles: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each field of an article, or else the default's: one row of defaults is broadcast."""
    own = [c for c in articles.columns if c != "id"]
    row = defaults.limit(1).select(*[F.col(c).alias(f"_d_{c}") for c in own if c in defaults.columns])
    both = articles.join(F.broadcast(row), F.lit(True), "left")
    return both.select("id", *[F.coalesce(c, f"_d_{c}").alias(c) if c in defaults.columns else F.col(c) for c in own])


def article(articles: DataFrame, defaults: DataFrame, wanted: str) -> DataFrame:
    """One article; an unknown id gives a row with the known ids in ``error`` instead of ending the job."""
    asked = articles.sparkSession.createDataFrame([(wanted,)], "id string")
    ids = articles.agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("ids"))
    found = asked.join(with_defaults(articles, defaults).withColumn("_found", F.lit(True)), "id", "left").join(F.broadcast(ids), F.lit(True))
    return found.withColumn("error", F.when(F.col("_found").isNull(), F.concat(F.lit("Unknown article: "), "id", F.lit(". Available: "), "ids"))).drop("_found", "ids")


def from_urls(urls: DataFrame, url_col: str = "url", ord_col: str = "ord") -> DataFrame:
    """Articles numbered by place, each with an archive folder of its host and number."""
    number = (F.col(ord_col) + 1).cast("string")
    folder = F.concat(F.lit("archive/"), F.replace(bare_host(F.col(url_col)), F.lit("."), F.lit("-")), F.lit("/"), number)
    return urls.select(number.alias("id"), F.col(url_col).alias("url"), folder.alias("archivePath"))


def errors(articles: DataFrame) -> DataFrame:
    """(id, error) for articles without an address or with a bad one; a configuration with no article has one error of its own."""
    bad = articles.select("id", F.when(F.coalesce("url", F.lit("")) == "", "missing url").when(F.try_parse_url("url", F.lit("HOST")).isNull(), "invalid url").alias("error")).where("error is not null")
    empty = articles.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("id"), F.lit("no articles").alias("error"))
    return bad.unionByName(empty)


def retry_delays(retries: Column, base_ms: Column, most_ms: int = 30_000) -> Column:
    """Delays before each retry: doubling, up to a bound."""
    return F.when(retries > 0, F.transform(F.sequence(F.lit(0), retries - 1), lambda k: F.least(base_ms * F.pow(F.lit(2.0), k), F.lit(float(most_ms))).cast("long"))).otherwise(F.array().cast("array<bigint>"))


# ---- options ---------------------------------------------------------------------------------

#: What an animation's options are where they aren't given.
ANIMATION = {"maxSize": 1024, "interval": 0, "minFrames": 120, "loopTimeout": 60, "similarity": 0.99, "captureMode": "screenshot"}


def animation_options(requests: DataFrame, defaults: dict | None = None) -> DataFrame:
    """``requests`` with ``error`` for a format that isn't known, and each option as a number, or its default where it is none or 0."""
    given = {**ANIMATION, **(defaults or {})}
    form = F.lower(F.coalesce(F.nullif(F.col("format"), F.lit("")), F.lit("gif"))) if "format" in requests.columns else F.lit("gif")
    error = F.when(~form.isin("gif", "png-sequence"), F.lit('Invalid `format`: must be "gif" or "png-sequence"'))

    def option(name: str, value: object) -> Column:
        if name not in requests.columns:
            return F.lit(value)
        text = F.col(name).cast("string")
        if isinstance(value, str):
            return F.coalesce(F.nullif(text, F.lit("")), F.lit(value))
        whole = isinstance(value, int)
        number = F.regexp_extract(text, r"^\s*([+-]?\d+)" if whole else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
        read = F.nullif(number, F.lit("")).cast("long" if whole else "double")
        return F.coalesce(F.nullif(read, F.lit(0).cast("long" if whole else "double")), F.lit(value))

    keyframes = F.coalesce(F.col("extractKeyframes").cast("string") == "true", F.lit(False)) if "extractKeyframes" in requests.columns else F.lit(False)
    return requests.withColumns({"error": error, "format": form, **{k: option(k, v) for k, v in given.items()}, "extractKeyframes": keyframes})


def snake_keys(value: object) -> object:
    """Keys of open JSON in snake case, at every depth."""
    if isinstance(value, list):
        return [snake_keys(x) for x in value]
    if isinstance(value, dict):
        return {re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), k): snake_keys(v) for k, v in value.items()}
    return value


def snake_json(c: Column) -> Column:
    """JSON text with its keys in snake case; what isn't JSON is null."""

    def convert(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return json.dumps(snake_keys(json.loads(x)), ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return F.pandas_udf(convert, "string")(c)


def snake_columns(df: DataFrame) -> DataFrame:
    """Top-level and nested fields of a table in snake case: a cast, nothing is computed."""

    def renamed(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(snake(f.name), renamed(f.dataType), f.nullable) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(renamed(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(t.keyType, renamed(t.valueType), t.valueContainsNull)
        return t

    snake = lambda name: re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), name)
    return df.select(*[F.col(f"`{f.name}`").cast(renamed(f.dataType)).alias(snake(f.name)) for f in df.schema.fields])


@dataclass(frozen=True)
class EngineOptions:
    """What a capture is asked for; ``from_env`` reads what isn't given from variables named after the fields."""

    engine: str = "puppeteer"
    format: str = "markdown"
    output: str | None = None
    data_dir: str = "./data"
    embed_images: bool = False
    extract_images: bool = True
    keep_original_links: bool = False
    local_images: bool = True
    document_format: str = "markdown"
    api_token: str | None = None

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "LINTEL_", **given) -> EngineOptions:
        read = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None and given.get(f.name) is None:
                read[f.name] = raw.lower() in ("1", "true", "yes") if f.type == "bool" else raw
        return cls(**{**read, **{k: v for k, v in given.items() if v is not None}})
