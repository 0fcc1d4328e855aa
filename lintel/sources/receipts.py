"""Receipts: tables of captured responses, as a plain scan or through a caller's transport."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "receipt_id long, url string, final_url string, status int, headers map<string,string>, body binary, outcome string, error_kind string, error string"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def kind_of(error: Exception) -> str:
    if isinstance(error, TimeoutError):
        return "timeout"
    return "cancelled" if isinstance(error, InterruptedError) else "cors_or_transport" if isinstance(error, TypeError) else "transport"


class _Part(InputPartition):
    def __init__(self, first: int, urls: list[str]):
        self.first, self.urls = first, urls


class ReceiptReader(DataSourceReader):
    """One row a URL. What the transport raises becomes the row's error, never the job's."""

    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.parts = max(1, int(options.get("numPartitions", "4")))
        self.transport = options.get("transport", "")

    def partitions(self) -> list[_Part]:
        size = -(-max(1, len(self.urls)) // self.parts)
        return [_Part(k, self.urls[k : k + size]) for k in range(0, max(1, len(self.urls)), size)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        call: Callable[[str], dict] = cloudpickle.loads(base64.b64decode(self.transport))
        for k, url in enumerate(partition.urls):
            try:
                r = call(url)
                yield (partition.first + k, url, r.get("final_url", url), int(r.get("status", 200)), dict(r.get("headers") or {}), bytes(r.get("body") or b""), "response", None, None)
            except Exception as e:  # noqa: BLE001
                yield (partition.first + k, url, None, None, {}, None, "error", kind_of(e), str(e))


class ReceiptSource(DataSource):
    """``spark.read.format("receipts")`` with options ``urls`` (one a line), ``transport`` (see ``portable``) and ``numPartitions``."""

    @classmethod
    def name(cls) -> str:
        return "receipts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReceiptReader:  # noqa: ANN001
        return ReceiptReader(dict(self.options))


def portable(transport: Callable[[str], dict]) -> str:
    """A transport (URL to a dict of final_url, status, headers, body) as an option's value."""
    return base64.b64encode(cloudpickle.dumps(transport)).decode()


RECEIPT = "final_url string, status int, headers map<string,string>, body binary, outcome string, error_kind string, error string"


def fetch(urls: DataFrame, transport: Callable[[str], dict], url_col: str = "url") -> DataFrame:
    """``urls`` with a receipt for each row, through a caller's transport (URL to a dict of final_url, status, headers, body).

    The URLs stay where they are: any number of them, no list goes through the driver."""
    call = portable(transport)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask: Callable[[str], dict] = cloudpickle.loads(base64.b64decode(call))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # bodies may be large
                part = batch.slice(at, 64)
                rows = [_asked(ask, u) for u in part.column(batch.schema.get_field_index(url_col)).to_pylist()]
                made = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("final_url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("outcome", pa.string()), ("error_kind", pa.string()), ("error", pa.string())]))
                yield pa.RecordBatch.from_arrays([*part.columns, *made.columns], names=[*part.schema.names, *made.schema.names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return urls.mapInArrow(run, f"{own}, {RECEIPT}")


def _asked(ask: Callable[[str], dict], url: str | None) -> dict:
    try:
        r = ask(url)
        return {"final_url": r.get("final_url", url), "status": int(r.get("status", 200)), "headers": list((r.get("headers") or {}).items()), "body": bytes(r.get("body") or b""), "outcome": "response"}
    except Exception as e:  # noqa: BLE001
        return {"headers": [], "outcome": "error", "error_kind": kind_of(e), "error": str(e)}


def routed(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``route`` and ``fetch_url``: files kept at a drive (their download), questions (their print view), all
    others as they are."""
    from lintel.functions import urls as U

    drive, question = U.drive_download_url(F.col(url_col)), U.question_print_url(F.col(url_col))
    route = F.when(drive.isNotNull(), "drive_image").when(question.isNotNull(), "question").otherwise("page")
    return urls.withColumns({"route": route, "fetch_url": F.coalesce(drive, question, F.col(url_col))})


def page_html(receipts: DataFrame, url_col: str = "url") -> DataFrame:
    """The HTML of routed receipts: a drive's image is a page that shows it, all else the decoded body."""
    from lintel.functions import urls as U

    kind = F.lower(F.coalesce(F.element_at("headers", "content-type"), F.lit("")))
    image = (F.col("route") == "drive_image") & F.startswith(kind, F.lit("image/"))
    return receipts.withColumn("html", F.when(image, U.drive_page_html(F.col(url_col))).otherwise(decoded(F.col("body"), kind)))


def text_only(receipts: DataFrame) -> DataFrame:
    """Receipts of text types, decoded by their charset."""
    kind = F.lower(F.coalesce(F.element_at("headers", "content-type"), F.lit("")))
    return receipts.where(F.contains(kind, F.lit("text/"))).withColumn("text", decoded(F.col("body"), kind))


def decoded(body: Column, content_type: Column) -> Column:
    """The body as text: UTF-8 unless one of the other known charsets is named."""
    charset = F.lower(F.regexp_extract(content_type, r"(?i)charset=[\"']?([\w.-]+)", 1))
    out = F.make_valid_utf8(body.cast("string"))
    return F.when(charset.isin("iso-8859-1", "latin1"), F.decode(body, "ISO-8859-1")).when(charset.isin("utf-16", "utf16"), F.decode(body, "UTF-16")).otherwise(out)


def proxied(receipts: DataFrame) -> DataFrame:
    """Status, headers and bytes as a proxy passes them on."""
    from lintel.functions.predicates import proxy_headers

    return receipts.select("url", "status", proxy_headers(F.col("headers"), keep_length=True).alias("headers"), "body")


def write_routed(df: DataFrame, path: str, url_col: str = "url") -> None:
    """Parquet in folders by host."""
    from lintel.functions.urls import host

    df.withColumn("host", host(F.col(url_col))).write.partitionBy("host").mode("overwrite").parquet(path)
