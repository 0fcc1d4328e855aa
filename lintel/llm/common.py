"""What the operators of this subpackage share: staged tables, word splitting, row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII characters that are no part of an alphanumeric word: all but 0-9, A-Z and a-z.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: The largest table, in rows, that an operator of this package broadcasts.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset one of our own, but only if
    there is one machine: executors elsewhere wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lintel-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


#: While a table is staged: a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage,
#: and texts go to Python in batches of megabytes.
WHILE_STAGED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def staged(df: DataFrame) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read again.

    Cuts the lineage like ``checkpoint()``, survives the loss of executors, is
    computed once however often it is read, and keeps column pruning. The shuffle
    files of its computation go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lintel-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WHILE_STAGED}
    for k, v in WHILE_STAGED.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[id(out)] = (weakref.ref(out), path)
    return out


_STAGED: dict[int, tuple[weakref.ref, str]] = {}


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``staged`` wrote for these tables; nothing that is still to be computed may read them."""
    for df in tables:
        ref, path = _STAGED.pop(id(df), (lambda: None, ""))
        if ref() is df:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

    One ``translate`` turns separators into spaces, so the split needs no regular expression.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bernoulli_fold(column: Column, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``."""
    return F.crc32(column.cast("string").cast("binary")) % parts
