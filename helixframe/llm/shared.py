"""Helpers that several operators share: staged tables, shared files, document order.

Staged tables and files live in the folder named by ``spark.checkpoint.dir``, which the
driver and all executors reach.  Nothing is kept in a machine-local folder, so a lost
executor costs only the recomputation of its unfinished tasks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch of texts: bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = "400", "8m"
SEPARATORS = r"[\x20\x09-\x0D]+"
MIN_LONG = -(2**63)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged data; a folder of our own only on one machine where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "helixframe-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame | None) -> None:
    """Delete what ``stage`` wrote for a table that no later plan reads (through Hadoop's file system, so on any store)."""
    for file in df.inputFiles()[:1] if df is not None else ():
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def broadcast(spark: SparkSession, value):
    """A broadcast variable, for values of a bounded size."""
    return spark.sparkContext.broadcast(value)


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of the id's text leaves ``remainder`` (a null id counts as text '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


# --- shared files -------------------------------------------------------------------------


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class AtomicFile:
    """A file that appears under its name only when it is complete, so retried tasks are harmless."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{name}"
        self.temp = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.path


# --- order of documents -------------------------------------------------------------------


def order_bounds(df: DataFrame, key: str, n: int) -> tuple[int | None, list[int]]:
    """(smallest key, ascending distinct split values, at most n - 1): values of the key itself.

    One row reaches the driver, of a size bounded by the number of partitions.
    """
    if n < 2:
        return df.agg(F.min(key)).first()[0], []
    q = [i / n for i in range(1, n)]
    low, cuts = df.agg(F.min(key), F.percentile_approx(key, q, 10_000)).first()
    return low, sorted({c for c in (cuts or []) if c > low})
