"""What several operators share: tables in the shared folder, and Arrow helpers for tasks."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.session import shared_dir

#: A task hands at most about this many bytes of text or ids to Spark in one Arrow batch.
BATCH_BYTES = 8 << 20
#: Rows of whole texts that Spark hands to a task in one Arrow batch, and about how many bytes at most (one row at least).
BATCH_ROWS, BATCH_SIZE = 2500, "32m"
#: Spark's setting that deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession) -> str:
    """A new place for a table in the shared folder."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost
    executor costs only the tasks that reread it. What the write shuffled is deleted when it is done."""
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, codec: str = "zstd") -> DataFrame:
    """stored(), in as many buckets of the column as there are shuffle partitions: joins on it don't move the table."""
    spark, name = df.sparkSession, f"meterloom_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", codec).option("path", scratch_path(spark)).bucketBy(n, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, only the name goes
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def portions(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose named column holds at most about limit bytes (one row at least)."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if batch.column(column).nbytes <= limit:
            if n:
                yield batch
            continue
        sizes = [len(x or b"") for x in text_bytes(batch.column(column))]
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + sizes[end] <= limit):
                total += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end
    release_pages()


def release_pages() -> None:
    """Give back what Arrow's pool and the C library keep for later: a worker that waits beside others needs none of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_memory() -> None:
    """Give back what this process no longer uses: objects in cycles (with what they hold in the JVM), then free pages."""
    gc.collect()
    release_pages()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Rows of whole texts go to Python in smaller batches than narrow rows could; a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_SIZE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python worker, so that later tasks find what earlier ones built."""
    home = sys.modules.setdefault("_meterloom_process_cache", types.ModuleType("_meterloom_process_cache"))
    return home.__dict__.setdefault(f"cache {name}", {})
