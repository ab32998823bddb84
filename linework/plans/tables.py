"""Written intermediate tables, so that lineage is short and a lost executor costs one stage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; Spark's file system removes it when the driver ends."""
    path = f"{shared_dir(spark)}/linework-{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def small_batches(spark: SparkSession, n: int = 16 << 20) -> None:
    """Let batches that go to Python end at ``n`` bytes where the session sets no limit; Spark's own is 64 MiB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, n)


def give_back() -> None:
    """Return freed memory to the system; an idle worker would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back."""
    path = new_path(df.sparkSession, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """Write ``df`` in buckets of ``column`` to the shared folder, without a shuffle, and read it back: what
    is grouped or joined by that column then stays where it is. The catalog keeps no entry of it."""
    spark = df.sparkSession
    name = f"linework_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column)
    writer.option("path", new_path(spark, label)).saveAsTable(name)
    found = spark.table(name)  # its plan holds the folder and the buckets from here on
    spark.sql(f"DROP TABLE {name}")
    return found
