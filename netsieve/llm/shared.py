"""Tables in the folder that all executors share, and small session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a folder of our own, if all tasks run in this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + (own := tempfile.mkdtemp(prefix="netsieve-"))
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Tables:
    """Parquet tables under one fresh sub-folder of the shared folder.

    Writing a table cuts the lineage: a lost executor costs a re-read, not the
    work before it, and a later plan deals its rows anew.
    """

    def __init__(self, spark: SparkSession, prefix: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{prefix}-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)  # the tables serve this application alone

    def write(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession, rows: int = 0, of_partition: int = 1) -> int:
    """The session's number of shuffle partitions, or more if the rows are too many for those."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // of_partition))


#: Bytes of a table that is sent to every executor.
MOST_BYTES = 32 << 20


def broadcast_if_small(table: DataFrame, size: Column, most: int | None = None) -> DataFrame:
    """A written table, marked for broadcast if its rows (``size`` bytes each) were measured to fit ``most`` bytes."""
    total = table.agg(F.coalesce(F.sum(size.cast("long") + ROW_BYTES), F.lit(0))).first()[0]
    return F.broadcast(table) if total <= (MOST_BYTES if most is None else most) else table


#: What a row costs besides its values.
ROW_BYTES = 64


#: Rows of a batch that Spark hands to Python at once, for columns of texts.
TEXT_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to TEXT_ROWS rows.

    Spark counts a batch in rows; the default of 10,000 documents, their words
    and results would all be in a Python worker at once. A lower setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def release() -> None:
    """Give a worker's unused Arrow memory back, which its pool would keep beside the memory of its JVM."""
    pa.default_memory_pool().release_unused()
