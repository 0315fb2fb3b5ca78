"""Tables in the shared folder: how lineage is cut and results are handed on.

Executors can be lost, so nothing is kept in executor memory or in a
machine-local folder: an intermediate that is read more than once is written
as Parquet under ``spark.checkpoint.dir`` and read back.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lexforge-"))
    return f"{base.rstrip('/')}/lexforge-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it (its path in ``.shared_path``)."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.shared_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote, once nothing lazy reads it any more."""
    if path := getattr(df, "shared_path", None):
        delete(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced.

    The Python side lets go first; the cleaner then works in a thread of its own,
    and what it frees can free more.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def text_marks(text: Column) -> list[Column]:
    """A 128-bit hash of a text: with the id it names a row, and rows that share both are the same to any dedup."""
    return [F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
