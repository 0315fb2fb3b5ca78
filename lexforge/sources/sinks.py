"""Files that people and other programs read: CSV, JSON, sample trees and manifests, on any store that Spark knows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import evaluate

MANIFEST = ("problem_id", "category", "source_mode", "answer", "source_column", "trace_path")


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced if it is there."""
    target, fs = _target(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    target, fs = _target(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(target) else None


def write_json(spark: SparkSession, path: str, payload: object) -> None:
    """A summary, indented by two, characters as they are."""
    write_text(spark, path, json.dumps(payload, indent=2, ensure_ascii=False) + "\n")


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in their order under a header, lines ended by LF, quotes doubled; a part for each task."""
    own = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields])
    own.write.mode("overwrite").csv(path, header=True, lineSep="\n", quote='"', escape='"', emptyValue="", nullValue="")


def write_manifest(traces: DataFrame, path: str) -> None:
    """The trace records' manifest: where each problem's trace stands."""
    write_csv(traces.withColumn("trace_path", F.col("path")), path, list(MANIFEST))


def write_failures(samples: DataFrame, path: str) -> int:
    """The tree of failure samples, a JSON and a text file each; an older tree at this path goes first. Returns the number of samples.

    Samples are a few for each type and subtype, and pass the driver one at a time.
    """
    spark = samples.sparkSession
    target, fs = _target(spark, path)
    fs.delete(target, True)
    n = 0
    for r in samples.toLocalIterator():
        base = f"{path.rstrip('/')}/{r.folder}/{r.stem}"
        write_json(spark, f"{base}.json", {c: r[c] for c in evaluate.RECORD})
        write_text(spark, f"{base}.txt", r.text)
        n += 1
    return n
