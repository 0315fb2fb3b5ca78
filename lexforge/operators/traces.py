"""Trace records, their export as files and the check of files against records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.classify import slugify
from lexforge.functions.text import blank, strip


def records(rows: DataFrame) -> DataFrame:
    """(problem_id, category, source_mode, answer, source_column, text, path) of each row that has a trace."""
    columns = ("generated_cot", "assistant_content")
    filled = [F.when(strip(F.coalesce(F.col(c), F.lit(""))) != "", F.struct(F.lit(c).alias("source_column"), F.concat(strip(F.col(c)), F.lit("\n")).alias("text"))) for c in columns]
    have = rows.withColumn("_t", F.coalesce(*filled)).filter("_t IS NOT NULL")
    path = F.concat_ws("/", slugify(F.coalesce(F.col("category"), F.lit("unknown"))), F.concat(F.col("id").cast("string"), F.lit(".txt")))
    answer = F.col("answer") if "answer" in rows.columns else F.lit(None).cast("string")
    return have.select(F.col("id").alias("problem_id"), "category", "source_mode", answer.alias("answer"), "_t.source_column", "_t.text", path.alias("path"))


def problems(rows: DataFrame) -> DataFrame:
    """(problem, id) of rows that can't be exported: a blank id, an id that comes twice, no trace."""
    told = lambda df, what: df.select(F.lit(what).alias("problem"), F.col("id").cast("string").alias("id"))
    bare = rows.filter(blank(F.col("generated_cot")) & blank(F.col("assistant_content")))
    twice = rows.filter(~blank(F.col("id").cast("string"))).groupBy("id").count().filter("count > 1")
    return told(rows.filter(blank(F.col("id").cast("string"))), "blank id").unionByName(told(twice, "duplicate id")).unionByName(told(bare, "no trace"))


def check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, issue) of files that are missing, differ or are extra."""
    a, b = expected.select("path", "text").alias("a"), found.select("path", "text").alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    issue = F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "extra").when(~F.col("a.text").eqNullSafe(F.col("b.text")), "differs")
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), issue.alias("issue")).filter("issue IS NOT NULL")


def export(traces: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write records as Parquet by category; a second export of the same is no change, a different one needs ``overwrite``.

    Returns the issues that were found before writing.
    """
    spark = traces.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    issues = check(traces, spark.read.parquet(path)) if there else traces.select("path", F.lit("missing").alias("issue"))
    if there and not overwrite and issues.filter("issue = 'differs'").limit(1).count():
        raise ValueError(f"{path} holds other traces; overwrite=True replaces them")
    if not there or overwrite:
        traces.write.mode("overwrite").partitionBy("category").parquet(path)
    return issues


def write_files(traces: DataFrame, path: str, overwrite: bool = False) -> tuple[int, DataFrame]:
    """A file for each trace under ``path``; (files written, the paths that hold another text and were left).

    Files are compared first, so a second run writes nothing. Tasks write into a staging
    folder whose commit is Spark's own: what a failed or repeated task wrote is not there. Then
    whole files are moved to their places, one metadata operation each; a run that ends
    between moves is completed by the next one.
    """
    spark = traces.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(root)
    for old in fs.globStatus(hadoop.Path(root, "_staging-*")):
        fs.delete(old.getPath(), True)
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    issues = check(traces, directory(spark, path)).filter("issue <> 'extra'")
    left = issues.filter("issue = 'differs'").select("path")
    todo = issues if overwrite else issues.filter("issue = 'missing'")
    # The writer ends a row with a line break, which a trace's text has already.
    rows = traces.join(todo.select("path"), "path").select(F.sha2("path", 256).alias("_name"), F.regexp_replace("text", "\n$", "").alias("value"), "path")
    chosen = rows.groupBy("_name").agg(F.max_by(F.struct("value", "path"), "path").alias("r")).select("_name", "r.value", "r.path")
    chosen.write.parquet(f"{staging}/rows")
    held = spark.read.parquet(f"{staging}/rows")
    held.select("_name", "value").write.partitionBy("_name").text(f"{staging}/files")
    n = 0
    for r in held.select("_name", "path").toLocalIterator():
        target = hadoop.Path(root, r.path)
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        made = fs.globStatus(hadoop.Path(f"{staging}/files/_name={r._name}/part-*"))
        if not fs.rename(made[0].getPath(), target):
            raise OSError(f"{r.path} could not be moved to its place")
        n += 1
    fs.delete(hadoop.Path(staging), True)
    return n, left


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the text files under a folder, with paths relative to it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    root = path.split("://")[-1].rstrip("/") + "/"
    # Paths come as URIs, in which a plus sign stands for itself.
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(F.substring_index(whole, root, -1).alias("path"), F.col("value").alias("text"))
