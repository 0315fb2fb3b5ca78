"""Accuracy reports, histograms and failure samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import scoring


def score(rows: DataFrame, raw: str = "raw_prediction", gold: str = "answer") -> DataFrame:
    """rows with ``extracted`` and ``correct``."""
    told = rows.withColumn("extracted", scoring.answer(F.col(raw)))
    return told.withColumn("correct", scoring.matches(F.col("extracted"), F.col(gold)))


def accuracy(correct: str = "correct") -> list[Column]:
    total, right = F.count("*"), F.count_if(F.col(correct))
    return [total.alias("total"), right.alias("correct"), F.coalesce(F.try_divide(right.cast("double"), total), F.lit(0.0)).alias("accuracy")]


def by_category(scored: DataFrame, category: str = "category") -> DataFrame:
    """Totals for each category and, with a null category, over all."""
    return scored.rollup(category).agg(*accuracy(), F.grouping(category).alias("is_total"))


def by_type(scored: DataFrame, kind: str, sub: str, mode: str) -> DataFrame:
    """type and subtype totals (rollup) with a histogram of source modes as "mode=n" in order of mode."""
    modes = scored.groupBy(kind, sub, mode).agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(mode, "n"))), lambda s: F.concat_ws("=", s[mode], s["n"].cast("string"))), ",")
    pairs = modes.groupBy(kind, sub).agg(F.sum("n").alias("total"), F.sum("right").alias("correct"), listed.alias("modes"), F.lit(1).alias("level"))
    kinds = modes.groupBy(kind, mode).agg(F.sum("n").alias("n"), F.sum("right").alias("right")).groupBy(kind).agg(
        F.lit(None).cast("string").alias(sub), F.sum("n").alias("total"), F.sum("right").alias("correct"), listed.alias("modes"), F.lit(0).alias("level")
    )
    return kinds.select(pairs.columns).unionByName(pairs).withColumn("accuracy", F.col("correct") / F.col("total"))


def failures(scored: DataFrame, groups: list[str], order: str, k: int = 3) -> DataFrame:
    """The first k wrong rows of each group, with their place."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    return scored.filter(~F.col("correct")).withColumn("place", place).filter(F.col("place") <= k)


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of every listed value, 0 where it does not occur, and of all others that do."""
    spark = rows.sparkSession
    seeds = spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return seeds.join(counted, column, "full").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def histograms(rows: DataFrame, columns: list[str], cross: tuple[str, str] | None = None) -> DataFrame:
    """Independent counts of several columns in one pass: (column, value, value2, n)."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit(None).cast("string").alias("value2")) for c in columns]
    if cross:
        a, b = cross
        cells.append(F.struct(F.lit(f"{a}*{b}").alias("column"), F.col(a).cast("string").alias("value"), F.col(b).cast("string").alias("value2")))
    cells.append(F.struct(F.lit("all").alias("column"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("value2")))
    return rows.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.column", "c.value", "c.value2").agg(F.count("*").alias("n"))
