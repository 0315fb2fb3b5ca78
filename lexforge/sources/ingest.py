"""CSV and JSON scans as string columns with the line order kept, and their contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions import classify
from lexforge.functions.text import blank, first_filled, strip
from lexforge.operators import checks, splits


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as text, quoted cells over several lines, and ``line_no`` in file order.

    The columns are the header's, stated by the caller, so no pass is spent on
    inferring them. ``line_no`` grows with the place in the input; it is not dense.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return rows.withColumn("line_no", F.monotonically_increasing_id() + 1)


def examples(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(id, prompt, answer, category, line_no): empty answers are null, categories come from the prompt's template."""
    answer = F.nullif("answer", F.lit("")) if "answer" in rows.columns else F.lit(None).cast("string")
    return rows.select("id", "prompt", answer.alias("answer"), classify.category(F.col("prompt"), strict).alias("category"), "line_no")


def sft_examples(rows: DataFrame, trace_column: str = "generated_cot", label: bool = True, source: str | None = None) -> DataFrame:
    """Training rows: category from its column, the label or the prompt; source mode ``unknown`` where none is given."""
    def text(name: str):
        return F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit("")

    labels = [text("category"), text("label")] if label else [text("category")]
    category = F.coalesce(first_filled(*labels), classify.category(F.col("prompt"), strict=False))
    return rows.select(
        strip(F.col("id")).alias("id"), "prompt", "answer", text(trace_column).alias("generated_cot"), text("assistant_content").alias("assistant_content"), category.alias("category"),
        first_filled(text("source_mode"), F.lit("unknown")).alias("source_mode"), F.lit(source).alias("source") if source else text("source").alias("source"),
        classify.eval_eligible(text("source_mode"), text("eval_eligible")).alias("eval_eligible"), text("split_policy").alias("split_policy"), "line_no",
    )


def problems(rows: DataFrame, required: tuple[str, ...] = ("id", "prompt", "answer")) -> DataFrame:
    """(line, column) of blank required cells, and duplicate ids as column ``duplicate id``."""
    lone = checks.duplicates(rows, "id").select("id")
    again = rows.join(lone, "id", "left_semi").select((F.col("line_no") + 1).alias("line"), F.lit("duplicate id").alias("column"))
    return checks.required(rows, list(required)).unionByName(again)


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one question type; storage partitioned by category prunes to it."""
    slug = kind if kind in classify.CATEGORY_OF_TYPE else classify.TYPE_ALIASES.get(kind.strip().lower().replace("-", "_").replace(" ", "_"), kind)
    if slug not in classify.CATEGORY_OF_TYPE:
        raise ValueError(f"Unknown question type {kind!r}; one of {', '.join(sorted(classify.CATEGORY_OF_TYPE))}")
    return rows.filter(F.col("category") == classify.CATEGORY_OF_TYPE[slug])


def assignments_csv(spark: SparkSession, path: str, columns: list[str] = ["id", "split"]) -> DataFrame:  # noqa: B006
    """(id, split) of a CSV file; a blank id, a blank split or an id that comes twice is an error."""
    made = read_csv(spark, path, columns).select(strip(F.col("id")).alias("id"), strip(F.col("split")).alias("split"))
    checks.assert_none(splits.assignment_problems(made), f"split assignments {path}")
    return made


def assignments_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, split) of a JSON file, under the same contract."""
    made = splits.from_json(spark.read.text(path, wholetext=True))
    checks.assert_none(splits.assignment_problems(made), f"split assignments {path}")
    return made


def prepared(rows: DataFrame) -> DataFrame:
    """rows with their diagnostic type and subtype, and the flags as text."""
    trace = F.concat_ws("\n", F.coalesce("generated_cot", F.lit("")), F.coalesce("assistant_content", F.lit("")))
    kind = F.coalesce(*[F.when(F.col("category") == c, F.lit(t)) for t, c in classify.CATEGORY_OF_TYPE.items()], F.lit("transformation_rules_unknown"))
    only = classify.train_only(F.col("source_mode"), F.col("eval_eligible").cast("string"), F.col("split_policy"))
    return rows.withColumn("diagnostic_subtype", classify.subtype(F.col("category"), F.col("source"), F.col("source_mode"), trace)).withColumns(
        {"diagnostic_type": kind, "split_policy": F.when(only, "train_only").otherwise("holdout_ok")}
    )


def write_types(rows: DataFrame, path: str) -> None:
    """All types in one job, a folder each."""
    rows.write.mode("overwrite").partitionBy("diagnostic_type").parquet(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)
