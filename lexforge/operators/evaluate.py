"""Keyed evaluation: examples joined to predictions and row metadata, records, summaries and failure samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import classify, render
from lexforge.functions.text import first_filled, map_lookup, strip
from lexforge.operators import checks, reports, splits

#: What the metadata may say of a row; columns that are not there are empty.
METADATA = ("category", "label", "source", "source_mode", "diagnostic_type", "diagnostic_subtype", "generated_cot", "assistant_content")
RECORD = (
    "id", "category", "question_type", "question_type_display", "diagnostic_subtype", "source_mode", "source",
    "gold_answer", "extracted_prediction", "correct", "prompt", "raw_prediction",
)


def question_type(diagnostic_type: Column, category: Column, own_category: Column, source: Column, label: Column) -> Column:
    """The type slug of a row: as told, by its category, by words of its source or label, else a label made of the category."""
    told, source, label = strip(diagnostic_type), F.lower(source), F.lower(label)
    return (
        F.when(told.isin(*classify.CATEGORY_OF_TYPE), told)
        .when(category.isin(*classify.TYPE_OF_CATEGORY), map_lookup(category, classify.TYPE_OF_CATEGORY))
        .when(source.contains("numeric_equation_transformation_rules") | label.contains("numeric equation"), "numeric_equation")
        .when(source.contains("symbol_equation_transformation_rules") | source.contains("symbol_transform") | label.contains("symbol transform"), "symbol_transform")
        .when(own_category == "Transformation Rules", "transformation_rules_unknown")
        .otherwise(classify.safe_label(category))
    )


def diagnostic_subtype(told: Column, kind: Column, category: Column, source: Column, mode: Column, trace: Column) -> Column:
    """The subtype of a row: as told, else classified for rows of a known type, else unknown."""
    of_type = first_filled(category, map_lookup(kind, classify.CATEGORY_OF_TYPE))
    return F.when(strip(told) != "", strip(told)).when(kind.isin(*classify.CATEGORY_OF_TYPE), classify.subtype(of_type, source, mode, trace)).otherwise("unknown")


def display(kind: Column, category: Column) -> Column:
    """A known type's display name, else the category, else the type itself."""
    return F.coalesce(map_lookup(kind, classify.CATEGORY_OF_TYPE), F.nullif(category, F.lit("")), kind)


def with_metadata(examples: DataFrame, metadata: DataFrame, order: str = "line_no") -> DataFrame:
    """Examples with the columns METADATA of their id's last row, empty where there is none: ``m_<name>``."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"m_{c}") if c in metadata.columns else F.lit("").alias(f"m_{c}") for c in METADATA]
    last = checks.last_per_id(metadata.select("id", *told, F.col(order).alias("_order")), "id", "_order").drop("_order")
    joined = examples.join(last, "id", "left")
    return joined.withColumns({f"m_{c}": F.coalesce(f"m_{c}", F.lit("")) for c in METADATA})


def records(examples: DataFrame, predictions: DataFrame, metadata: DataFrame, key: tuple[str, ...] = ("id",), order: str = "line_no") -> DataFrame:
    """One evaluation record for each example with a prediction under the same key.

    Positions never decide: a prediction belongs to the example of its key, which
    must be unique among predictions. An example without a prediction has a null
    one, scored as not found.
    """
    told = predictions.select(*key, "raw_prediction")
    rows = with_metadata(examples.join(told, list(key), "left"), metadata, order)
    scored = reports.score(rows)
    category = classify.row_category(F.col("m_category"), F.col("m_label"), F.col("category"))
    label = first_filled(F.col("m_label"), F.col("m_category"))
    kind = question_type(F.col("m_diagnostic_type"), category, F.coalesce("category", F.lit("")), F.col("m_source"), F.coalesce(label, F.lit("")))
    trace = F.concat_ws("\n", "m_generated_cot", "m_assistant_content")
    typed = scored.withColumn("_category", category).withColumn("question_type", kind)
    sub = diagnostic_subtype(F.col("m_diagnostic_subtype"), F.col("question_type"), F.col("m_category"), F.col("m_source"), F.col("m_source_mode"), trace)
    return typed.select(
        "id", F.col("_category").alias("category"), "question_type", display(F.col("question_type"), F.col("_category")).alias("question_type_display"), sub.alias("diagnostic_subtype"),
        first_filled(F.col("m_source_mode"), F.lit("unknown")).alias("source_mode"), F.col("m_source").alias("source"), F.col("answer").alias("gold_answer"),
        F.col("extracted").alias("extracted_prediction"), F.coalesce("correct", F.lit(False)).alias("correct"), "prompt", "raw_prediction", F.col(order).alias("line_no"),
    )


def by_type(made: DataFrame) -> DataFrame:
    """Totals by type and subtype with source modes, and the type's display name as its last record has it."""
    shown = made.groupBy("question_type").agg(F.max_by("question_type_display", F.struct("line_no", "id")).alias("display"))
    return reports.by_type(made, "question_type", "diagnostic_subtype", "source_mode").join(shown, "question_type")


def failure_samples(made: DataFrame, k: int = 3) -> DataFrame:
    """The first k wrong records of each type and subtype in line order, with the folder, the file stem and the text block of each."""
    wrong = reports.failures(made, ["question_type", "diagnostic_subtype"], "line_no", k)
    folder = F.concat_ws("/", classify.safe_label(F.col("question_type")), classify.safe_label(F.col("diagnostic_subtype")))
    stem = F.concat(F.lpad(F.col("place").cast("string"), F.greatest(F.length(F.col("place").cast("string")), F.lit(2)), F.lit("0")), F.lit("_"), F.col("id").cast("string"))
    told = {"ID": F.col("id"), "Type": F.col("question_type_display"), "Subtype": F.col("diagnostic_subtype"), "Gold": F.col("gold_answer"), "Extracted": F.col("extracted_prediction"), "Prompt": F.col("prompt"), "Raw": F.col("raw_prediction")}
    return wrong.select(*RECORD, "place", folder.alias("folder"), stem.alias("stem"), render.failed_sample(told).alias("text"))


def evaluate(examples: DataFrame, predictions: DataFrame, metadata: DataFrame, assignments: DataFrame | None = None, wanted: tuple[str, ...] = (), limit: int | None = None, kind: str | None = None, eligible_only: bool = False) -> dict[str, DataFrame]:
    """The evaluation run: records, totals by category and by type, failure samples.

    Examples are those of the wanted splits, in line order up to ``limit``; ``kind``
    keeps one question type, ``eligible_only`` rows that may be held out.
    """
    own = splits.select(examples, assignments, list(wanted)) if assignments is not None and wanted else examples
    if eligible_only:
        flags = metadata.select("id", classify.eval_eligible(F.coalesce("source_mode", F.lit("")), F.coalesce("eval_eligible", F.lit("")) if "eval_eligible" in metadata.columns else F.lit("")).alias("_ok"))
        own = own.join(flags.filter(~F.col("_ok")).select("id"), "id", "left_anti")
    if limit is not None:
        own = own.orderBy("line_no").limit(limit)
    made = records(own, predictions, metadata)
    if kind is not None:
        made = made.filter(F.col("question_type") == kind)
    return {"records": made, "by_category": reports.by_category(made), "by_type": by_type(made), "failures": failure_samples(made)}


def candidates_shown(words: Column, most: int = 12) -> Column:
    """Words as a list for display, cut after ``most`` with the number left out."""
    more = F.size(words) - most
    return F.concat(F.array_join(F.slice(words, 1, most), ", "), F.when(more > 0, F.concat(F.lit(", ... ("), more.cast("string"), F.lit(" more)"))).otherwise(""))
