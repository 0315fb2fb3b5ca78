"""Preparation of all question types in one job: rows with subtypes, splits, summaries, the global split and the manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import classify
from lexforge.functions.text import first_filled
from lexforge.operators import reports, splits

SPLIT_COLUMNS = ("id", "split", "diagnostic_type", "diagnostic_subtype", "source_mode", "eval_eligible", "split_policy")
#: What the manifest says of how splits are made.
STRATEGY = "80/10/10 by question type, subtype and source mode; train-only rows train"


def _text(rows: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")


def typed(rows: DataFrame) -> DataFrame:
    """Rows of a known category with ``diagnostic_type`` and ``diagnostic_subtype`` appended or replaced."""
    trace = F.concat_ws("\n", _text(rows, "generated_cot"), _text(rows, "assistant_content"))
    known = rows.filter(F.col("category").isin(*classify.TYPE_OF_CATEGORY))
    kind = classify.map_lookup(F.col("category"), classify.TYPE_OF_CATEGORY)
    return known.withColumns({"diagnostic_type": kind, "diagnostic_subtype": classify.subtype(F.col("category"), _text(rows, "source"), _text(rows, "source_mode"), trace)})


def split_rows(rows: DataFrame, seed: int = 42) -> DataFrame:
    """The split of each typed row with what it rests on; flags as text."""
    mode, flag, policy = (_text(rows, c) for c in ("source_mode", "eval_eligible", "split_policy"))
    only = classify.train_only(mode, flag, policy)
    told = rows.select(
        "id", "diagnostic_type", "diagnostic_subtype", first_filled(mode, F.lit("unknown")).alias("source_mode"),
        F.when(classify.eval_eligible(mode, flag), "true").otherwise("false").alias("eval_eligible"), F.when(only, "train_only").otherwise(first_filled(policy, F.lit("auto"))).alias("split_policy"), only.alias("_only"),
    )
    made = splits.stratified(told, ["diagnostic_type", "diagnostic_subtype", "source_mode"], "id", seed, F.col("_only"))
    return made.select(*SPLIT_COLUMNS)


def summary(made: DataFrame) -> DataFrame:
    """Counts by subtype, source mode, eligibility, policy, split and split x subtype, for each type."""
    cells = ["diagnostic_subtype", "source_mode", "eval_eligible", "split_policy", "split"]
    keyed = made.select("diagnostic_type", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.lit(None).cast("string").alias("value2")) for c in cells],
        F.struct(F.lit("split*diagnostic_subtype").alias("column"), F.col("split").alias("value"), F.col("diagnostic_subtype").alias("value2")),
        F.struct(F.lit("all").alias("column"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("value2")))).alias("c"))
    return keyed.groupBy("diagnostic_type", "c.column", "c.value", "c.value2").agg(F.count("*").alias("n"))


def global_split(made: DataFrame) -> DataFrame:
    """(id, split) of all types; an id in two rows is an error when the result is read. Written in order of id."""
    return splits.union([made.select("id", "split")]).orderBy("id")


def manifest_counts(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """(counter, value, n): rows, rows by source mode and category, assignments by split."""
    own = rows.select(first_filled(_text(rows, "source_mode"), F.lit("unknown")).alias("source_mode"), first_filled(_text(rows, "category"), F.lit("unknown")).alias("category"))
    counted = reports.histograms(own, ["source_mode", "category"]).select(F.col("column").alias("counter"), "value", "n")
    return counted.unionByName(assignments.groupBy(F.col("split").alias("value")).agg(F.count("*").alias("n")).select(F.lit("split").alias("counter"), "value", "n"))


def updated_manifest(old: str | None, counts: DataFrame, **paths: str) -> str:
    """A manifest's JSON with the counts and paths laid over it; whatever else it says stays."""
    held = json.loads(old) if old and old.strip() else {}
    of: dict[str, dict[str, int]] = {}
    for r in counts.collect():  # a row for each mode, category and split
        of.setdefault(r.counter, {})[r.value] = r.n
    held |= paths | {
        "total_rows": of.get("all", {}).get(None, 0), "source_mode_counts": dict(sorted(of.get("source_mode", {}).items())), "category_counts": dict(sorted(of.get("category", {}).items())),
        "single_phase_split_counts": dict(sorted(of.get("split", {}).items())), "single_phase_split_strategy": STRATEGY,
    }
    return json.dumps(held, indent=2, ensure_ascii=False) + "\n"


def prepare(rows: DataFrame, seed: int = 42, kinds: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The preparation run over some or all types: typed rows, split rows, summary and, over all types, the global split."""
    own = typed(rows)
    if kinds is not None:
        unknown = set(kinds) - set(classify.CATEGORY_OF_TYPE)
        if unknown:
            raise ValueError(f"no question types: {sorted(unknown)}")
        own = own.filter(F.col("diagnostic_type").isin(*kinds))
    made = split_rows(own, seed)
    out = {"rows": own, "splits": made, "summary": summary(made)}
    if kinds is None or set(kinds) == set(classify.CATEGORY_OF_TYPE):
        out["global_split"] = global_split(made)
    return out
