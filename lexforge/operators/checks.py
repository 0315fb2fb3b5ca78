"""Contract checks: tables of violations, never failures in the middle of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import blank


def required(rows: DataFrame, columns: list[str], line: str = "line_no") -> DataFrame:
    """(line, column) of each blank cell; lines count from 1 with the header as the first."""
    cells = F.array_compact(F.array(*[F.when(blank(F.col(c)), F.lit(c)) for c in columns]))
    return rows.select((F.col(line) + 1).alias("line"), F.explode(cells).alias("column"))


def duplicates(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_count(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows beyond the first of their id, in one row."""
    each = rows.groupBy(id_col).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def differences(source: DataFrame, stored: DataFrame, id_col: str, columns: list[str], derived: tuple[str, ...] = ()) -> DataFrame:
    """(id, issue): ids on one side only, or the first column that differs; besides, each of the ``derived`` columns that differs."""
    a, b = source.select(id_col, *columns, *derived).alias("a"), stored.select(id_col, *columns, *derived).alias("b")
    joined = a.join(b, F.col(f"a.{id_col}") == F.col(f"b.{id_col}"), "full")
    equals = lambda c: F.coalesce(F.col(f"a.{c}").cast("string"), F.lit("")) == F.coalesce(F.col(f"b.{c}").cast("string"), F.lit(""))
    same = [equals(c) for c in columns]
    issue = F.when(F.col(f"b.{id_col}").isNull(), "missing").when(F.col(f"a.{id_col}").isNull(), "extra")
    for c, equal in zip(columns, same):
        issue = issue.when(~equal, f"differs: {c}")
    both = F.col(f"a.{id_col}").isNotNull() & F.col(f"b.{id_col}").isNotNull()
    more = [F.when(both & ~equals(c), f"differs: {c}") for c in derived]
    return joined.select(F.coalesce(f"a.{id_col}", f"b.{id_col}").alias(id_col), F.explode(F.array_compact(F.array(issue, *more))).alias("issue"))


def assert_none(issues: DataFrame, what: str) -> None:
    some = issues.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[tuple(r) for r in some]}")


def last_per_id(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """One row per id that is not blank: the last in order."""
    others = [c for c in rows.columns if c != id_col]
    picked = rows.filter(~blank(F.col(id_col).cast("string"))).groupBy(id_col).agg(F.max_by(F.struct(*others), order).alias("r"))
    return picked.select(id_col, "r.*")


def preflight(rows: DataFrame, id_col: str, eligible: str, batch: int, generations: int) -> DataFrame:
    """One row: counts, duplicates and whether the batch divides by the generations."""
    each = rows.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(F.col(eligible)).alias("ok"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_ids"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_eligible")).withColumns(
        {"n_duplicates": F.col("n_rows") - F.col("n_ids"), "divides": F.lit(batch % generations == 0)}
    )
