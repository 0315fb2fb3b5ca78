"""Deterministic stratified splits and joins with split assignments.

A split depends on the seed and the row's id only: rows of a stratum are ranked by
a hash of both and the ranks are cut by quota. Adding a stratum moves no other.
Ranking is a window for each stratum; a stratum too large for one task is ranked
in two steps, inside hash ranges and by the ranges' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.classify import SPLITS
from lexforge.functions.text import blank


def quotas(size: Column) -> list[Column]:
    """Rows of a stratum of this size for (sft_train, eval_holdout, grpo_holdout)."""
    tenth = F.greatest(F.lit(1).cast("long"), F.bround(size * F.lit(0.1)).cast("long"))
    held = F.when(size >= 10, tenth).when(size >= 4, 1).otherwise(0).cast("long")
    first = F.when((size == 2) | (size == 3), 1).otherwise(held).cast("long")
    return [size - first - held, first, held]


def _hash(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def ranked(rows: DataFrame, strata: list[str], id_col: str, seed: int, ranges: int = 4096) -> DataFrame:
    """rows with ``n`` (rows of the stratum) and ``rank`` from 1 by the seeded hash.

    Hash ranges share a stratum out: a row's rank is its rank in the range plus the
    rows of the ranges before, so the largest sort is about a ``ranges``-th of a stratum.
    """
    keyed = rows.withColumn("_h", _hash(F.col(id_col), seed)).withColumn("_r", (F.conv(F.substring("_h", 1, 4), 16, 10).cast("long") * ranges / 65536).cast("int"))
    counts = keyed.groupBy(*strata, "_r").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*strata)
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("n", F.sum("_c").over(whole)).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    same = [F.col(f"k.{s}").eqNullSafe(F.col(f"c.{s}")) for s in strata] + [F.col("k._r") == F.col("c._r")]
    inside = Window.partitionBy(*strata, "_r").orderBy("_h", id_col)
    own = keyed.withColumn("_rank", F.row_number().over(inside))
    joined = own.alias("k").join(counts.alias("c"), on=same).select("k.*", "c.n", "c._before")
    return joined.withColumn("rank", F.col("_rank") + F.col("_before")).drop("_h", "_r", "_rank", "_before")


def cut(sizes: list[Column], names: list[str]) -> Column:
    """The split of ``rank`` when the sizes are laid out in order."""
    out, upto = None, F.lit(0)
    for name, size in zip(names, sizes):
        upto = upto + size
        out = F.when(F.col("rank") <= upto, name) if out is None else out.when(F.col("rank") <= upto, name)
    return out


def stratified(rows: DataFrame, strata: list[str], id_col: str = "id", seed: int = 42, train_only: Column | None = None) -> DataFrame:
    """rows with ``split``; train-only rows all train and are not counted into strata."""
    if train_only is not None:
        fixed = rows.filter(train_only).withColumn("split", F.lit(SPLITS[0]))
        return stratified(rows.filter(~train_only), strata, id_col, seed).unionByName(fixed)
    return ranked(rows, strata, id_col, seed).withColumn("split", cut(quotas(F.col("n")), list(SPLITS))).drop("rank", "n")


def partition(rows: DataFrame, stratum: str, fractions: dict[str, float], id_col: str = "id", seed: int = 42) -> DataFrame:
    """rows with ``split`` by largest remainders in each stratum; of equal remainders the later name gains."""
    if not fractions or abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("the fractions must sum to 1")
    names = list(fractions)
    exact = [F.col("n") * F.lit(f) for f in fractions.values()]
    low = [F.floor(x) for x in exact]
    spare = F.col("n") - sum(low, F.lit(0))
    order = F.reverse(F.array_sort(F.array(*[F.struct((x - b).alias("part"), F.lit(i).alias("i")) for i, (x, b) in enumerate(zip(exact, low))])))
    gets = F.transform(F.slice(order, F.lit(1), F.greatest(spare.cast("int"), F.lit(0))), lambda s: s["i"])
    sizes = [b + F.array_contains(gets, i).cast("long") for i, b in enumerate(low)]
    return ranked(rows, [stratum], id_col, seed).withColumn("split", cut(sizes, names)).drop("rank", "n")


def train_and_val(rows: DataFrame, stratum: str, fraction: float = 0.2, id_col: str = "id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training rows, validation rows) by strata; without a fraction all rows train. An empty side is an error."""
    if not 0 <= fraction < 1:
        raise ValueError("the fraction must be in [0, 1)")
    if fraction == 0:
        return rows, rows.limit(0)
    cut_rows = partition(rows, stratum, {"val": fraction, "train": 1 - fraction}, id_col, seed)
    sizes = cut_rows.agg(F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("split") == "train").alias("train")).first()
    if not sizes["val"] or not sizes["train"]:
        raise ValueError("the split leaves the training or the validation side empty")
    sides = [cut_rows.filter(F.col("split") == name).drop("split") for name in ("train", "val")]
    return sides[0], sides[1]


def select(rows: DataFrame, assignments: DataFrame, wanted: list[str], id_col: str = "id") -> DataFrame:
    """Rows whose assigned split is wanted."""
    return rows.join(assignments.filter(F.col("split").isin(*wanted)).select(id_col), id_col, "left_semi")


def missing(rows: DataFrame, assignments: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of rows without an assignment."""
    return rows.select(id_col).distinct().join(assignments.select(id_col), id_col, "left_anti")


def extra(rows: DataFrame, assignments: DataFrame, id_col: str = "id") -> DataFrame:
    """Assigned ids without a row."""
    return assignments.select(id_col).distinct().join(rows.select(id_col), id_col, "left_anti")


def violations(rows: DataFrame, assignments: DataFrame, id_col: str = "id", names: tuple[str, ...] | None = SPLITS) -> DataFrame:
    """(problem, id) of everything that breaks the contract between rows and assignments."""
    def named(df: DataFrame, problem: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col(id_col).cast("string").alias("id"))

    twice = assignments.groupBy(id_col).count().filter("count > 1")
    found = named(missing(rows, assignments, id_col), "missing").unionByName(named(extra(rows, assignments, id_col), "extra")).unionByName(named(twice, "duplicate"))
    return found.unionByName(named(assignments.filter(~F.col("split").isin(*names)), "unknown split")) if names else found


def from_json(text: DataFrame, column: str = "value") -> DataFrame:
    """(id, split) of a JSON object of id lists, under ``split_ids`` or ``splits``."""
    kind = "map<string,array<string>>"
    lists = F.coalesce(F.from_json(F.get_json_object(column, "$.split_ids"), kind), F.from_json(F.get_json_object(column, "$.splits"), kind))
    return text.select(F.explode(lists).alias("split", "ids")).select(F.explode("ids").alias("id"), "split")


def assignment_problems(assignments: DataFrame, id_col: str = "id") -> DataFrame:
    """(problem, id) of what an assignment file must not hold: blank ids, blank split names and ids that come twice."""
    def named(df: DataFrame, problem: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col(id_col).cast("string").alias("id"))

    twice = assignments.filter(~blank(F.col(id_col).cast("string"))).groupBy(id_col).count().filter("count > 1")
    return named(assignments.filter(blank(F.col(id_col).cast("string"))), "blank id").unionByName(named(assignments.filter(blank(F.col("split"))), "blank split")).unionByName(named(twice, "duplicate"))


def union(parts: list[DataFrame], id_col: str = "id") -> DataFrame:
    """All parts' assignments; an id in two of them is an error when the result is read."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    counted = out.withColumn("_n", F.count("*").over(Window.partitionBy(id_col)))
    failed = F.raise_error(F.concat(F.lit("duplicate id "), F.col(id_col).cast("string")))
    return counted.withColumn("split", F.when(F.col("_n") > 1, failed).otherwise(F.col("split"))).drop("_n")
