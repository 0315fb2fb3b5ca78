"""Symbol equations: parsing and direct position templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import let, lines, strip

# Positions of the left-hand side that make the right-hand side, in order of trial.
TEMPLATES = {"0134": (0, 1, 3, 4), "3401": (3, 4, 0, 1)}


def parse(prompt: Column) -> Column:
    """(examples lhs, rhs; query): left-hand sides of five characters count, others are passed over; null without an example or a query of five."""
    told = F.filter(F.transform(lines(prompt), strip), lambda x: x.contains(" = "))
    pairs = F.transform(told, lambda x: F.struct(strip(F.substring_index(x, " = ", 1)).alias("lhs"), strip(F.substr(x, F.instr(x, " = ") + 3)).alias("rhs")))
    asked = strip(F.regexp_extract(prompt, r"(?i)determine the result for:\s*([^\n]+)", 1))
    made = F.struct(F.filter(pairs, lambda p: F.length(p["lhs"]) == 5).alias("examples"), asked.alias("query"))
    return let(made, lambda m: F.when((F.size(m["examples"]) > 0) & (F.length(m["query"]) == 5), m))


def at(text: Column, positions: tuple[int, ...]) -> Column:
    return F.concat(*[F.substring(text, p + 1, 1) for p in positions])


def whole(p: Column) -> Column:
    """Whether a puzzle (examples, query) can be read."""
    return F.coalesce((F.length(p["query"]) == 5) & F.exists(p["examples"], lambda e: F.coalesce(F.length(e["lhs"]) == 5, F.lit(False))), F.lit(False))


def direct_answer(puzzle: Column) -> Column:
    """(template, prediction, confidence) of the first template that all examples with the query's operator follow, or null."""
    def of(p: Column) -> Column:
        same = F.filter(p["examples"], lambda e: F.substring(e["lhs"], 3, 1) == F.substring(p["query"], 3, 1))
        return let(same, lambda own: named(p["query"], own))

    def named(query: Column, own: Column) -> Column:
        tries = [
            F.when(F.forall(own, lambda e: at(e["lhs"], t) == e["rhs"]), F.struct(F.lit(n).alias("template"), at(query, t).alias("prediction"), F.when(F.size(own) >= 2, "high").otherwise("medium").alias("confidence")))
            for n, t in TEMPLATES.items()
        ]
        return F.when(F.size(own) > 0, F.coalesce(*tries))

    # Bound once: the columns may be a parse of the prompt, which the optimiser would copy into every use.
    return let(puzzle, of)


def direct(puzzles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, template, prediction, confidence) of the puzzles that a template answers."""
    answer = direct_answer(F.struct("examples", "query"))
    return puzzles.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(answer))).alias("r")).select("id", "r.*")
