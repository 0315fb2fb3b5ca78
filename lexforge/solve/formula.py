"""Gravity, unit conversion and Roman numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeral letters, largest first.
NUMERALS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def gravity(distance: Column, time: Column) -> Column:
    """The constant k of distance = k t^2 over a group, by sums; null without any time."""
    return F.try_divide(F.sum(distance), F.sum(time * time))


def factor(source: Column, target: Column) -> Column:
    return F.try_divide(F.sum(target), F.sum(source))


def roman(number: Column) -> Column:
    """1 to 3999 in Roman numerals; null outside."""
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in NUMERALS])
    start = F.struct(number.cast("int").alias("left"), F.lit("").alias("text"))
    step = lambda a, t: F.struct((a["left"] % t["v"]).cast("int").alias("left"), F.concat(a["text"], F.repeat(t["s"], F.floor(a["left"] / t["v"]).cast("int"))).alias("text"))
    return F.when(number.between(1, 3999), F.aggregate(table, start, step, lambda a: a["text"]))
