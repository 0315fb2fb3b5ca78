"""Answer extraction, matching and rewards, as expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexforge.functions.text import bare_number, let, lines, strip

NOT_FOUND = "NOT_FOUND"
RELATIVE, ABSOLUTE = 1e-2, 1e-5
#: The answer phrases in order, and what counts as a number.
PHRASES = (r"The final answer is:\s*([^\n]+)", r"Final answer is:\s*([^\n]+)", r"Final answer\s*[:：]\s*([^\n]+)")
NUMBER = r"-?\d+(?:\.\d+)?"
EXACT_LINE, ONE_BOX, RIGHT = 0.02, 0.08, 1.0


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def boxed(text: Column) -> Column:
    r"""The last filled ``\boxed{...}``, each read to the last brace before the next; the last one if none is filled; null without any."""
    parts = F.split(text, r"\\boxed\{")
    inside = F.transform(F.slice(parts, 2, 1 << 30), lambda x: strip(F.regexp_replace(x, r"(?s)\}[^}]*$", "")))
    return let(inside, lambda a: F.coalesce(_last(F.filter(a, lambda x: x != "")), _last(a)))


def answer(text: Column) -> Column:
    """The answer in a completion: boxed, else after an answer phrase, else the last number, else the last filled line."""
    phrases = [strip(_last(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)))) for p in PHRASES]
    number = _last(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))
    line = _last(F.filter(F.transform(lines(text), strip), lambda x: x != ""))
    return F.coalesce(boxed(text), *phrases, number, line, F.lit(NOT_FOUND))


def matches(predicted: Column, gold: Column, relative: float = RELATIVE) -> Column:
    """Bit strings exactly, numbers within tolerance, else without case; never null for texts."""
    def of(m: Column) -> Column:
        p, g, a, b = (m[c] for c in "pgab")
        size = F.greatest(F.abs(a), F.abs(b))
        near = (~F.isnan(a) & ~F.isnan(b)) & ((a == b) | ((size < float("inf")) & (F.abs(a - b) <= F.greatest(size * relative, F.lit(ABSOLUTE)))))
        same = F.lower(p) == F.lower(g)
        return F.when(g.rlike("^[01]+$"), same).when(a.isNotNull() & b.isNotNull(), near).otherwise(same)

    # Bound once: numbers are named many times and read by a pattern.
    return let(F.struct(strip(predicted).alias("p"), strip(gold).alias("g")), lambda t: let(F.struct(t["p"].alias("p"), t["g"].alias("g"), bare_number(t["g"]).alias("a"), bare_number(t["p"]).alias("b")), of))


def on_own_line(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?im)^\s*\\boxed\{.*\}\s*$"), F.lit(False))


def one_box(text: Column) -> Column:
    return F.coalesce(F.size(F.split(text, r"\\boxed\{")) == 2, F.lit(False))


def rewards(text: Column, gold: Column) -> dict[str, Column]:
    """The reward parts of a completion and their sum."""
    parts = {
        "accuracy_reward": F.when(matches(answer(text), gold), RIGHT).otherwise(0.0),
        "final_line_reward": F.when(on_own_line(text), EXACT_LINE).otherwise(0.0),
        "single_box_reward": F.when(one_box(text), ONE_BOX).otherwise(0.0),
    }
    return parts | {"total_reward": sum(parts.values(), F.lit(0.0))}


def _flattened(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return _flattened(value.get("content"))
    if isinstance(value, list):
        return "\n".join(map(_flattened, value)).strip()
    return str(value)


@F.pandas_udf(StringType())
def _completions(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str:
        if text is None or text[:1] not in "[{":
            return text or ""
        try:
            return _flattened(json.loads(text))
        except ValueError:
            return text

    return texts.map(one)


def completion_text(completion: Column) -> Column:
    """Text of a JSON completion of any nesting: a string, an object with content, or a list of either (joined by newlines, stripped).

    A text that is no JSON object or list stands for itself, null for the empty text.
    """
    return _completions(completion)
