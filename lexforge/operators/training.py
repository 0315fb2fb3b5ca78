"""Rows for training: selection by split, masked token rows, policy prompts, and the checks before a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import render
from lexforge.functions.text import blank
from lexforge.operators import checks, splits

# Fixed value: the longest completion that may be asked for.
MOST_COMPLETION_TOKENS = 7680


def phase_split(rows: DataFrame, assignments: DataFrame, wanted: str = "sft_train", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(train, holdout) of rows whose ids must be exactly those assigned; what is missing, extra or empty is an error."""
    problems = splits.violations(rows, assignments, id_col, None).filter("problem <> 'duplicate'")
    checks.assert_none(problems, "split ids and rows differ")
    train = splits.select(rows, assignments, [wanted], id_col)
    if not train.limit(1).count():
        raise ValueError(f"no rows have split {wanted}")
    held = rows.join(assignments.filter(F.col("split") == wanted).select(id_col), id_col, "left_anti")
    return train, held


def supervision(rows: DataFrame, column: str = "generated_cot") -> str:
    """``cot`` if any row has a trace, else ``answer_only``."""
    return "cot" if rows.agg(F.coalesce(F.bool_or(~blank(F.col(column))), F.lit(False))).first()[0] else "answer_only"


def sft_rows(rows: DataFrame, assignments: DataFrame, wanted: list[str], tokens: Callable[[Column], Column], max_tokens: int, instruct: Column | bool = True, end: str = render.END) -> DataFrame:
    """(id, input_ids, attention_mask, labels, prompt_tokens, completion_tokens, total_tokens) of the wanted splits' rows.

    A row over ``max_tokens`` or without anything to score is an error when it is read.
    """
    own = splits.select(rows, assignments, wanted)
    prompt = render.chat_text(render.messages(F.col("prompt"), None, instruct), generate=True)
    content = render.after_prompt(prompt, render.trace_content(F.col("answer"), F.col("generated_cot"), F.col("assistant_content")))
    closed = F.when(content.endswith(end), content).otherwise(F.concat(content, F.lit(end)))
    made = own.select(F.col("id"), prompt.alias("_p"), closed.alias("_c")).select("id", render.masked_example(F.col("_p"), F.col("_c"), tokens).alias("m"))
    return checked_tokens(made.select("id", "m.*"), max_tokens)


def checked_tokens(made: DataFrame, max_tokens: int) -> DataFrame:
    told = lambda what: F.raise_error(F.concat(F.lit("id="), F.col("id").cast("string"), F.lit(what)))
    ids = F.when(F.col("n_tokens") > max_tokens, told(f" is over {max_tokens} tokens")).when(F.col("n_completion") < 1, told(" has nothing to score")).otherwise(F.col("input_ids"))
    return made.select("id", ids.alias("input_ids"), "attention_mask", "labels", F.col("n_prompt").alias("prompt_tokens"), F.col("n_completion").alias("completion_tokens"), F.col("n_tokens").alias("total_tokens"))


def text_rows(rows: DataFrame, style: str) -> DataFrame:
    """(id, text): whole chat texts, with traces (``cot``) or with answers alone (``answer_only``)."""
    answer = F.concat(F.lit("\\boxed{"), F.col("answer"), F.lit("}"))
    content = render.trace_content(F.col("answer"), F.col("generated_cot"), F.lit("")) if style == "cot" else answer
    return rows.select("id", render.chat_text(render.messages(F.col("prompt"), content)).alias("text"))


def grpo_rows(rows: DataFrame, assignments: DataFrame, wanted: list[str], limit: int | None = None) -> DataFrame:
    """(id, prompt as messages, answer, category, label) of eligible rows of the wanted splits, in line order."""
    own = splits.select(rows, assignments, wanted).filter("eval_eligible")
    if limit is not None:
        own = own.orderBy("line_no").limit(limit)
    return own.select("id", render.messages(F.col("prompt")).alias("prompt"), "answer", "category", "label")


def preflight(rows: DataFrame, assignments: DataFrame, wanted: list[str], effective_batch: int, generations: int) -> DataFrame:
    """One row of counts with ``warnings``: duplicates, and ids that the split selects but the rows lack."""
    counted = checks.preflight(rows, "id", "eval_eligible", effective_batch, generations)
    chosen = assignments.filter(F.col("split").isin(*wanted))
    lacking = chosen.select("id").distinct().join(rows.select("id"), "id", "left_anti").agg(F.count("*").alias("selected_missing"))
    train = splits.select(rows, assignments, wanted)
    some = train.agg(F.count_if("eval_eligible").alias("train_rows"), F.count_if(~F.col("eval_eligible")).alias("skipped_ineligible"))
    said = F.array_compact(F.array(
        F.when(F.col("n_duplicates") > 0, F.concat(F.col("n_duplicates").cast("string"), F.lit(" rows repeat an id; they weigh more, and split counts are harder to audit"))),
        F.when(F.col("selected_missing") > 0, F.concat(F.col("selected_missing").cast("string"), F.lit(" ids of the chosen splits have no row"))),
    ))
    return counted.crossJoin(lacking).crossJoin(some).withColumn("warnings", said)  # three rows of one


def run_limits(max_completion: int, generations: int, world: int, batch: int, accumulation: int, rank: int | None = None, max_rank: int | None = None) -> list[str]:
    """What is wrong with a run's settings; empty if nothing is."""
    out = []
    if max_completion > MOST_COMPLETION_TOKENS:
        out.append(f"completions of {max_completion} tokens are over {MOST_COMPLETION_TOKENS}")
    if generations < 1:
        out.append("at least one generation is needed")
    elif world * batch * accumulation % generations:
        out.append(f"a batch of {world} x {batch} x {accumulation} does not divide by {generations} generations")
    if rank is not None and max_rank is not None and rank > max_rank:
        out.append(f"rank {rank} is over {max_rank}")
    return out


def head(rows: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The first n rows in line order."""
    return rows.orderBy(order).limit(n)


def batched(rows: DataFrame, size: int, group: list[str], order: str = "line_no") -> DataFrame:
    """Rows with ``batch``: chunks of ``size`` in line order inside each group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def phases(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two phases one after the other, with ``phase``; columns that one lacks are null there."""
    return first.withColumn("phase", F.lit(1)).unionByName(second.withColumn("phase", F.lit(2)), allowMissingColumns=True)


def subset(a: Column, b: Column) -> Column:
    """Whether every element of one array is in another."""
    return F.size(F.array_except(a, b)) == 0
