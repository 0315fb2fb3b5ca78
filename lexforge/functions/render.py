"""Prompts, messages and training targets, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.scoring import boxed
from lexforge.functions.text import let, lines, strip

# The instruction after a prompt, and the marks of the plain chat form.
INSTRUCTION = "Please put your final answer inside `\\boxed{}`. For example: `\\boxed{your answer}`"
START, END = "<|im_start|>", "<|im_end|>"
IGNORED_LABEL = -100
_THINK = r"(?is)<think>\s*(.*?)\s*</think>"


def without_prefix(prompt: Column) -> Column:
    return strip(F.regexp_replace(prompt, r"(?i)^\s*In Alice['’]s Wonderland,\s*", ""))


def user_message(prompt: Column, instruct: Column | bool = True) -> Column:
    wanted = F.lit(instruct) if isinstance(instruct, bool) else instruct
    return F.when(wanted, F.concat(strip(prompt), F.lit("\n" + INSTRUCTION))).otherwise(strip(prompt))


def answer_line(answer: Column, style: str = "boxed") -> Column:
    if style not in ("boxed", "plain"):
        raise ValueError(f"Unsupported answer style: {style!r}")
    return F.concat(F.lit("Answer: "), answer) if style == "plain" else F.concat(F.lit("Answer: \\boxed{"), answer, F.lit("}"))


def reasoning(trace: Column) -> Column:
    """A trace as reasoning only: its first think block, else without the answer lines and blank lines at its end."""

    def tail_kept(text: Column) -> Column:
        def step(state: Column, line: Column) -> Column:
            drop = (strip(line) == "") | line.contains("\\boxed{") | line.rlike(r"(?i)\banswer\b")
            going = state["going"] & drop
            return F.struct(going.alias("going"), (state["n"] + F.when(going, 1).otherwise(0)).alias("n"))

        all_lines = lines(text)
        start = F.struct(F.lit(True).alias("going"), F.lit(0).alias("n"))
        dropped = F.aggregate(F.reverse(all_lines), start, step, lambda s: s["n"])
        return strip(F.array_join(F.slice(all_lines, F.lit(1), F.size(all_lines) - dropped), "\n"))

    def of(text: Column) -> Column:
        block = F.concat(F.lit("<think>\n"), strip(F.regexp_extract(text, _THINK, 1)), F.lit("\n</think>"))
        return F.when(text.rlike(_THINK), block).otherwise(tail_kept(text))

    return let(strip(F.coalesce(trace, F.lit(""))), of)


def assistant_content(answer: Column, trace: Column, style: str = "boxed") -> Column:
    """Reasoning, then the answer line; the answer line alone where there is no reasoning."""
    line = answer_line(answer, style)

    def of(text: Column) -> Column:
        gap = F.when(text.startswith("<think>") & text.contains("</think>") & F.lit(style == "boxed"), "\n").otherwise("\n\n")
        return F.when(text == "", line).otherwise(F.concat(text, gap, line))

    return let(reasoning(trace), of)


def trace_content(answer: Column, trace: Column, given: Column) -> Column:
    """The scored completion: given content as it is, else reasoning and answer inside a think block and the box after it."""
    final = F.coalesce(F.nullif(boxed(F.coalesce(trace, F.lit(""))), F.lit("")), answer)
    box = F.concat(F.lit("\\boxed{"), final, F.lit("}"))

    def of(text: Column) -> Column:
        inner = F.when(text.rlike(_THINK), strip(F.regexp_extract(text, _THINK, 1))).otherwise(text)
        last = F.coalesce(F.try_element_at(lines(inner), F.lit(-1)), F.lit(""))
        said = last.rlike(r"(?i)^\s*Answer\s*:") & last.contains("\\boxed{")
        told = F.when(inner == "", F.concat(F.lit("Answer: "), box)).when(said, inner).otherwise(F.concat(inner, F.lit("\n\nAnswer: "), box))
        return F.concat(F.lit("<think>\n"), told, F.lit("\n</think>\n"), box)

    own = strip(F.coalesce(given, F.lit("")))
    return F.when(own != "", own).otherwise(let(reasoning(trace), of))


def messages(prompt: Column, answer: Column | None = None, instruct: Column | bool = True) -> Column:
    user = F.struct(F.lit("user").alias("role"), user_message(prompt, instruct).alias("content"))
    if answer is None:
        return F.array(user)
    return F.array(user, F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def chat_text(said: Column, generate: bool = False) -> Column:
    """The plain chat form of messages; a real template is a model's own and comes in as a function of messages."""
    turns = F.transform(said, lambda m: F.concat_ws("\n", F.concat(F.lit(START), m["role"]), m["content"], F.lit(END)))
    text = F.array_join(turns, "\n")
    return F.concat(text, F.lit(f"\n{START}assistant")) if generate else text


def after_prompt(prompt_text: Column, content: Column) -> Column:
    """Content without the think mark that the prompt already ends with, nor one newline after it."""
    again = strip(prompt_text).endswith("<think>") & content.startswith("<think>")
    rest = F.substr(content, F.lit(len("<think>") + 1))
    return F.when(again, F.when(rest.startswith("\n"), F.substr(rest, F.lit(2))).otherwise(rest)).otherwise(content)


def masked_example(prompt_text: Column, content: Column, tokens: Callable[[Column], Column]) -> Column:
    """(input_ids, attention_mask, labels and counts) of a prompt and what follows it; labels of the prompt are ignored.

    ``tokens`` gives the ids of a text as an array; a tokenizer's function may be a pandas UDF.
    """

    def of(parts: Column) -> Column:
        head, tail = parts["head"], parts["tail"]
        ids = F.concat(head, tail)
        return F.struct(
            ids.alias("input_ids"),
            F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
            F.concat(F.array_repeat(F.lit(IGNORED_LABEL), F.size(head)), tail).alias("labels"),
            F.size(head).alias("n_prompt"),
            F.size(tail).alias("n_completion"),
            F.size(ids).alias("n_tokens"),
        )

    return let(F.struct(tokens(prompt_text).alias("head"), tokens(content).alias("tail")), of)


def padded(values: Column, width: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), width - F.size(values)))


def failed_sample(row: dict[str, Column]) -> Column:
    """A text block, a field a line, of a wrong prediction."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit(""))) for name, value in row.items()])
