"""Quality rules as a bitmask ledger.

Every rule is evaluated once over the whole text. The ledger keeps, for each
document, the measurements and one word of failure bits; a policy is a versioned
mask over those bits, so trying another policy or an ablation reads the ledger
and never the texts. Everything here is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Abusive words whose presence fails the ``blocked_words`` rule, unless the caller brings a list of its own.
BLOCKED_WORDS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "degenerate", "dimwit", "dipshit", "disgusting", "douchebag", "dumbass", "dunce",
    "fathead", "filth", "fool", "freak", "fuckface", "fucker", "halfwit", "hypocrite", "idiot", "idiotic", "ignoramus", "imbecile", "jackass",
    "jerk", "loser", "lowlife", "maggot", "moron", "moronic", "nitwit", "numbskull", "parasite", "pathetic", "pig", "prick", "retard",
    "savage", "scoundrel", "scum", "scumbag", "shithead", "simpleton", "sleazebag", "slob", "slut", "stupid", "subhuman", "swine",
    "trash", "twat", "twit", "vermin", "wanker", "weasel", "whore", "worthless", "wretch",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows_repeat(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more.

    Window hashes that are all distinct prove that there are none. Otherwise the
    windows themselves are sorted, so that equal ones meet, and the starts of
    those give the covered words: each start adds its distance from the start
    before, five at most.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 5)

    def at(i: Column, k: int) -> Column:
        return F.get(words, i + k)

    def exact(_: Column) -> Column:
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[at(i, k) for k in range(5)]).alias("s"), i.alias("i"))))

        def covered(ordered: Column) -> Column:
            twice = F.filter(
                F.transform(
                    ordered,
                    lambda x, k: F.when(
                        (x["s"] == F.get(ordered, k + 1)["s"]) | (x["s"] == F.get(ordered, k - 1)["s"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            steps = F.aggregate(
                F.sort_array(twice),
                F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")),
            )
            return steps["n"]

        return let(windows, covered)

    def by_hash(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(exact(hashes))

    def of_hashes(one: Column) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(one, i + k) for k in range(5)]))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(let(hashes, by_hash))


def measurements(text: Column, blocked_words: Sequence[str] = BLOCKED_WORDS) -> Column:
    """A struct of what the rules look at; null text measures as empty."""
    text = F.coalesce(text, F.lit(""))
    blocked = rf"(?i)(?:^|[^\p{{L}}])(?:{'|'.join(map(re.escape, blocked_words))})(?:$|[^\p{{L}}])"

    def left(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _windows_repeat(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")
        )

    words = let(F.array_remove(F.split(text, SPACE), ""), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    return F.struct(
        words.alias("words"),
        lines.alias("lines"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        left(r"[^\p{Lu}]+").alias("n_upper"),
        (text.rlike(blocked) if blocked_words else F.lit(False)).cast("long").alias("has_blocked"),
    )


MEASURES = {
    "n_words": "words.n_words", "word_chars": "words.word_chars", "n_symbols": "n_symbols", "n_dup_lines": "lines.n_dup_lines",
    "n_repeat_words": "words.n_repeat_words", "n_distinct_words": "words.n_distinct_words", "n_lines": "lines.n_lines",
    "n_upper": "n_upper", "has_blocked": "has_blocked",
}

#: Rule name and the SQL condition, over the measurements, under which it fails. Its bit is its place; places never change.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "10 * n_upper > 3 * word_chars"),
    ("few_distinct_words", "n_distinct_words * n_distinct_words < n_words"),
    ("blocked_words", "has_blocked > 0"),
)
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    """A document is kept if none of the rules named here failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (name, _) in enumerate(RULES) if name in self.rules)


DEFAULT = Policy("default", 1, tuple(name for name, _ in RULES))
BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), blocked_words: Sequence[str] = BLOCKED_WORDS) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, the measurements and ``fail_bits``.

    Null, empty and blank texts have no words: they fail ``too_few_words`` and no
    rule divides by anything. Repeated rows stay as they are. Columns of ``docs``
    other than ``keep`` and the text are not read, so their names can't clash.
    """
    measured = docs.select(*keep, measurements(F.col(text_col).cast("string"), blocked_words).alias("_m"))
    flat = measured.select(*keep, *[F.col(f"_m.{path}").alias(name) for name, path in MEASURES.items()])
    bits = sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, cond) in enumerate(RULES)), F.lit(0).cast("long"))
    return flat.withColumn("fail_bits", bits)


def verdict(policy: Policy = DEFAULT) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policies(ledger_df: DataFrame, *policies: Policy) -> DataFrame:
    """The ledger with one verdict column for each policy, ``<name>_v<version>``."""
    return ledger_df.select("*", *[verdict(p).alias(f"{p.name}_v{p.version}") for p in policies])


def ablation(ledger_df: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: how many rows fail it, and how many only it rejects.

    Rows are first counted by their failure bits, at most two to the number of
    rules, so the rule-by-rule pass is over that small table.
    """
    counted = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in policy.rules])
    each = counted.select("bits", "n", F.explode(rules).alias("r")).filter(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_failed"), F.sum(F.when(F.bit_count("bits") == 1, F.col("n")).otherwise(0)).alias("n_only_this")
    )


def filter_documents(docs: DataFrame, policy: Policy = DEFAULT, text_col: str = "text", blocked_words: Sequence[str] = BLOCKED_WORDS) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns.

    Decided row by row, so repeated ids and rows fare as their texts do; null and
    empty texts go; very long texts are measured whole.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text_col).alias("_text"))
    return ledger(packed, "_text", ("_row",), blocked_words).filter(verdict(policy)).select("_row.*")
