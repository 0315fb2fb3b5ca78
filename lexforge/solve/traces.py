"""The steps of a solution as text: what the searches have carried out, put into sentences.

Steps are arrays in the row of their puzzle and are joined by line breaks at the end,
so a trace costs no shuffle. The sentences are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import let
from lexforge.solve import cipher, numeric

MOST_SHOWN = 12
# What a trace says of a motif and of each step.
TURNS = {("rev", "rev"): "reverse both operands first", ("rev", "id"): "reverse the left operand first", ("id", "rev"): "reverse the right operand first"}
MODES = {
    "rev": "reverse the result", "neg": "write the negative result", "neg_rev": "reverse the digits and write the negative result", "op_prefix": "put the operator in front of the result",
    "op_suffix": "put the operator at the end of the result", "op_prefix_if_neg": "if the result is negative, replace the minus sign with the operator",
    "op_suffix_rev_if_neg": "if the result is negative, reverse the magnitude and put the operator at the end", "op_prefix_rev": "reverse the result and put the operator in front",
    "op_suffix_rev": "reverse the result and put the operator at the end",
}
CIPHER_HEAD = "We need to deduce the hidden text cipher by matching the example plaintext outputs."
CIPHER_MAP = "From the examples, I extract character mappings: "
CIPHER_METHOD = (
    "S1: This is a bijective letter-substitution cipher over the 77-word Wonderland vocabulary.",
    "S2: Decode with the example mapping first; use vocabulary matching only for unresolved target words.",
)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def computation(e: Column, r: Column) -> Column:
    """The steps by which a rule (lt, rt, rule, mode, width) makes the result of an equation (lhs, left, op, right)."""
    mode, width, op = r["mode"], r["width"], e["op"]

    def turn(side: str, how: Column) -> Column:
        return F.when(how == "rev", _text(f"reverse the {side} operand: ", e[side], " -> ", numeric.reverse_text(e[side])))

    def of(m: Column) -> Column:
        v, shown = m["v"], m["v"].cast("string")
        write = lambda how: numeric.written(v, F.lit(how), op, width)
        plain, back, final = write("plain"), write("rev"), numeric.written(v, mode, op, width)
        filled = F.replace(F.replace(r["rule"], F.lit("x"), m["x"].cast("string")), F.lit("y"), m["y"].cast("string"))
        said = {
            "rev": _text("reverse the result text: ", plain, " -> ", back), "neg": _text("write the negative form of the magnitude: ", shown, " -> ", final),
            "neg_rev": _text("reverse the digits, then write the negative form: ", shown, " -> ", final), "op_prefix": _text("put the operator in front: ", plain, " -> ", final),
            "op_suffix": _text("put the operator at the end: ", plain, " -> ", final), "op_prefix_rev": _text("reverse the digits, then put the operator in front: ", back, " -> ", final),
            "op_suffix_rev": _text("reverse the digits, then put the operator at the end: ", back, " -> ", final),
            "op_prefix_if_neg": F.when(v < 0, _text("if the result is negative, write the operator then the magnitude: ", shown, " -> ", final)),
            "op_suffix_rev_if_neg": F.when(v < 0, _text("if the result is negative, reverse the magnitude and put the operator at the end: ", shown, " -> ", final)),
        }
        out = F.when(mode == "plain", F.when(width.isNull(), _text("write the result directly: ", shown)).otherwise(_text("pad the result to ", width.cast("string"), " digits: ", shown, " -> ", plain)))
        for name, text in said.items():
            out = out.when(mode == name, text)
        out = F.coalesce(out, _text("if the result is nonnegative, write it directly: ", shown, " -> ", final))
        return F.array_compact(F.array(turn("left", r["lt"]), turn("right", r["rt"]), _text("apply ", r["rule"], ": ", filled, " = ", shown), out, _text("so ", e["lhs"], " becomes ", final)))

    x, y = numeric.operand(e["left"], r["lt"]), numeric.operand(e["right"], r["rt"])
    return let(F.struct(x.alias("x"), y.alias("y")), lambda o: let(F.struct(o["x"].alias("x"), o["y"].alias("y"), numeric.apply_rule(o["x"], o["y"], r["rule"]).alias("v")), of))


def digit_trace(examples: Column, query: Column, r: Column, prediction: Column) -> Column:
    """The whole text; null where the rule isn't one of the query operator's examples."""
    same = F.filter(examples, lambda e: e["op"] == query["op"])
    dashed = lambda steps: F.transform(steps, lambda s: _text("- ", s))
    turned = F.lit(None).cast("string")
    for (lt, rt), text in TURNS.items():
        turned = F.when((r["lt"] == lt) & (r["rt"] == rt), F.lit(text)).otherwise(turned)
    mode = F.try_element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), r["mode"])
    width = F.when(r["width"].isNotNull(), _text("keep ", r["width"].cast("string"), " digits with leading zeros if needed"))
    summary = F.array_join(F.array_compact(F.array(turned, _text("compute ", r["rule"]), mode, width)), "; ")

    def of(own: Column) -> Column:
        head = F.array(F.lit("Each operator can follow its own hidden rule, so I only need the examples with the same operator as the query."), _text("For operator '", query["op"], "', the matching example(s) are:"))
        listed = F.transform(own, lambda e: _text("- ", e["lhs"], " = ", e["rhs"]))
        rule = F.array(F.lit(""), F.lit("A simple rule that fits these example(s) is:"), _text("- ", summary, "."))
        checks = F.flatten(F.transform(own, lambda e: F.concat(F.array(F.lit(""), _text("Check ", e["lhs"], ":")), dashed(computation(e, r)))))
        asked = F.concat(F.array(F.lit(""), _text("Apply the same rule to ", query["lhs"], ":")), dashed(computation(query, r)))
        lines = F.concat(head, listed, rule, checks, asked, F.array(F.lit(""), _text("So the result is ", prediction, ".")))
        return F.when((r["basis"] == "examples") & (F.size(own) > 0), F.array_join(lines, "\n"))

    return let(same, of)


def explain_digits(puzzles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, prediction, trace) of puzzles as ``numeric.puzzles`` gives them."""
    done = numeric.considered(puzzles, id_col).withColumn("r", numeric._solved(F.col("cands"), F.col("examples"), F.col("query")))
    told = done.select("id", "examples", "query", "r.prediction", "r.rule")
    return told.select("id", "prediction", digit_trace(F.col("examples"), F.col("query"), F.col("rule"), F.col("prediction")).alias("trace"))


def _shown(words: Column) -> Column:
    few = F.array_join(words, ", ")
    more = _text(F.array_join(F.slice(words, 1, MOST_SHOWN), ", "), ", ... (", F.size(words).cast("string"), " total)")
    return F.when(F.size(words) == 0, "none").when(F.size(words) <= MOST_SHOWN, few).otherwise(more)


def cipher_trace(known: Column, query: Column, solved: Column) -> Column:
    """The whole text of a decoded query: ``solved`` has the words' steps, ``known`` the letters of the examples."""
    pairs = lambda entries, c, p: F.array_join(F.transform(entries, lambda e: _text(e[c], "→", e[p])), ", ")

    def line(s: Column) -> Column:
        full = _text('- "', s["word"], '" -> "', s["chosen"], '" (fully mapped)')
        added = F.when(F.size(s["added"]) == 0, "none").otherwise(pairs(s["added"], "c", "p"))
        part = _text(
            '- "', s["word"], '" -> "', s["partial"], '"; vocab matches: ', _shown(s["matches"]), "; bijective matches: ", _shown(s["fits"]), '; choose "', s["chosen"], '"; add ', added
        )
        return F.when(s["full"], full).otherwise(part)

    head = [F.lit(CIPHER_HEAD), _text(CIPHER_MAP, pairs(F.array_sort(F.map_entries(known)), "key", "value")), *map(F.lit, CIPHER_METHOD), _text('S3: Target text: "', query, '"'), F.lit("S4: Decode target words:")]
    tail = [_text("S5: Decoded phrase = ", solved["decoded"]), _text("Answer: \\boxed{", solved["decoded"], "}")]
    return F.array_join(F.concat(F.array(*head), F.transform(solved["steps"], line), F.array(*tail)), "\n")


def explain_ciphers(puzzles: DataFrame, prompt: str = "prompt", words: list[str] = cipher.VOCABULARY) -> DataFrame:
    """``puzzles`` with (decoded, trace); null where the prompt is no cipher puzzle."""
    told = puzzles.withColumn("_m", cipher.mapping(cipher.examples(F.col(prompt)))).withColumn("_q", cipher.query(F.col(prompt)))
    ready = F.col("_m").isNotNull() & F.col("_q").isNotNull()
    done = told.withColumn("_s", F.when(ready, cipher.decode(F.col("_m"), F.col("_q"), cipher.vocabulary_words(words), steps=True)))
    return done.select(*puzzles.columns, F.col("_s.decoded").alias("decoded"), F.when(ready, cipher_trace(F.col("_m"), F.col("_q"), F.col("_s"))).alias("trace"))
