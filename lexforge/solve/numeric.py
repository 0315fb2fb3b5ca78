"""Digit equations: which rule turns two operands into the right-hand side.

Every distinct equation is met with the rule space once (operand transforms x base rules; output modes and widths are
read off its right-hand side), and puzzles join what was met by equation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import let, strip

# Operand transforms, base rules and output modes with their complexity.
TRANSFORMS = {"id": 0, "rev": 1}
BASE_RULES = {
    "x + y": 1, "x + y + 1": 1, "x + y - 1": 1, "x - y": 1, "y - x": 1, "|x - y|": 1, "x * y": 2, "x * y + 1": 2, "x * y - 1": 2,
    "concat(x, y)": 2, "concat(y, x)": 2, "x + y^2": 3, "(x + y)^2": 3, "(x - y)^2": 3, "gcd(x, y)": 3,
}
MODES = {
    "plain": 0, "rev": 1, "neg": 1, "neg_rev": 2, "op_prefix": 1, "op_suffix": 1, "op_prefix_if_neg": 1,
    "op_suffix_rev_if_neg": 2, "op_prefix_rev": 2, "op_suffix_rev": 2,
}
# The order in which rules are tried for an operator without an example, and what goes before it.
ABSENT_ORDER = (
    "x + y", "x + y + 1", "x + y - 1", "x * y", "x * y + 1", "x * y - 1", "concat(x, y)", "concat(y, x)",
    "x - y", "y - x", "|x - y|", "x + y^2", "(x + y)^2", "(x - y)^2", "gcd(x, y)",
)
UNSIGNED_MINUS = ("|x - y|", "y - x", "x - y")
SUBTRACTIONS = ("x - y", "y - x", "|x - y|")
PRODUCTS_AFTER_SUMS = {
    "x + y + 1": ("x * y + 1", "x * y", "x * y - 1"), "x + y": ("x * y", "x * y + 1", "x * y - 1"), "x + y - 1": ("x * y - 1", "x * y", "x * y + 1"),
}
# Rules beside which an unseen operator is taken for a subtraction, and those that allow the sign override.
BESIDE_SUBTRACTION = ABSENT_ORDER[:8]
BESIDE_OVERRIDE = (*ABSENT_ORDER[:8], "gcd(x, y)")
# The order in which the short scan tries (transform, rule, mode).
SCAN = (
    ("rev", "x * y", "rev"), ("id", "concat(x, y)", "plain"), ("rev", "x + y", "rev"), ("rev", "x + y + 1", "rev"), ("rev", "x + y - 1", "rev"),
    ("rev", "x * y - 1", "rev"), ("rev", "x * y + 1", "rev"), ("id", "x * y", "plain"), ("id", "concat(y, x)", "plain"), ("id", "x * y + 1", "plain"),
    ("rev", "x - y", "rev"), ("rev", "y - x", "op_suffix_rev_if_neg"), ("id", "x - y", "plain"), ("rev", "concat(x, y)", "rev"), ("id", "x * y - 1", "plain"),
    ("id", "x + y", "plain"), ("id", "x + y + 1", "plain"), ("id", "x + y - 1", "plain"), ("id", "|x - y|", "plain"), ("id", "y - x", "plain"),
    ("rev", "y - x", "op_prefix_rev"), ("rev", "x - y", "neg_rev"), ("rev", "|x - y|", "rev"), ("id", "|x - y|", "op_prefix"), ("id", "x - y", "op_prefix"),
)
_EQUATION = r"^(-?\d+)\s*([^\d\s])\s*(-?\d+)$"
EXAMPLE = "struct<left:string,op:string,right:string,rhs:string>"


def parse(prompt: Column) -> Column:
    """(examples, query) of a prompt, operands as text and the left side as it stands; null unless every left-hand side and the query are equations."""
    pairs = F.transform(F.regexp_extract_all(prompt, F.lit(r"[^\n=]+\s*=\s*[^\n]+"), F.lit(0)), lambda t: F.struct(strip(F.substring_index(t, "=", 1)).alias("l"), strip(F.substr(t, F.instr(t, "=") + 1)).alias("r")))
    asked = strip(F.regexp_extract(prompt, r"(?i)determine the result for:\s*([^\n]+)", 1))

    def equation(text: Column, value: Column) -> Column:
        return F.struct(*[F.regexp_extract(text, _EQUATION, k).alias(n) for k, n in enumerate(("left", "op", "right"), 1)], value.alias("rhs"), text.alias("lhs"))

    def of(m: Column) -> Column:
        ok = (F.size(m["pairs"]) > 0) & F.forall(m["pairs"], lambda z: z["l"].rlike(_EQUATION)) & m["asked"].rlike(_EQUATION)
        return F.when(ok, F.struct(F.transform(m["pairs"], lambda z: equation(z["l"], z["r"])).alias("examples"), equation(m["asked"], F.lit("")).alias("query")))

    # Bound once: the prompt is read by two patterns whatever is made of them.
    return let(F.struct(pairs.alias("pairs"), asked.alias("asked")), of)


def puzzles(prompts: DataFrame, id_col: str = "id", prompt_col: str = "prompt") -> DataFrame:
    """(id, examples, query) of the prompts that are such puzzles, each read once."""
    # A generated row is not merged with what uses it, as a column would be.
    told = F.explode(F.array_compact(F.array(parse(F.col(prompt_col)))))
    return prompts.select(F.col(id_col).alias("id"), told.alias("p")).select("id", "p.examples", "p.query")


def reverse_text(text: Column) -> Column:
    return F.when(text.startswith("-"), F.concat(F.lit("-"), F.reverse(F.substr(text, F.lit(2))))).otherwise(F.reverse(text))


def operand(text: Column, transform: Column) -> Column:
    return F.when(transform == "rev", reverse_text(text)).otherwise(text).try_cast("long")


def gcd(a: Column, b: Column) -> Column:
    """0 if either is 0; Euclid's steps, of which each digit of the smaller number takes five at most."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    steps = F.sequence(F.lit(0), 5 * F.length(F.least(F.abs(a), F.abs(b)).cast("string")))
    run = F.aggregate(steps, start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(run["a"])


def rule_form(x: Column, y: Column, rule: str) -> Column:
    """The rule's value; null where a long can't hold it."""
    add, sub, mul = F.try_add(x, y), F.try_subtract(x, y), F.try_multiply(x, y)
    glue = lambda a, b: F.concat(F.abs(a).cast("string"), F.abs(b).cast("string")).try_cast("long")
    return {
        "x + y": add, "x + y + 1": F.try_add(add, F.lit(1)), "x + y - 1": F.try_subtract(add, F.lit(1)), "x - y": sub, "y - x": F.try_subtract(y, x), "|x - y|": F.abs(sub),
        "x * y": mul, "x * y + 1": F.try_add(mul, F.lit(1)), "x * y - 1": F.try_subtract(mul, F.lit(1)), "concat(x, y)": glue(x, y), "concat(y, x)": glue(y, x),
        "x + y^2": F.try_add(x, F.try_multiply(y, y)), "(x + y)^2": F.try_multiply(add, add), "(x - y)^2": F.try_multiply(sub, sub), "gcd(x, y)": gcd(x, y),
    }[rule]


def apply_rule(x: Column, y: Column, rule: Column) -> Column:
    """The value of the rule that a column names."""
    out = None
    for name in BASE_RULES:
        out = F.when(rule == name, rule_form(x, y, name)) if out is None else out.when(rule == name, rule_form(x, y, name))
    return out


def written(v: Column, mode: Column, op: Column, width: Column) -> Column:
    """A value as the mode writes it; digits are filled with zeros to the width, reversed modes keep a sign in front."""
    size = F.abs(v).cast("string")
    wide = F.when(width.isNull(), size).otherwise(F.lpad(size, F.greatest(F.length(size), width), F.lit("0")))
    sign = F.when(v < 0, "-").otherwise("")
    plain, back = F.concat(sign, wide), F.concat(sign, F.reverse(wide))
    return (
        F.when(mode == "plain", plain).when(mode == "rev", back)
        .when(mode == "neg", F.concat(F.lit("-"), wide)).when(mode == "neg_rev", F.concat(F.lit("-"), F.reverse(wide)))
        .when(mode == "op_prefix", F.concat(op, plain)).when(mode == "op_suffix", F.concat(plain, op))
        .when(mode == "op_prefix_rev", F.concat(op, back)).when(mode == "op_suffix_rev", F.concat(back, op))
        .when(mode == "op_prefix_if_neg", F.when(v < 0, F.concat(op, wide)).otherwise(size))
        .when(mode == "op_suffix_rev_if_neg", F.when(v < 0, F.concat(F.reverse(wide), op)).otherwise(size))
    )


def predict(example: Column, lt: Column, rt: Column, rule: Column, mode: Column, width: Column) -> Column:
    value = apply_rule(operand(example["left"], lt), operand(example["right"], rt), rule)
    return let(value, lambda v: written(v, mode, example["op"], width))


def widths(examples: Column) -> Column:
    """No width, and the digit lengths of right-hand sides without operator and sign."""
    def digits(e: Column) -> Column:
        rhs = F.when(e["rhs"].startswith(e["op"]), F.substr(e["rhs"], F.length(e["op"]) + 1)).otherwise(e["rhs"])
        rhs = F.when(rhs.endswith(e["op"]), F.substr(rhs, F.lit(1), F.length(rhs) - F.length(e["op"]))).otherwise(rhs)
        rhs = F.regexp_replace(rhs, "^-", "")
        return F.when(rhs.rlike(r"^\d+$"), F.length(rhs))

    return F.concat(F.array(F.lit(None).cast("int")), F.array_sort(F.array_distinct(F.array_compact(F.transform(examples, digits)))))


def by_operator(puzzles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, op, examples in order, place of the first of them) of puzzles (id, examples, query)."""
    each = puzzles.select(F.col(id_col).alias("id"), F.posexplode("examples").alias("k", "e"))
    grouped = each.groupBy("id", F.col("e.op").alias("op")).agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("s"))
    return grouped.select("id", "op", F.transform("s", lambda s: s["e"]).alias("examples"), F.get("s", F.lit(0))["k"].alias("op_place"))


def readings(op: Column, rhs: Column) -> Column:
    """What a right-hand side can be: structs (mode, value, lo, hi, bare), each a value that the mode writes so.

    It does under widths from ``lo`` to ``hi``, and without one where ``bare``. This is ``written`` turned round, so values need
    not be written under every mode and width.
    """
    def entry(mode: str, negative: Column, digits: Column, padded: bool = True) -> Column:
        def of(t: Column) -> Column:
            value, bare = t["size"].try_cast("long"), t["size"] == t["digits"]
            high = F.length(t["digits"]) if padded else F.lit(1 << 30)
            told = F.struct(
                F.lit(mode).alias("mode"), F.when(negative, F.negate(value)).otherwise(value).alias("value"), F.when(bare, F.lit(0)).otherwise(F.length(t["digits"])).alias("lo"), high.alias("hi"), bare.alias("bare")
            )
            return F.when(value.isNotNull() & ~(negative & (value == 0)) & (bare | F.lit(padded)), told)

        return let(F.struct(digits.alias("digits"), F.regexp_replace(digits, r"^0+(?=\d)", "").alias("size")), of)

    def parts(text: Column, body) -> Column:
        """The entries of a text of digits with or without a sign, else none."""
        told = F.struct(text.startswith("-").alias("neg"), F.regexp_replace(text, "^-", "").alias("d"), F.reverse(F.regexp_replace(text, "^-", "")).alias("back"))
        return F.when(text.rlike(r"^-?\d+$"), let(told, lambda p: F.array(*body(p))))

    yes, no = F.lit(True), F.lit(False)
    plain = parts(rhs, lambda p: [
        entry("plain", p["neg"], p["d"]), entry("rev", p["neg"], p["back"]),
        *[F.when(~p["neg"], entry(m, no, p["d"], False)) for m in ("op_prefix_if_neg", "op_suffix_rev_if_neg")],
        *[F.when(p["neg"], entry(m, sign, p[d])) for m, d in (("neg", "d"), ("neg_rev", "back")) for sign in (no, yes)],
    ])
    after = F.when(rhs.startswith(op), F.substr(rhs, F.length(op) + 1))
    before = F.when(rhs.endswith(op), F.substr(rhs, F.lit(1), F.length(rhs) - F.length(op)))
    marked = parts(after, lambda p: [entry("op_prefix", p["neg"], p["d"]), entry("op_prefix_rev", p["neg"], p["back"]), F.when(~p["neg"], entry("op_prefix_if_neg", yes, p["d"]))])
    ended = parts(before, lambda p: [entry("op_suffix", p["neg"], p["d"]), entry("op_suffix_rev", p["neg"], p["back"]), F.when(~p["neg"], entry("op_suffix_rev_if_neg", yes, p["back"]))])
    return F.array_compact(F.flatten(F.array_compact(F.array(plain, marked, ended))))


def met_rules(equations: DataFrame) -> DataFrame:
    """(left, op, right, rhs, lt, rt, rule, cost, mode, lo, hi, bare): every rule that gives a distinct equation, each value made once.

    Transforms and rules are rows made from constant arrays and modes come from the right-hand side, so no
    table is held against another.
    """
    own = equations.select("left", "op", "right", "rhs").distinct().withColumn("told", readings(F.col("op"), F.col("rhs")))
    own = own.withColumn("values", F.transform("told", lambda z: z["value"])).filter(F.size("told") > 0)
    turns = F.array(*[
        F.struct(F.lit(lt).alias("lt"), F.lit(rt).alias("rt"), operand(F.col("left"), F.lit(lt)).alias("x"), operand(F.col("right"), F.lit(rt)).alias("y"), F.lit(c1 + c2).alias("cost"))
        for lt, c1 in TRANSFORMS.items() for rt, c2 in TRANSFORMS.items()
    ])
    turned = own.select("*", F.inline(turns))
    x, y = F.col("x"), F.col("y")
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), rule_form(x, y, r).alias("value"), F.lit(c).alias("c3")) for r, c in BASE_RULES.items()])
    made = turned.select("left", "op", "right", "rhs", "told", "values", "lt", "rt", "cost", F.inline(rules)).filter(F.array_contains("values", F.col("value")))
    hits = F.explode(F.filter("told", lambda z: z["value"] == F.col("value")))
    return made.select("left", "op", "right", "rhs", "lt", "rt", "rule", (F.col("cost") + F.col("c3")).alias("cost"), hits.alias("m")).select("left", "op", "right", "rhs", "lt", "rt", "rule", "cost", "m.*").drop("value")


def candidates(puzzles: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per puzzle, operator and rule that gives every example of the operator exactly.

    Distinct equations are met with the rules once; puzzles join what was met by equation, and a rule that gives
    all of an operator's examples is one that was counted so often.
    """
    own = by_operator(puzzles, id_col)
    each = own.select("id", "op", F.size("examples").alias("n"), F.explode("examples").alias("e")).select("id", "op", "n", "e.left", "e.right", "e.rhs")
    met = each.join(met_rules(each), ["left", "op", "right", "rhs"])
    counted = met.groupBy("id", "op", "n", "lt", "rt", "rule", "cost", "mode").agg(F.count("*").alias("given"), F.min("bare").alias("bare"), F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    whole = counted.filter((F.col("given") == F.col("n")) & (F.col("bare") | (F.col("lo") <= F.col("hi"))))
    sized = whole.drop("n").join(own.withColumn("width", F.explode(widths(F.col("examples")))), ["id", "op"])
    fits = sized.filter(F.when(F.col("width").isNull(), F.col("bare")).otherwise(F.col("width").between(F.col("lo"), F.col("hi"))))
    cost = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])[F.col("mode")]
    text = F.concat(F.col("mode"), F.lit("("), "rule", F.lit(" on "), "lt", F.lit(","), "rt", F.when(F.col("width").isNotNull(), F.concat(F.lit(", width="), F.col("width").cast("string"))).otherwise(""), F.lit(")"))
    return fits.select(
        "id", "op", "examples", "op_place", "lt", "rt", "rule", "mode", "width", (F.col("cost") + cost + F.col("width").isNotNull().cast("int")).alias("complexity"), text.alias("description")
    )


def ranked(found: DataFrame) -> DataFrame:
    """The candidates with their place among those of their puzzle and operator, 1 the best, with support from operators whose two or more examples leave one signature."""
    sure = found.filter(F.size("examples") >= 2)
    signatures = {"family": F.struct("lt", "rt", "mode", "width"), "transform": F.struct("lt", "rt", "mode"), "output": F.col("mode")}
    ranked = found
    for name, signature in signatures.items():
        single = sure.groupBy("id", "op").agg(F.min(signature).alias("s"), F.max(signature).alias("t")).filter(F.col("s").eqNullSafe(F.col("t")))
        votes = single.groupBy(F.col("id").alias("_id"), "s").agg(F.count("*").alias(name))
        ranked = ranked.join(votes, (F.col("id") == F.col("_id")) & signature.eqNullSafe(F.col("s")), "left").drop("_id", "s").withColumn(name, F.coalesce(name, F.lit(0)))
    group = Window.partitionBy("id", "op", "lt", "rt", "mode", F.coalesce("width", F.lit(-1)))
    sibling = F.max(F.col("rule").isin("x - y", "y - x")).over(group)
    signed = F.when(F.col("mode") == "op_prefix_if_neg", F.exists("examples", lambda e: e["rhs"].startswith("-") | e["rhs"].startswith(e["op"]))).otherwise(F.exists("examples", lambda e: e["rhs"].contains("-")))
    absolute = (F.col("rule") == "|x - y|") & F.col("mode").isin("plain", "op_prefix", "op_prefix_rev", "op_prefix_if_neg") & ~signed & sibling
    order = Window.partitionBy("id", "op").orderBy(F.desc(absolute.cast("int")), F.desc("family"), F.desc("transform"), F.desc("output"), "complexity", "description")
    return ranked.withColumn("place", F.row_number().over(order))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def _signature(c: Column) -> Column:
    return F.struct(c["lt"].alias("lt"), c["rt"].alias("rt"), c["mode"].alias("mode"))


def _is(signature: Column, lt: str, rt: str, mode: str) -> Column:
    return (signature["lt"] == lt) & (signature["rt"] == rt) & (signature["mode"] == mode)


def _rule(lt: Column, rt: Column, rule: Column, mode: Column, width: Column, basis: Column) -> Column:
    return F.struct(lt.alias("lt"), rt.alias("rt"), rule.alias("rule"), mode.alias("mode"), width.cast("int").alias("width"), basis.alias("basis"))


def _only_in(values: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(values, F.array(*map(F.lit, allowed)))) == 0


def _absent(cands: Column, seen: Column, examples: Column, query: Column) -> Column:
    """The rule for an operator without an example: a marked subtraction beside plain sums and products, else
    the first unused rule under the motif that most examples support; null where the motif is tied or too thin."""
    signatures = F.array_distinct(F.transform(seen, _signature))
    rules = F.array_distinct(F.transform(seen, lambda c: c["rule"]))
    one = F.get(signatures, F.lit(0))
    beside = (F.size(signatures) == 1) & _only_in(rules, BESIDE_SUBTRACTION)
    none, minus = F.lit(None).cast("int"), F.lit("|x - y|")
    marked = F.when(beside & _is(one, "id", "id", "plain"), _rule(F.lit("id"), F.lit("id"), minus, F.lit("op_prefix"), none, F.lit("subtraction"))).when(
        beside & _is(one, "rev", "rev", "rev"), _rule(F.lit("rev"), F.lit("rev"), minus, F.lit("op_prefix_rev"), none, F.lit("subtraction"))
    )

    def of_motif(scored: Column) -> Column:
        best, second = F.get(scored, F.lit(0)), F.get(scored, F.lit(1))
        clear = best.isNotNull() & (second.isNull() | (best["n"] != second["n"]))
        return F.when(clear, let(F.filter(cands, lambda c: _signature(c) == best["s"]), of_candidates))

    def of_candidates(some: Column) -> Column:
        used = F.array_distinct(F.transform(some, lambda c: c["rule"]))
        return F.when(F.exists(some, lambda c: c["k"] >= 2), let(F.struct(some.alias("some"), used.alias("used"), F.transform(some, lambda c: c["width"]).alias("widths")), of_used))

    def of_used(m: Column) -> Column:
        counts = F.transform(F.array_distinct(m["widths"]), lambda w: F.struct(_sum(F.transform(m["widths"], lambda x: (x == w).cast("long"))).alias("n"), (-F.array_position(m["widths"], w)).alias("first"), w.alias("w")))
        width = F.when(F.exists(m["widths"], lambda w: w.isNull()), none).otherwise(F.array_max(counts)["w"])
        unsigned = (F.size(examples) > 0) & F.forall(examples, lambda e: ~e["rhs"].startswith("-"))
        head = F.when((query["op"] == "-") & unsigned, F.array(*map(F.lit, UNSIGNED_MINUS))).otherwise(F.array().cast("array<string>"))
        sums = F.concat(*[F.when(F.array_contains(m["used"], s), F.array(*map(F.lit, p))).otherwise(F.array().cast("array<string>")) for s, p in PRODUCTS_AFTER_SUMS.items()])
        products = F.when(F.arrays_overlap(m["used"], F.array(*map(F.lit, SUBTRACTIONS))), sums).otherwise(F.array().cast("array<string>"))
        order = F.array_distinct(F.concat(head, products, F.array(*map(F.lit, ABSENT_ORDER))))
        rule, lead = F.get(F.array_except(order, m["used"]), F.lit(0)), F.get(m["some"], F.lit(0))
        return F.when(rule.isNotNull(), _rule(lead["lt"], lead["rt"], rule, lead["mode"], width, F.lit("motif")))

    # An operator counts once for a signature, with its number of examples.
    per = F.array_distinct(F.transform(cands, lambda c: F.struct(_signature(c).alias("s"), c["op"].alias("op"), F.greatest(F.lit(1), c["k"]).cast("long").alias("k"))))
    votes = let(per, lambda p: F.transform(F.array_distinct(F.transform(p, lambda x: x["s"])), lambda s: F.struct(_sum(F.transform(F.filter(p, lambda x: x["s"] == s), lambda x: x["k"])).alias("n"), s.alias("s"))))
    return F.when(F.size(cands) > 0, F.coalesce(marked, let(F.sort_array(votes, asc=False), of_motif)))


def _answered(query: Column, r: Column) -> Column:
    return F.when(r.isNotNull(), predict(query, r["lt"], r["rt"], r["rule"], r["mode"], r["width"]))


def described(r: Column) -> Column:
    width = F.when(r["width"].isNotNull(), F.concat(F.lit(", width="), r["width"].cast("string"))).otherwise("")
    return F.when(r.isNotNull(), F.concat(r["mode"], F.lit("("), r["rule"], F.lit(" on "), r["lt"], F.lit(","), r["rt"], width, F.lit(")")))


def considered(puzzles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, examples, query, cands): each puzzle with its candidates as one array, by operator, complexity and description."""
    fields = ["op_place", "complexity", "description", "op", "lt", "rt", "rule", "mode", "width", "place", "family", "transform", "output"]
    listed = ranked(candidates(puzzles, id_col)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*fields, F.size("examples").alias("k")))).alias("cands"))
    own = puzzles.select(F.col(id_col).alias("id"), "examples", "query")
    none = F.array().cast(listed.schema["cands"].dataType)
    return own.join(listed, "id", "left").withColumn("cands", F.coalesce("cands", none))


def _solved(cands: Column, examples: Column, query: Column) -> Column:
    """(prediction, confidence, n_candidates, n_examples, rule) of a puzzle."""
    own = F.filter(cands, lambda c: c["op"] == query["op"])
    seen = F.filter(cands, lambda c: (c["place"] == 1) & (c["op"] != query["op"]))
    k = F.size(F.filter(examples, lambda e: e["op"] == query["op"]))

    def of(m: Column) -> Column:
        best = F.get(F.filter(m["own"], lambda c: c["place"] == 1), F.lit(0))
        told = F.when(best.isNotNull(), _rule(best["lt"], best["rt"], best["rule"], best["mode"], best["width"], F.lit("examples")))
        guess = F.when(m["k"] == 0, _absent(cands, m["seen"], examples, query))
        n_values = F.size(F.array_distinct(F.transform(m["own"], lambda c: predict(query, c["lt"], c["rt"], c["rule"], c["mode"], c["width"]))))
        support = F.when((best["family"] > 0) | (best["transform"] > 0), "high").when(best["output"] > 0, "medium").otherwise("low")
        rule = F.coalesce(told, guess)

        def ended(r: Column) -> Column:
            level = (
                F.when(r.isNull(), F.when(m["k"] == 0, "none").otherwise("low")).when(r["basis"] != "examples", "medium")
                .when(n_values == 1, "high").when(m["k"] == 1, support).otherwise("low")
            )
            return F.struct(_answered(query, r).alias("prediction"), level.alias("confidence"), F.size(m["own"]).alias("n_candidates"), m["k"].alias("n_examples"), r.alias("rule"), m["seen"].alias("seen"))

        return let(rule, ended)

    return let(F.struct(own.alias("own"), seen.alias("seen"), k.alias("k")), of)


def solve(puzzles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, prediction, description, n_candidates, n_examples, confidence, basis) for the query.

    ``basis`` tells whether the rule comes from the operator's examples, from a
    motif of the others or is a marked subtraction; null where there is no rule.
    """
    done = considered(puzzles, id_col).withColumn("r", _solved(F.col("cands"), F.col("examples"), F.col("query")))
    return done.select("id", "r.prediction", described(F.col("r.rule")).alias("description"), "r.n_candidates", "r.n_examples", "r.confidence", F.col("r.rule.basis").alias("basis"))


def solve_by_scan(puzzles: DataFrame, id_col: str = "id", fallback: bool = True) -> DataFrame:
    """(id, prediction, confidence, rank, description, used_fallback): the short scan first, the whole search where it does not do.

    The search answers where the scan finds nothing or the operator has no example,
    and overrules a scan of one example whose motif none of the other operators
    shares while they agree on another. A negative answer from one example beside
    plain sums and products is written with the operator for its sign, where such
    a rule fits the example. Without ``fallback`` the scan alone answers.
    """
    first = scan(puzzles, id_col).withColumnRenamed("prediction", "scanned").withColumnRenamed("id", "_id")
    if not fallback:
        own = puzzles.select(F.col(id_col).alias("id"), F.size(F.filter("examples", lambda e: e["op"] == F.col("query")["op"])).alias("k"))
        done = own.join(first, F.col("id") == F.col("_id"), "left")
        level = F.when(F.col("scanned").isNull(), "none").when(F.col("k") >= 2, "high").otherwise("medium")
        text = described(F.when(F.col("rule").isNotNull(), F.struct(F.col("transform").alias("lt"), F.col("transform").alias("rt"), "rule", "mode", "width")))
        return done.select("id", F.col("scanned").alias("prediction"), level.alias("confidence"), "rank", text.alias("description"), F.lit(False).alias("used_fallback"))
    done = considered(puzzles, id_col).withColumn("r", _solved(F.col("cands"), F.col("examples"), F.col("query"))).join(first, F.col("id") == F.col("_id"), "left")
    signatures = F.array_distinct(F.transform("r.seen", _signature))
    single = F.size(signatures) == 1
    own = F.struct(F.col("transform").alias("lt"), F.col("transform").alias("rt"), "rule", "mode", "width")
    scanned = F.col("rank").isNotNull()
    chosen = F.col("r.rule")
    overruled = scanned & (F.col("r.n_examples") == 1) & single & (chosen["basis"] == "examples") & (_signature(chosen) == F.get(signatures, F.lit(0))) & (_signature(own) != F.get(signatures, F.lit(0)))
    by_scan = scanned & ~F.coalesce(overruled, F.lit(False))
    prediction = F.when(by_scan, F.col("scanned")).otherwise(F.col("r.prediction"))
    signed = F.filter("cands", lambda c: (c["op"] == F.col("query")["op"]) & _is(c, "id", "id", "op_prefix_if_neg") & c["rule"].isin("x - y", "y - x") & c["width"].isNull())
    may = (
        prediction.startswith("-") & (F.col("r.n_examples") == 1) & single & _is(F.get(signatures, F.lit(0)), "id", "id", "plain")
        & _only_in(F.transform("r.seen", lambda c: c["rule"]), BESIDE_OVERRIDE) & ~F.coalesce(overruled, F.lit(False))
    )
    sign = F.when(may, F.get(signed, F.lit(0)))
    answer = F.coalesce(_answered(F.col("query"), sign), prediction)
    level = F.when(sign.isNotNull(), "medium").when(by_scan, F.when(F.col("r.n_examples") >= 2, "high").otherwise("medium")).otherwise(F.col("r.confidence"))
    text = F.coalesce(described(sign), F.when(by_scan, described(own)).otherwise(described(chosen)))
    return done.select("id", answer.alias("prediction"), level.alias("confidence"), F.when(by_scan & sign.isNull(), F.col("rank")).alias("rank"), text.alias("description"), (~by_scan | sign.isNotNull()).alias("used_fallback"))


def scan(puzzles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, rank, transform, rule, mode, width, prediction) of the first of the ordered rules that fits the query operator's examples."""
    own = puzzles.select(F.col(id_col).alias("id"), "query", F.filter("examples", lambda e: e["op"] == F.col("query")["op"]).alias("examples")).filter(F.size("examples") > 0)
    order = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t"), F.lit(r).alias("rule"), F.lit(m).alias("mode")) for k, (t, r, m) in enumerate(SCAN)])
    tried = own.withColumn("w", widths(F.col("examples"))).select("id", "query", "examples", F.size("w").alias("nw"), F.posexplode("w").alias("j", "width"), order.alias("order")).withColumn("c", F.explode("order"))
    rule = [F.col("c.t"), F.col("c.t"), F.col("c.rule"), F.col("c.mode"), F.col("width")]
    fits = tried.filter(F.forall("examples", lambda e: predict(e, *rule) == e["rhs"]))
    rank = F.col("c.k") * F.col("nw") + F.col("j") + 1
    first = fits.groupBy("id").agg(F.min_by(F.struct(rank.alias("rank"), F.col("c.t").alias("transform"), F.col("c.rule").alias("rule"), F.col("c.mode").alias("mode"), "width", predict(F.col("query"), *rule).alias("prediction")), rank).alias("r"))
    return first.select("id", "r.*")
