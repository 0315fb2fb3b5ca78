"""Bit-manipulation puzzles: which gates over the input bits give each output bit.

A puzzle's examples are packed by column: input bit i of all examples is one
integer, with the query's bit on top. A gate is then evaluated once for all
examples with bitwise operators, and its result compared with the eight target
columns; the query's value is the top bit of the same result.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions.text import let

# Gate, number of inputs, prior, whether the order of inputs matters; in order.
GATES = (
    ("ID", 1, 40.2, False), ("NOT", 1, 5.0, False),
    ("AND", 2, 14.7, False), ("XOR", 2, 8.1, False), ("XNOR", 2, 7.3, False), ("OR", 2, 7.3, False),
    ("NOR", 2, 5.8, False), ("NAND", 2, 3.4, False), ("INHIB", 2, 2.0, True), ("IMPL", 2, 1.5, True),
    ("MAJ", 3, 0.8, False), ("PAR3", 3, 0.5, False), ("CHO", 3, 0.5, True), ("AO", 3, 0.25, True), ("OA", 3, 0.25, True),
    ("AX", 3, 0.25, True), ("OX", 3, 0.25, True), ("XA", 3, 0.25, True), ("XO", 3, 0.25, True),
    ("AOA", 4, 0.1, True), ("OAO", 4, 0.1, True), ("PAR4", 4, 0.1, False), ("XX", 4, 0.1, True), ("AXA", 4, 0.1, True),
)
CONSTANT_PRIOR = 0.3
SYMMETRIC = ("AND", "OR", "XOR", "XNOR", "NAND", "NOR")
#: Examples of a chunk; they and the query share a long.
MOST_EXAMPLES = 62


def rules(spark: SparkSession, max_arity: int = 4) -> DataFrame:
    """(ordinal, gate, arity, prior, i0..i3): under ten thousand rows, whatever the data."""
    rows = [("C0", 0, CONSTANT_PRIOR, ()), ("C1", 0, CONSTANT_PRIOR, ())]
    for gate, arity, prior, ordered in GATES:
        if arity <= max_arity:
            rows += [(gate, arity, prior, t) for t in (permutations if ordered else combinations)(range(8), arity)]
    padded = [(n, g, a, p, *t, *[None] * (4 - len(t))) for n, (g, a, p, t) in enumerate(rows)]
    return spark.createDataFrame(padded, "ordinal int, gate string, arity int, prior double, i0 int, i1 int, i2 int, i3 int")


def parse(prompt: Column) -> Column:
    """(examples as pairs x, y; query) of a prompt; null without either."""
    pair = r"([01]{8})\s*->\s*([01]{8})"
    pairs = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(pair), F.lit(1)).alias("x"), F.regexp_extract_all(prompt, F.lit(pair), F.lit(2)).alias("y"))
    query = F.regexp_extract(prompt, r"(?i)determine the output for:\s*([01]{8})", 1)
    return F.when((F.size(pairs) > 0) & (query != ""), F.struct(pairs.alias("examples"), query.alias("query")))


def _column(examples: Column, side: str, bit: int) -> Column:
    """Bit ``bit`` (0 is the leftmost) of that side of all examples, example r as bit r."""
    values = F.transform(examples, lambda e, r: F.when(F.substring(e[side], bit + 1, 1) == "1", F.call_function("shiftleft", F.lit(1).cast("long"), r)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))


def packed(puzzles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, chunk, chunks, n, in0..in7 with the query on top, out0..out7) of puzzles (id, examples, query).

    A chunk holds up to MOST_EXAMPLES examples; nearly every puzzle has one.
    """
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size("examples") - 1) / MOST_EXAMPLES), F.lit(0)).cast("int")),
        lambda c: F.slice("examples", c * MOST_EXAMPLES + 1, F.lit(MOST_EXAMPLES)),
    )
    own = puzzles.select(F.col(id_col).alias("id"), "query", F.size(cut).alias("chunks"), F.posexplode(cut).alias("chunk", "some"))
    n = F.size("some")
    top = [F.when(F.substring("query", i + 1, 1) == "1", F.call_function("shiftleft", F.lit(1).cast("long"), n)).otherwise(F.lit(0).cast("long")) for i in range(8)]
    ins = [_column(F.col("some"), "x", i).bitwiseOR(top[i]).alias(f"in{i}") for i in range(8)]
    outs = [_column(F.col("some"), "y", i).alias(f"out{i}") for i in range(8)]
    return own.select("id", "chunk", "chunks", n.alias("n"), *ins, *outs)


def _forms(gate: str, a: Column, b: Column, c: Column = None, d: Column = None) -> Column:
    both, either, odd = a.bitwiseAND(b), a.bitwiseOR(b), a.bitwiseXOR(b)
    return {
        "AND": lambda: both, "XOR": lambda: odd, "XNOR": lambda: F.bitwise_not(odd), "OR": lambda: either, "NOR": lambda: F.bitwise_not(either), "NAND": lambda: F.bitwise_not(both),
        "INHIB": lambda: a.bitwiseAND(F.bitwise_not(b)), "IMPL": lambda: F.bitwise_not(a).bitwiseOR(b),
        "MAJ": lambda: both.bitwiseOR(either.bitwiseAND(c)), "PAR3": lambda: odd.bitwiseXOR(c), "CHO": lambda: both.bitwiseOR(F.bitwise_not(a).bitwiseAND(c)),
        "AO": lambda: both.bitwiseOR(c), "OA": lambda: either.bitwiseAND(c), "AX": lambda: both.bitwiseXOR(c), "OX": lambda: either.bitwiseXOR(c), "XA": lambda: odd.bitwiseAND(c), "XO": lambda: odd.bitwiseOR(c),
        "AOA": lambda: both.bitwiseOR(c.bitwiseAND(d)), "OAO": lambda: either.bitwiseAND(c.bitwiseOR(d)), "PAR4": lambda: odd.bitwiseXOR(c.bitwiseXOR(d)), "AXA": lambda: both.bitwiseXOR(c.bitwiseAND(d)),
    }[gate]()


#: Pairs of inputs; functions of three and four inputs are met from a pair and an input, or from two pairs.
PAIRS = tuple(combinations(range(8), 2))
#: Orders of a function's inputs that are gates of their own, from one of them.
TURNS = {g: ((0, 1, 2), (1, 0, 2)) for g in ("AO", "OA", "AX", "OX", "XA", "XO")} | {
    g: ((0, 1, 2, 3), (1, 0, 2, 3), (0, 1, 3, 2), (1, 0, 3, 2), (2, 3, 0, 1), (3, 2, 0, 1), (2, 3, 1, 0), (3, 2, 1, 0)) for g in ("AOA", "OAO", "AXA")
} | {"XX": tuple(permutations(range(4)))}


def _told(gate: str, v: Column, *inputs: Column) -> Column:
    return F.struct(F.lit(gate).alias("gate"), v.alias("v"), F.array(*inputs).cast("array<int>").alias("t"))


def _wanted(p: dict[str, Column], mask: Column, outs: list[Column], every: Column) -> Column:
    """Output columns that functions of three and of four inputs are asked for: those that no simpler one than the next gives.

    A column that one input gives keeps no function of three, one that two give none of four. Of a puzzle in chunks all are asked for, as a chunk
    can't tell what fits the others.
    """
    cut = lambda v: v.bitwiseAND(mask)
    ins = [p[f"in{i}"] for i in range(8)]
    single = F.array(F.lit(0).cast("long"), mask, *[cut(v) for v in ins], *[cut(F.bitwise_not(v)) for v in ins])
    double = F.array(*[cut(_forms(g, ins[i], ins[j])) for i, j in PAIRS for g in ("AND", "OR", "XOR", "INHIB")], *[cut(_forms("INHIB", ins[j], ins[i])) for i, j in PAIRS])
    def of(sets: Column) -> Column:
        lone = [F.array_contains(sets["single"], o) for o in outs]
        paired = [F.array_contains(sets["double"], o) | F.array_contains(sets["double"], cut(F.bitwise_not(o))) for o in outs]
        three = F.array_compact(F.array(*[F.when(every | ~x, o) for x, o in zip(lone, outs)]))
        four = F.array_compact(F.array(*[F.when(every | ~(x | y), o) for x, y, o in zip(lone, paired, outs)]))
        return F.struct(three.alias("three"), four.alias("four"))

    return let(F.struct(single.alias("single"), double.alias("double")), of)


def candidates(puzzles: DataFrame, max_arity: int = 4, id_col: str = "id", include_higher: bool = False) -> DataFrame:
    """One row per puzzle, output bit and gate that gives it: with the query's value, inputs, prior and ordinal.

    Of the gates that fit, those up to one input more than the fewest are kept. Each function is
    evaluated once whatever the order of its inputs, from the values of pairs, and no row leaves
    its task; only what fits is turned into gates and looked up among the rules.
    """
    spark = puzzles.sparkSession
    own = packed(puzzles, id_col)
    col = {c: F.col(c) for c in own.columns}
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1
    outs = [F.col(f"out{b}") for b in range(8)]
    own = own.withColumn("wanted", _wanted(col, mask, outs, (F.col("chunks") > 1) | F.lit(include_higher)))
    ins = F.array(*[F.col(f"in{i}") for i in range(8)])
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"in{i}").alias("a"), F.col(f"in{j}").alias("b")) for i, j in PAIRS])
    paired = own.select("*", F.inline(pairs))
    partner = lambda kind, k, m, c, d: F.struct(F.lit(kind).alias("kind"), k.alias("k"), m.alias("m"), c.alias("c"), d.alias("d"))
    none, zero = F.lit(-1), F.lit(0).cast("long")
    inputs, others = F.array(*map(F.lit, range(8))), F.array(*[F.struct(F.lit(i).alias("k"), F.lit(j).alias("m")) for i, j in PAIRS])
    i, j = F.col("i"), F.col("j")
    threes = F.transform(F.filter(inputs, lambda k: (k != i) & (k != j)), lambda k: partner(3, k, none, F.get(ins, k), zero))
    fours = F.transform(F.filter(others, lambda x: (x["k"] > i) & (x["k"] != j) & (x["m"] != j)), lambda x: partner(4, x["k"], x["m"], F.get(ins, x["k"]), F.get(ins, x["m"])))
    empty = F.array().cast("array<struct<kind:int,k:int,m:int,c:bigint,d:bigint>>")
    ones = F.when((i == 0) & (j == 1), F.array(partner(1, none, none, zero, zero))).otherwise(empty)
    partners = F.concat(
        ones, F.when(F.lit(max_arity >= 2), F.array(partner(2, none, none, zero, zero))).otherwise(empty),
        F.when(F.lit(max_arity >= 3) & (F.size("wanted.three") > 0), threes).otherwise(empty), F.when(F.lit(max_arity >= 4) & (F.size("wanted.four") > 0), fours).otherwise(empty),
    )
    met = paired.select("*", F.inline(partners))
    a, b, c, d, k, m = (F.col(x) for x in ("a", "b", "c", "d", "k", "m"))
    lone = [_told("C0", F.lit(0).cast("long")), _told("C1", F.lit(-1).cast("long"))]
    lone += [_told(g, f(F.col(f"in{x}")), F.lit(x)) for x in range(8) for g, f in (("ID", lambda v: v), ("NOT", F.bitwise_not))]
    double = [_told(g, _forms(g, a, b), i, j) for g in (*SYMMETRIC, "INHIB", "IMPL")] + [_told(g, _forms(g, b, a), j, i) for g in ("INHIB", "IMPL")]
    triple = [_told(g, _forms(g, a, b, c), i, j, k) for g in TURNS if len(TURNS[g]) == 2] + [_told("CHO", _forms("CHO", a, b, c), i, j, k), _told("CHO", _forms("CHO", b, a, c), j, i, k)]
    # Functions of a set of three are met three times, once in order.
    triple += [F.when(k > j, _told(g, _forms(g, a, b, c), i, j, k)) for g in ("MAJ", "PAR3")]
    quadruple = [_told(g, _forms(g, a, b, c, d), i, j, k, m) for g in ("AOA", "OAO", "AXA")]
    quadruple += [F.when((k > j), _told(g, _forms("PAR4", a, b, c, d), i, j, k, m)) for g in ("PAR4", "XX")]
    gates = F.when(F.col("kind") == 1, F.array(*lone)).when(F.col("kind") == 2, F.array(*double)).when(F.col("kind") == 3, F.array_compact(F.array(*triple))).otherwise(F.array_compact(F.array(*quadruple)))
    asked = F.when(F.col("kind") == 3, F.col("wanted.three")).when(F.col("kind") == 4, F.col("wanted.four")).otherwise(F.array(*outs))
    valued = met.select("id", "chunk", "chunks", "n", "kind", *[f"out{x}" for x in range(8)], asked.alias("asked"), F.inline(gates)).withColumn("told", F.col("v").bitwiseAND(mask))
    valued = valued.filter(F.array_contains("asked", F.col("told")))
    hits = F.array_compact(F.array(*[F.when(F.col("told") == F.col(f"out{x}"), F.lit(x)) for x in range(8)]))
    turned = F.array(F.col("t"))
    for gate, orders in TURNS.items():
        turned = F.when(F.col("gate") == gate, F.array(*[F.array(*[F.get("t", F.lit(x)) for x in o]) for o in orders])).otherwise(turned)
    value = F.call_function("shiftright", F.col("v"), F.col("n")).bitwiseAND(F.lit(1).cast("long")).cast("int").alias("query_value")
    rows = valued.select("id", "chunk", "chunks", "gate", "t", value, F.explode(hits).alias("output_bit"))
    rows = rows.select("id", "chunk", "chunks", "gate", "query_value", "output_bit", F.explode(turned).alias("inputs"))
    # The rules are under ten thousand rows, whatever the data.
    known = rules(spark, max_arity).select("gate", F.array_compact(F.array("i0", "i1", "i2", "i3")).alias("inputs"), "ordinal", "arity", "prior")
    rows = rows.join(F.broadcast(known), ["gate", "inputs"])
    # A gate fits a puzzle of several chunks if it fits each of them.
    many = rows.filter("chunks > 1").groupBy("id", "output_bit", "ordinal").agg(*[F.first(c).alias(c) for c in ("gate", "arity", "prior", "inputs", "query_value", "chunks")], F.count("*").alias("met"))
    columns = ["id", "output_bit", "ordinal", "gate", "arity", "prior", "inputs", "query_value"]
    rows = rows.filter("chunks = 1").select(columns).unionByName(many.filter("met = chunks").select(columns))
    if include_higher:
        return rows
    fewest = F.min("arity").over(Window.partitionBy("id", "output_bit"))
    return rows.withColumn("_f", fewest).filter(F.col("arity") <= F.col("_f") + 1).drop("_f")


def expression(gate: Column, inputs: Column) -> Column:
    """A candidate as text: the gate over its inputs, b0 leftmost; constants are 0 and 1."""
    names = F.array_join(F.transform(inputs, lambda i: F.concat(F.lit("b"), i.cast("string"))), ", ")
    return F.when(gate == "C0", "0").when(gate == "C1", "1").otherwise(F.concat(gate, F.lit("("), names, F.lit(")")))


def _shifts() -> Column:
    plain = F.transform("inputs", lambda i: F.pmod(i - F.col("output_bit"), F.lit(8)))
    return F.when(F.col("gate").isin(*SYMMETRIC), F.array_sort(plain)).otherwise(plain)


def solve(puzzles: DataFrame, max_arity: int = 4, id_col: str = "id") -> DataFrame:
    """(id, prediction, confidence, ambiguous_bits, no_candidate_bits): each bit by a vote of its candidates.

    Scores are exact decimals, so the vote doesn't depend on the order of rows.
    """
    found = candidates(puzzles, max_arity, id_col).withColumn("shifts", _shifts()).withColumn("n_rivals", F.count("*").over(Window.partitionBy("id", "output_bit")))
    weight = F.greatest(F.lit(1.0), F.bround("prior"))
    key = F.struct(F.when(F.col("arity") == 1, "").otherwise(F.col("gate")).alias("gate"), "shifts")
    places = F.col("output_bit") * 100000 + F.col("ordinal")
    votes = found.filter(F.col("arity").isin(1, 2)).groupBy("id", "arity", key.alias("key")).agg(F.sum(weight).alias("w"), F.min(places).alias("first"))
    lead = votes.groupBy("id").agg(
        F.max_by(F.when(F.col("arity") == 1, F.struct("key", "w")), F.when(F.col("arity") == 1, F.struct("w", -F.col("first")))).alias("unary"),
        F.max_by(F.when(F.col("arity") == 2, F.struct("key", "w")), F.when(F.col("arity") == 2, F.struct("w", -F.col("first")))).alias("pair"),
    )
    scored = found.join(lead, "id", "left")
    score = (
        F.col("prior") - 0.4 * F.col("arity") - 0.05 * F.size("inputs")
        - F.when((F.col("arity") == 0) & (F.col("n_rivals") > 1), 8.0).otherwise(0.0)
        - F.when(F.col("arity") >= 3, 1.5 * (F.col("arity") - 2)).otherwise(0.0)
        + F.when((F.col("arity") == 1) & (F.col("unary.w") >= 12) & (F.col("unary.key.shifts") == F.col("shifts")), F.least(F.lit(10.0), F.col("unary.w") / 4)).otherwise(0.0)
        + F.when((F.col("arity") == 2) & (F.col("pair.key") == key), 6.0).otherwise(0.0)
    )
    exact = F.greatest(F.lit(0.05), score).cast("decimal(20,4)")
    ranked = scored.select("id", "output_bit", "query_value", places.alias("place"), score.cast("decimal(20,4)").alias("score"), exact.alias("vote"))
    by_value = ranked.groupBy("id", "output_bit", "query_value").agg(F.sum("vote").alias("votes"), F.max("score").alias("best"), F.min("place").alias("first"))
    by_bit = by_value.groupBy("id", "output_bit").agg(F.max_by("query_value", F.struct("votes", "best", -F.col("first"))).alias("value"), (F.count("*") > 1).alias("ambiguous"))
    listed = by_bit.groupBy("id").agg(F.collect_list(F.struct("output_bit", "value", "ambiguous")).alias("bits"))
    every = puzzles.select(F.col(id_col).alias("id")).join(listed, "id", "left")
    value_of = F.map_from_entries(F.transform(F.coalesce("bits", F.expr("array()")), lambda b: F.struct(b["output_bit"], b["value"])))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.coalesce(F.try_element_at(value_of, b), F.lit(0)).cast("string")), "")
    unsure = F.array_sort(F.transform(F.filter(F.coalesce("bits", F.expr("array()")), lambda b: b["ambiguous"]), lambda b: b["output_bit"]))
    none = F.array_except(F.sequence(F.lit(0), F.lit(7)), F.transform(F.coalesce("bits", F.expr("array()")), lambda b: b["output_bit"]))
    level = F.when(F.size(none) > 0, "low").when(F.size(unsure) == 0, "high").when(F.size(unsure) <= 2, "medium").otherwise("low")
    return every.select("id", text.alias("prediction"), level.alias("confidence"), unsure.alias("ambiguous_bits"), none.alias("no_candidate_bits"))
