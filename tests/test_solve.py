import random
from itertools import combinations, permutations

from pyspark.sql import functions as F

from lexforge.solve import bit, cipher, formula, numeric, symbol

FORMS = {
    "ID": lambda a: a, "NOT": lambda a: 1 - a, "AND": lambda a, b: a & b, "XOR": lambda a, b: a ^ b, "XNOR": lambda a, b: 1 - (a ^ b), "OR": lambda a, b: a | b,
    "NOR": lambda a, b: 1 - (a | b), "NAND": lambda a, b: 1 - (a & b), "INHIB": lambda a, b: a & (1 - b), "IMPL": lambda a, b: (1 - a) | b,
    "MAJ": lambda a, b, c: int(a + b + c > 1), "PAR3": lambda a, b, c: a ^ b ^ c, "CHO": lambda a, b, c: b if a else c,
    "AO": lambda a, b, c: (a & b) | c, "OA": lambda a, b, c: (a | b) & c, "AX": lambda a, b, c: (a & b) ^ c, "OX": lambda a, b, c: (a | b) ^ c, "XA": lambda a, b, c: (a ^ b) & c, "XO": lambda a, b, c: (a ^ b) | c,
}


def test_bit_candidates_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(4):
        x = [f"{rng.randrange(256):08b}" for _ in range(7)]
        y = ["".join(str(int(v[(b + 1) % 8]) ^ (int(v[b]) if i % 2 else 0)) for b in range(8)) for v in x]
        rows.append((i, f"rules\n{chr(10).join(f'{a} -> {b}' for a, b in zip(x, y))}\nNow, determine the output for: {rng.randrange(256):08b}"))
    df = spark.createDataFrame(rows, "id int, prompt string").withColumn("p", bit.parse(F.col("prompt"))).select("id", "p.examples", "p.query")
    want = set()
    for r in df.collect():
        for b in range(8):
            target = [int(e.y[b]) for e in r.examples]
            found = [(0, f"C{v}", (), v) for v in (0, 1) if all(t == v for t in target)]
            for gate, arity, _, ordered in bit.GATES:
                if arity <= 3:
                    for t in (permutations if ordered else combinations)(range(8), arity):
                        if all(FORMS[gate](*(int(e.x[k]) for k in t)) == v for e, v in zip(r.examples, target)):
                            found.append((arity, gate, t, FORMS[gate](*(int(r.query[k]) for k in t))))
            least = min((f[0] for f in found), default=0)
            want |= {(r.id, b, g, t, v) for a, g, t, v in found if a <= least + 1}
    got = {(r.id, r.output_bit, r.gate, tuple(r.inputs), r.query_value) for r in bit.candidates(df, 3).collect()}
    assert got == want
    truth = {r.id: "".join(str(int(r.query[(b + 1) % 8]) ^ (int(r.query[b]) if r.id % 2 else 0)) for b in range(8)) for r in df.collect()}
    solved = {r.id: r.prediction for r in bit.solve(df, 2).collect()}
    assert solved[0] == truth[0] and solved[2] == truth[2] and set(solved) == set(truth)


def test_cipher(spark):
    prompt = "Look:\nbcd bef -> cat cad\nxx -> zz\nNow, decrypt the following text: bcgr bcd"
    df = spark.createDataFrame([(1, prompt), (2, "ab -> x\nNow, decrypt the following text: q"), (3, "ab -> xy\naz -> zz\nNow, decrypt the following text: q")], "id int, prompt string")
    got = {r.id: r for r in cipher.solve(df, words=["cave", "cat", "cab"]).collect()}
    assert got[1].decoded == "cave cat" and got[1].unique and got[2].decoded is None and got[3].decoded is None
    row = spark.range(1).select(cipher.pattern(F.lit("hello")).alias("p")).first()
    assert row.p == [1, 2, 3, 3, 4]


def test_numeric(spark):
    cases = [("plain", -7, None, "-7"), ("rev", -120, None, "-021"), ("neg", 5, 3, "-005"), ("op_prefix_if_neg", -4, None, "+4"), ("op_suffix_rev_if_neg", -12, None, "21+"), ("op_suffix_rev", 120, None, "021+"), ("plain", 12345, 3, "12345")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, m string, v long, w int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", numeric.written(F.col("v"), F.col("m"), F.lit("+"), F.col("w"))).collect())
    prompt = "Rules\n12 + 34 = 64\n25 + 11 = 63\n12 * 20 = 240\nNow, determine the result for: 31 + 22"
    puzzles = spark.createDataFrame([(1, prompt), (2, "1 + 2 = 3\nx = y\nNow, determine the result for: 1 + 1")], "id int, prompt string").withColumn("p", numeric.parse(F.col("prompt"))).filter("p IS NOT NULL").select("id", "p.examples", "p.query")
    assert [r.id for r in puzzles.collect()] == [1]
    found = {(r.op, r.description) for r in numeric.candidates(puzzles).collect()}
    assert ("+", "rev(x + y on id,id)") in found and ("*", "plain(x * y on id,id)") in found
    assert numeric.solve(puzzles).first().prediction == "35"
    row = spark.range(1).select(*[numeric.gcd(F.lit(a).cast("long"), F.lit(b).cast("long")).alias(f"g{a}_{b}") for a, b in ((12, 18), (0, 5), (7, 13))]).first()
    assert tuple(row) == (6, 0, 1)


def test_symbol_and_formula(spark):
    prompt = "ab+cd = cdab\nqr+st = stqr\nNow, determine the result for: wx+yz"
    df = spark.createDataFrame([(1, prompt)], "id int, prompt string").withColumn("p", symbol.parse(F.col("prompt"))).select("id", "p.examples", "p.query")
    assert tuple(symbol.direct(df).first()) == (1, "3401", "yzwx", "high")
    got = spark.createDataFrame([(14,), (1994,), (0,), (3999,)], "n int").select(formula.roman(F.col("n")).alias("r")).collect()
    assert [r.r for r in got] == ["XIV", "MCMXCIV", None, "MMMCMXCIX"]
