"""The search for digit rules against plain arithmetic over the whole rule space."""

import math
import random

from pyspark.sql import functions as F

from lexforge.solve import numeric

LIMIT = 1 << 63


def turned(text, how):
    sign, digits = ("-", text[1:]) if text[0] == "-" else ("", text)
    return int(sign + (digits[::-1] if how == "rev" else digits))


def value(rule, x, y):
    glue = lambda a, b: int(f"{abs(a)}{abs(b)}")
    made = {
        "x + y": x + y, "x + y + 1": x + y + 1, "x + y - 1": x + y - 1, "x - y": x - y, "y - x": y - x, "|x - y|": abs(x - y), "x * y": x * y, "x * y + 1": x * y + 1, "x * y - 1": x * y - 1,
        "concat(x, y)": glue(x, y), "concat(y, x)": glue(y, x), "x + y^2": x + y * y, "(x + y)^2": (x + y) ** 2, "(x - y)^2": (x - y) ** 2, "gcd(x, y)": math.gcd(x, y) if x and y else 0,
    }[rule]
    return made if abs(made) < LIMIT else None


def text(v, mode, op, width):
    bare = str(abs(v))
    wide = bare.zfill(width or 0)
    sign = "-" if v < 0 else ""
    if mode.endswith("if_neg"):
        return bare if v >= 0 else op + wide if mode == "op_prefix_if_neg" else wide[::-1] + op
    return {
        "plain": sign + wide, "rev": sign + wide[::-1], "neg": "-" + wide, "neg_rev": "-" + wide[::-1], "op_prefix": op + sign + wide, "op_suffix": sign + wide + op,
        "op_prefix_rev": op + sign + wide[::-1], "op_suffix_rev": sign + wide[::-1] + op,
    }[mode]


def brute(puzzles):
    out = set()
    for i, examples in puzzles:
        for op in {e[1] for e in examples}:
            own = [e for e in examples if e[1] == op]
            sizes = {None}
            for _, o, _, rhs in own:
                rhs = rhs.removeprefix(o).removesuffix(o).removeprefix("-")
                sizes |= {len(rhs)} if rhs.isdigit() else set()
            for lt in ("id", "rev"):
                for rt in ("id", "rev"):
                    for rule in numeric.BASE_RULES:
                        values = [value(rule, turned(a, lt), turned(b, rt)) for a, _, b, _ in own]
                        if None in values:
                            continue
                        for mode in numeric.MODES:
                            for w in sizes:
                                if all(text(v, mode, op, w) == e[3] for v, e in zip(values, own)):
                                    cost = numeric.TRANSFORMS[lt] + numeric.TRANSFORMS[rt] + numeric.BASE_RULES[rule] + numeric.MODES[mode] + (w is not None)
                                    out.add((i, op, lt, rt, rule, mode, w, cost))
    return out


SCHEMA = "id int, examples array<struct<left:string,op:string,right:string,rhs:string>>"


def found(spark, puzzles):
    rows = numeric.candidates(spark.createDataFrame(puzzles, SCHEMA)).collect()
    out = {(r.id, r.op, r.lt, r.rt, r.rule, r.mode, r.width, r.complexity) for r in rows}
    assert len(out) == len(rows)
    return out


def test_candidates_against_the_whole_rule_space(spark):
    rng = random.Random(3)
    puzzles = []
    for i in range(60):
        examples = []
        for op in rng.sample("+-*/#", rng.randint(1, 2)):
            lt, rt, rule, mode, width = rng.choice(["id", "rev"]), rng.choice(["id", "rev"]), rng.choice(list(numeric.BASE_RULES)), rng.choice(list(numeric.MODES)), rng.choice([None, None, 3, 4])
            for _ in range(rng.randint(1, 3)):
                a, b = (rng.choice(["", "", "-"]) + str(rng.randint(0, 99)).zfill(rng.choice([1, 2])) for _ in range(2))
                v = value(rule, turned(a, lt), turned(b, rt))
                examples.append((a, op, b, text(v, mode, op, width) if rng.random() < 0.9 else str(rng.randint(0, 200))))
        rng.shuffle(examples)
        puzzles.append((i, examples))
    puzzles += [(100, [("1", "+", "2", "3"), ("1", "+", "2", "3")]), (101, [("5", "-", "5", "-0"), ("5", "-", "5", "00")]), (102, [("9" * 18, "*", "9" * 18, "1")]), (103, [("3", "-", "8", "-5")])]
    puzzles += [(104, [("9" * 25, "+", "1", "2")]), (105, [("7", "+", "0", "x")]), (106, [("0", "*", "0", "000"), ("2", "*", "3", "006")]), (107, [("4", "-", "9", "--5"), ("4", "-", "9", "5-")])]
    want = brute([p for p in puzzles if p[0] != 104])
    assert found(spark, puzzles) == want
    assert {x[5] for x in want} == set(numeric.MODES)


def test_many_puzzles_meet_an_equation_once(spark):
    puzzles = [(i, [("12", "+", "30", "42"), (str(i), "+", "1", str(i + 1))]) for i in range(50)]
    assert found(spark, puzzles) == brute(puzzles)
    plan = numeric.candidates(spark.createDataFrame(puzzles, SCHEMA))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    each = spark.createDataFrame(puzzles, SCHEMA).select(F.explode("examples").alias("e")).select("e.*")
    assert numeric.met_rules(each).filter("left = '12' AND right = '30' AND rule = 'x + y' AND lt = 'id' AND rt = 'id' AND mode = 'plain'").count() == 1


def test_readings_turn_writing_round(spark):
    rows = [(v, m, o, w) for v in (-120, -7, -1, 0, 5, 30, 204) for m in numeric.MODES for o in "+-" for w in (None, 2, 4)]
    df = spark.createDataFrame([(*r, text(r[0], r[1], r[2], r[3])) for r in rows], "v long, m string, o string, w int, rhs string")
    fits = F.exists(numeric.readings(F.col("o"), F.col("rhs")), lambda z: (z["mode"] == F.col("m")) & (z["value"] == F.col("v")) & F.when(F.col("w").isNull(), z["bare"]).otherwise(F.col("w").between(z["lo"], z["hi"])))
    assert df.filter(~fits).collect() == []
