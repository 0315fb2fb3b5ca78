"""Searches of the cascade against every alphabet, and each branch of its decisions."""

import itertools
import random

import numpy as np
import pytest

from lexforge.solve import cascade as c
from lexforge.solve import encrypted as e

ALL = 10**6


def alphabets(n):
    return np.array(list(itertools.permutations(range(10), n)))


def number(rows, place, text):
    return sum(rows[:, place[s]] * 10 ** (len(text) - 1 - k) for k, s in enumerate(text))


def value(rule, x, y):
    zero = lambda a: np.where(a == 0, 1, a)
    return {
        "x * y": x * y, "x * y + 1": x * y + 1, "x * y - 1": x * y - 1, "x + y": x + y, "x + y + 1": x + y + 1, "x + y - 1": x + y - 1, "x - y": x - y, "y - x": y - x, "|x - y|": abs(x - y),
        "x % y": np.where(y == 0, -1, x % zero(y)),
    }[rule]


def operands(rows, place, lhs, pairing):
    text = lhs.replace(lhs[2], "", 1) if lhs.count(lhs[2]) == 1 else lhs[:2] + lhs[3:]
    x, y = text[:2], text[2:]
    x, y = (x[::-1] if pairing[:2] == "BA" else x), (y[::-1] if pairing[3:] == "DC" else y)
    return number(rows, place, x), number(rows, place, y)


def holds(rows, place, example, motif, rule):
    """Under which alphabets an example is true: its right side read as a number, without leading zeros."""
    lhs, rhs = example
    shown = rhs[::-1] if motif[1] == "rev" else rhs
    v = value(rule, *operands(rows, place, lhs, motif[0]))
    return (number(rows, place, shown) == v) & ((len(rhs) == 1) | (rows[:, place[shown[0]]] > 0))


def solutions(groups, motif, rules):
    """(symbols, alphabets over them) of all groups' symbols under the rule of each operator."""
    used = sorted({s for op in rules for lhs, rhs in groups[op] for s in lhs[:2] + lhs[3:] + rhs})
    place = {s: k for k, s in enumerate(used)}
    rows = alphabets(len(used))
    for op, rule in rules.items():
        for example in groups[op]:
            rows = rows[holds(rows, place, example, motif, rule)]
    return place, rows


def said(place, rows, query, motif, rule):
    """Predictions for the query of alphabets that know its operands and its result's digits."""
    if not {*query[:2], *query[3:]} <= set(place):
        return set()
    out = set()
    values = value(rule, *operands(rows, place, query, motif[0]))
    for row, v in zip(rows.tolist(), values.tolist()):
        back = {d: s for s, d in zip(place, row)}
        text = str(v)[::-1] if motif[1] == "rev" else str(v)
        if v >= 0 and all(int(t) in back for t in text):
            out.add("".join(back[int(t)] for t in text))
    return out


def planted(rng, motif, rules, counts, symbols, lengths=None, tries=4000):
    """(examples, query, answer) over an alphabet of few symbols."""
    secret = dict(zip(symbols, rng.sample(range(10), len(symbols))))
    back = {d: s for s, d in secret.items()}
    place, rows = {s: k for k, s in enumerate(secret)}, np.array([list(secret.values())])

    def one(op, rule, length):
        for _ in range(tries):
            lhs = "".join(rng.choices(symbols, k=2)) + op + "".join(rng.choices(symbols, k=2))
            v = int(value(rule, *operands(rows, place, lhs, motif[0]))[0])
            text = str(v)[::-1] if motif[1] == "rev" else str(v)
            if v >= 0 and all(int(t) in back for t in text) and length in (None, len(text)):
                return lhs, "".join(back[int(t)] for t in text)
        return None

    examples = [one(op, rule, length) for op, rule, n, length in zip("+*-", rules, counts, lengths or [None] * 3) for _ in range(n)]
    query = one("+", rules[0], (lengths or [None])[0])
    return None if None in examples or query is None else (examples, query[0], query[1])


def puzzles(seed, n, *args, **options):
    rng, out = random.Random(seed), []
    for _ in range(500):
        made = planted(rng, *(a(rng) if callable(a) else a for a in args), **options)
        if made and len(out) < n:
            out.append(made)
    assert len(out) == n
    return out


SIX = "abcdef"
MOTIFS = [("BA_DC", "rev"), ("AB_CD", "raw")]


@pytest.mark.parametrize("motif", [*MOTIFS, ("AB_DC", "raw"), ("BA_CD", "rev")])
def test_own_examples_against_every_alphabet(motif):
    for examples, query, _ in puzzles(1, 2, motif, ["x + y"], [2], SIX):
        p = e.Puzzle(examples, query)
        got = {(x.prediction, x.rule) for x in p.same_operator("core", (motif,), ALL)}
        want = {(t, rule) for rule in (*c.ADDS, *c.SUBS, *c.PRODUCTS) for t in said(*solutions(p.groups, motif, {"+": rule}), query, motif, rule)}
        assert {x for x in got if not x[1].startswith("concat")} == want


@pytest.mark.parametrize("motif", MOTIFS)
def test_completion_against_every_alphabet_and_set_of_helpers(motif):
    """Any of the other operators may help, under any routed rule; only alphabets that lack something need help."""
    met = 0
    for examples, query, answer in puzzles(2, 2, motif, lambda r: r.choice([["x + y", "x - y", "x * y"], ["x - y", "x + y", "x * y"]]), [1, 1, 1], "abcde"):
        cascade = c.Cascade(e.Puzzle(examples, query), c.Options(most=ALL, combined=ALL, rules="core"))
        got = {(x.prediction, x.rule) for x in cascade.completed if (x.pairing, x.mode) == motif}
        groups, want = cascade.p.groups, set()
        text = {op: {s for lhs, rhs in groups[op] for s in lhs + rhs} for op in "*-"}
        for rule in c.family_rules(motif, groups["+"]):
            place, rows = solutions(groups, motif, {"+": rule})
            missing = {*query[:2], *query[3:]} - set(place)
            if missing:
                seeds = rows if len(missing) <= 2 and missing <= text["*"] | text["-"] else rows[:0]
            else:
                v = value(rule, *operands(rows, place, query, motif[0]))
                gaps = [{int(t) for t in str(x)} - set(row) if x >= 0 else set() for x, row in zip(v.tolist(), rows.tolist())]
                free = len((text["*"] | text["-"]) - set(place))
                seeds = rows[[bool(g) and rule in c.PRODUCTS and free >= len(g) for g in gaps]]
            known = {tuple(r) for r in seeds.tolist()}
            for helpers in ("*", "-", "*-"):
                for chosen in itertools.product(*(c.family_rules(motif, groups[op]) for op in helpers)):
                    both, full = solutions(groups, motif, {"+": rule} | dict(zip(helpers, chosen)))
                    own = full[:, [both[s] for s in place]]
                    full = full[[tuple(r) in known for r in own.tolist()]] if len(full) else full
                    want |= {(t, rule) for t in said(both, full, query, motif, rule)}
        assert got == want
        met += bool(want)
    assert met


def test_products_equal_enumeration_and_give_up_over_the_cap():
    for motif in MOTIFS:
        for examples, query, _ in puzzles(3, 2, motif, ["x * y"], [2], SIX, lengths=[4]):
            cascade = c.Cascade(e.Puzzle(examples, query), c.Options())
            want = {(t, rule) for rule in c.PRODUCTS for t in said(*solutions(cascade.p.groups, motif, {"+": rule}), query, motif, rule)}
            assert {(x.prediction, x.rule) for x in cascade.products((motif,), ALL)} == want and not cascade.over_cap
            assert cascade.products((motif,), 0) == [] and len(cascade.over_cap) >= 1
    examples, query, _ = puzzles(3, 1, MOTIFS[1], ["x * y"], [2], SIX, lengths=[4])[0]
    full = c.Cascade(e.Puzzle(examples, query), c.Options())
    full.over_cap.append("AB_CD raw x * y")
    assert "over the cap: AB_CD raw x * y" in full.unsure([e.Candidate("a", "AB_CD", "raw", "x * y", True, 2, 10, 0, ())], "m").note


@pytest.mark.parametrize("size,names", [(4, c.PRODUCTS), (5, c.PRODUCTS), (3, c.ADDS + c.PRODUCTS + c.SUBS), (1, c.SUBS)])
def test_rules_are_routed_by_length(size, names):
    examples = [("ab+cd", "x"), ("ab+cd", "x" * size)]
    assert c.family_rules(("AB_CD", "raw"), examples) == names
    assert set(c.short_rules(examples)) == set(names) - (set(c.SUBS) if size == 3 else set())


def test_two_symbols_are_routed_by_motif():
    examples = [("ab+cd", "xy")]
    assert c.family_rules(("BA_DC", "rev"), examples)[:2] == ("x + y", "x - y") and c.family_rules(("AB_CD", "raw"), examples)[:2] == ("x - y", "|x - y|")
    assert set(c.family_rules(("BA_CD", "raw"), examples)) == {*c.ADDS, *c.SUBS} == set(c.short_rules(examples))


def test_joint_fits_against_every_alphabet():
    """A group fitted from partial alphabets, under each rule, equals all alphabets of both groups."""
    for motif in MOTIFS:
        for examples, query, _ in puzzles(4, 2, motif, ["x + y", "x - y"], [1, 1], SIX):
            cascade = c.Cascade(e.Puzzle(examples, query), c.Options())
            rules = ("x - y", "x + y", "|x - y|")
            first = cascade.joined(cascade.blank(), "+", motif, ("x + y",), ALL)
            both = cascade.joined(first, "*", motif, rules, ALL)
            got = {(tuple(s), r[cascade.ops.index("*")]) for s, r in zip(both.states.tolist(), both.rules.tolist())}
            want = set()
            for rule in rules:
                place, rows = solutions(cascade.p.groups, motif, {"+": "x + y", "*": rule})
                for row in rows.tolist():
                    told = dict(zip(place, row))
                    want.add((tuple(told.get(s, -1) for s in cascade.p.symbols), e.RANK[rule]))
            assert got == want and len(both.states) == len(got)
            few = cascade.joined(first, "*", motif, rules, 3)
            assert few.states.tolist() == both.states[: len(few.states)].tolist()


# Branches: texts are made of digits and then written in symbols that differ from run to run.
BRANCHES = {
    "signed_operator_marker_global_unique": ([("23-57", "-34"), ("98-16", "82"), ("40-75", "-35"), ("36*72", "2592"), ("58*91", "5278")], "15-48", "-33", "high"),
    "encrypted_digit_transform_unique": ([("57+84", "141"), ("93+26", "119"), ("18+40", "58"), ("36-72", "2592"), ("91-58", "5278")], "46+75", "121", "high"),
    "direct_template_0134": ([("12/34", "1234"), ("57/96", "5796"), ("11+12", "23")], "46/75", "4675", "high"),
    "direct_template_3401": ([("12/34", "3412"), ("11+12", "23")], "46/75", "7546", "medium"),
}


def written(examples, query, answer, seed):
    signs = random.Random(seed).sample("!@#$%^&~?ABCDEFGHijklm", 10)
    enc = lambda t, op: "".join(x if x == op else signs[int(x)] for x in t)
    return [(enc(a, a[2]), enc(b, a[2])) for a, b in examples], enc(query, query[2]), enc(answer, query[2])


KIND = "id int, examples array<struct<lhs string, rhs string>>, query string"


def test_branches_in_one_table(spark):
    rows, want = [], {}
    for k, (method, (examples, query, answer, sure)) in enumerate(BRANCHES.items()):
        for seed in range(2):
            told, asked, text = written(examples, query, answer, 10 * k + seed)
            rows.append((len(rows), told, asked))
            want[len(rows) - 1] = (text, sure, method)
    bad = [(100, [("ab+cd", "ef")], None), (101, None, "ab+cd"), (102, [("abc", "d")], "ab+cd"), (103, [("ab+cd", "ef"), None], "ab"), (104, [], "ab+cd"), (105, [("ab/cd", "g")], "ef/gh"), (106, [("ab+cd", "ef")] * 3, "ab+cd")]
    got = {r.id: r for r in c.solve(spark.createDataFrame(rows + bad, KIND), rows_per_task=3).collect()}
    assert {k: (got[k].prediction, got[k].confidence, got[k].method) for k in want} == want
    assert {got[k].method for k in range(100, 105)} == {"parse_fail"} and got[105].method == "no_rule" and got[106].prediction == "ef"
    assert got[2].rules == ["+ x + y", "- x * y"] and got[2].mapped == 10
    assert c.solve(spark.createDataFrame([], KIND)).count() == 0


def found(name, query_examples=2, completed=0):
    return e.Candidate(name, "AB_CD", "raw", "x + y", True, query_examples, 10, completed, (("+", "x + y"),))


class Told(c.Cascade):
    """A cascade whose searches are given."""

    def __init__(self, options=c.Options(), **given):
        super().__init__(e.Puzzle([("ab+cd", "ef")], "ab+cd"), options)
        for name in ("own", "everywhere", "completed", "trusted_products", "singles", "differences", "families"):
            self.__dict__[name] = given.get(name, [])
        self.given = given

    def signed(self):
        return self.given.get("signed", [])

    def last_digits(self):
        return self.given.get("last", [])

    def backwards(self):
        return self.given.get("backwards", [])


A, B = found("a"), found("b")
GUESS = c.Options(unknowns=2)


@pytest.mark.parametrize(
    "options,given,want",
    [
        (c.Options(), dict(signed=[A], own=[B]), ("a", "high", "signed_operator_marker_global_unique")),
        (c.Options(), dict(signed=[A, B], own=[B]), ("b", "high", "same_operator_encrypted_digit_transform_unique")),
        (c.Options(), dict(own=[A], everywhere=[B]), ("b", "high", "same_operator_global_consistency_unique")),
        (c.Options(), dict(own=[A], everywhere=[A, B]), ("a", "high", "same_operator_encrypted_digit_transform_unique")),
        (c.Options(), dict(own=[A]), ("a", "high", "same_operator_encrypted_digit_transform_unique")),
        (GUESS, dict(own=[found("a", 2, 1)]), (None, "ambiguous", "same_operator_query_completion_requires_global_consistency")),
        (GUESS, dict(own=[found("a", 2, 1)], completed=[B]), ("b", "high", "same_operator_map_completion_unique")),
        (GUESS, dict(own=[found("a", 2, 1)], trusted_products=[B]), ("b", "high", "same_operator_mul_unit_constraint_unique")),
        (c.Options(), dict(own=[A, B], completed=[B], everywhere=[A]), ("b", "high", "same_operator_map_completion_unique")),
        (c.Options(), dict(completed=[found("b", 1)]), ("b", "medium", "same_operator_map_completion_unique")),
        (c.Options(completion=False), dict(own=[A, B], completed=[B], everywhere=[A]), ("a", "high", "encrypted_digit_transform_unique")),
        (c.Options(), dict(everywhere=[found("a", 1)]), ("a", "medium", "encrypted_digit_transform_unique")),
        (c.Options(), dict(differences=[A], singles=[B]), ("a", "medium", "length1_subtraction_rescue_unique")),
        (c.Options(), dict(differences=[A, B], singles=[B], trusted_products=[A]), ("b", "medium", "guarded_min1_global_consistency_unique")),
        (c.Options(single=False), dict(singles=[B], trusted_products=[A]), ("a", "high", "same_operator_mul_unit_constraint_unique")),
        (c.Options(), dict(everywhere=[A, B], singles=[B], trusted_products=[A]), ("a", "high", "same_operator_mul_unit_constraint_unique")),
        (c.Options(), dict(everywhere=[A, B], singles=[B]), ("b", "medium", "guarded_min1_global_consistency_unique")),
        (c.Options(), dict(everywhere=[A, B]), (None, "ambiguous", "encrypted_digit_transform_ambiguous")),
        (c.Options(), dict(own=[A, B]), (None, "ambiguous", "same_operator_encrypted_digit_transform_ambiguous")),
        (c.Options(family=True), dict(families=[A]), ("a", "low", "family_rescue_unique")),
        (c.Options(family=True), dict(everywhere=[A, B], families=[A, B]), (None, "ambiguous", "family_rescue_ambiguous")),
        (c.Options(), dict(families=[A]), (None, "none", "no_rule")),
        (c.Options(), dict(own=[A, B], backwards=[B], last=[A]), ("b", "high", "ba_dc_rev_guarded_global_unique")),
        (c.Options(), dict(own=[A, B], last=[A]), (None, "ambiguous", "same_operator_encrypted_digit_transform_ambiguous")),
        (c.Options(), dict(last=[A]), ("a", "medium", "last_digit_global_unique")),
        (c.Options(backwards=False, last=False), dict(backwards=[B], last=[A]), (None, "none", "no_rule")),
        (c.Options(ranked=True), dict(own=[B, A]), ("b", "medium", "same_operator_encrypted_digit_transform_ranked")),
        (c.Options(ranked=True), dict(everywhere=[B, A]), ("b", "medium", "encrypted_digit_transform_ranked")),
    ],
)
def test_order_of_decisions(options, given, want):
    assert tuple(Told(options, **given).answer()[:3]) == want


def planted_once(seed, motif, rules, counts, lengths):
    """A puzzle over all ten digits."""
    return puzzles(seed, 1, motif, rules, counts, "abcdefghij", lengths=lengths)[0]


def guarded(search, motif, rules, counts, lengths, wanted=2, tries=20):
    """Puzzles that a guarded search answers, and whether it answers them rightly."""
    right = []
    for seed in range(tries):
        examples, query, answer = planted_once(seed, motif, rules, counts, lengths)
        told = {x.prediction for x in search(c.Cascade(e.Puzzle(examples, query), c.Options()))}
        if len(told) == 1:
            right.append(told == {answer})
        if len(right) == wanted:
            break
    return right


def test_one_example_needs_the_whole_alphabet():
    motif = ("AB_CD", "raw")
    assert guarded(lambda x: x.singles, motif, ["x + y", "x * y", "x - y"], [1, 2, 2], [3, 4, 2]) == [True] * 2
    few = c.Cascade(e.Puzzle([("ab+cd", "ef"), ("ab-cd", "g"), ("ab*cd", "hhh")], "ab+cd"), c.Options())
    assert few.singles == []  # three examples support too little


def test_one_symbol_differences_need_a_plain_sum_as_anchor():
    motif = ("AB_CD", "raw")
    assert guarded(lambda x: x.differences, motif, ["x - y", "x + y", "x * y"], [2, 2, 2], [1, 3, 4]) == [True] * 2
    examples, query, _ = planted_once(1, motif, ["x - y", "x * y"], [2, 2], [1, 4])
    assert c.Cascade(e.Puzzle(examples, query), c.Options()).differences == []
    examples, query, _ = planted_once(2, motif, ["x - y", "x + y"], [2, 2], [2, 3])
    assert c.Cascade(e.Puzzle(examples, query), c.Options()).differences == []


@pytest.mark.parametrize("rules,counts,lengths", [(["x * y", "x + y", "x - y"], [1, 2, 1], [4, 3, 2]), (["x + y", "x * y", "x - y"], [1, 2, 1], [3, 4, 2]), (["x + y", "x * y"], [2, 2], [3, 4])])
def test_documented_shapes_of_backwards_puzzles(rules, counts, lengths):
    assert guarded(lambda x: x.backwards(), ("BA_DC", "rev"), rules, counts, lengths) == [True] * 2


def test_backwards_guards():
    for rules, lengths in ((["x - y", "x * y"], [2, 4]), (["x * y", "x + y"], [4, 3])):
        examples, query, _ = planted_once(5, ("BA_DC", "rev"), rules, [2, 2], lengths)
        assert c.Cascade(e.Puzzle(examples, query), c.Options()).backwards() == []


def test_random_puzzles_and_odd_ones_end():
    rng = random.Random(9)
    for _ in range(12):
        own = "abcdefghijklm+-"[: rng.randint(3, 15)]
        text = lambda n: "".join(rng.choices(own, k=n))  # noqa: E731, B023
        examples = [(text(2) + rng.choice("+-*") + text(2), text(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
        answer = c.solve_one(examples + examples[:1], text(2) + "+" + text(2), c.Options(most=40, combined=40, family=True, unknowns=1))
        assert answer.prediction is None or answer.predictions
