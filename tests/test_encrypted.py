import itertools
import random

import numpy as np
import pytest

from lexforge.solve import encrypted as e

RULES = {
    "x * y": lambda x, y: x * y, "x + y": lambda x, y: x + y, "x + y - 1": lambda x, y: x + y - 1, "x - y": lambda x, y: x - y, "|x - y|": lambda x, y: abs(x - y),
    "concat(x, y)": lambda x, y: int(f"{x}{y}"), "concat(y, x)": lambda x, y: int(f"{y}{x}"), "x % y": lambda x, y: x % y if y else None, "min % max": lambda x, y: min(x, y) % max(x, y) if max(x, y) else None,
    "y // x": lambda x, y: y // x if x else None, "y^2 - x": lambda x, y: y * y - x,
}


def shown(v, mode, n, op):
    """The result as text, None where it does not come out in n places."""
    text = str(abs(v))
    if mode.startswith("last"):
        out = None if v < 0 else text[-n:].zfill(n)[:: 1 if mode == "last" else -1]
    elif mode.startswith("op_"):
        out = text if v >= 0 else op + text if mode == "op_prefix_if_neg" else text[::-1] + op
    else:
        out = text if mode == "abs" else None if v < 0 else text[:: 1 if mode == "raw" else -1]
    return out if out is not None and len(out) == n else None


@pytest.mark.parametrize("mode", ["raw", "rev", "abs", "last", "last_rev", "op_prefix_if_neg", "op_suffix_rev_if_neg"])
def test_rules_and_modes_against_plain_arithmetic(mode):
    xs, ys = (a.ravel() for a in np.meshgrid(np.arange(0, 100, 7), np.arange(0, 100, 9)))
    for rule, f in RULES.items():
        value, defined = e.apply(rule, xs, ys)
        for n in range(1, 5):
            got, ok = e.tokens(value, mode, n)
            for k, (x, y) in enumerate(zip(xs.tolist(), ys.tolist())):
                v = f(x, y)
                assert defined[k] == (v is not None)
                if v is not None:
                    want = shown(v, mode, n, "-")
                    assert ok[k] == (want is not None), (rule, x, y, n)
                    assert want is None or "".join("-" if t == e.SIGN else str(t) for t in got[k]) == want


@pytest.mark.parametrize("seed", range(3))
def test_states_against_every_assignment(seed):
    rng = random.Random(seed)
    symbols = "abcdef"
    digits = dict(zip("abcdef", rng.sample(range(10), 6)))
    back = {d: s for s, d in digits.items()}
    examples = []
    while len(examples) < 2:
        lhs = "".join(rng.choices(symbols, k=2)) + "+" + "".join(rng.choices(symbols, k=2))
        v = 10 * digits[lhs[0]] + digits[lhs[1]] + 10 * digits[lhs[3]] + digits[lhs[4]]
        if all(int(c) in back for c in str(v)):
            examples.append((lhs, "".join(back[int(c)] for c in str(v))))
    puzzle = e.Puzzle(examples, examples[0][0])
    ((_, got),) = [x for x in puzzle.fits(examples, ("AB_CD", "raw"), ("x + y",), 10**6)]
    used = sorted({c for lhs, rhs in examples for c in lhs[:2] + lhs[3:] + rhs})
    want = set()
    for ds in itertools.permutations(range(10), len(used)):
        m = dict(zip(used, ds))
        if all(str(10 * m[a[0]] + m[a[1]] + 10 * m[a[3]] + m[a[4]]) == "".join(str(m[c]) for c in b) for a, b in examples):
            want.add(ds)
    assert {tuple(row) for row in got.tolist()} == want and len(got) == len(want)
    alone = puzzle.fits(examples[:1], ("AB_CD", "raw"), ("x + y",), 10**6)[0][1]
    assert puzzle.fits(examples[:1], ("AB_CD", "raw"), ("x + y",), 3)[0][1].tolist() == alone[:3].tolist()


def test_repeated_examples_and_random_puzzles_never_fail():
    puzzle = e.Puzzle([("ab+cd", "ef"), ("ab+cd", "ef"), ("ba+dc", "fe")], "ab+cd")
    assert puzzle.same_operator() and all(c.prediction == "ef" for c in puzzle.same_operator())
    rng = random.Random(0)
    for _ in range(15):
        text = lambda n, own: "".join(rng.choices(own, k=n))
        own = "abcdefghijkl"[: rng.randint(2, 12)]
        examples = [(text(2, own) + rng.choice("+-") + text(2, own), text(rng.randint(1, 5), own)) for _ in range(rng.randint(1, 4))]
        puzzle = e.Puzzle(examples + examples[:1], text(2, own) + "+" + text(2, own))
        puzzle.same_operator("core", e.PLAIN_MOTIFS[:3], 50)
        puzzle.all_operators("core", e.PLAIN_MOTIFS[:3], 50, 50, least=1)
