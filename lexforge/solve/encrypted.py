"""Symbol equations whose symbols stand for digits: search for the digits, the rule and the way results are written.

The search is a beam over assignments of digits to symbols, which no join can
express. A puzzle's assignments are the rows of one matrix (a column for each
symbol, -1 while it is open), so an example extends or refuses all of them at
once. ``cascade`` decides between the searches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from itertools import permutations
from math import perm

import numpy as np

# Name, family, whether the operands' order matters; the place is the rank.
RULES = (
    ("x * y", "mul", False), ("x + y", "add", False), ("x + y + 1", "add", False), ("x + y - 1", "add", False), ("x * y + 1", "mul", False), ("x * y - 1", "mul", False),
    ("x - y", "sub", True), ("y - x", "sub", True), ("|x - y|", "sub", False), ("concat(x, y)", "concat", True), ("concat(y, x)", "concat", True), ("max - min", "sub", False),
    ("x % y", "mod", True), ("y % x", "mod", True), ("max % min", "mod", False), ("min % max", "mod", False), ("x // y", "div", True), ("y // x", "div", True),
    ("x + y^2", "quadratic", True), ("y + x^2", "quadratic", True), ("x^2 - y", "quadratic", True), ("y^2 - x", "quadratic", True),
)
RANK = {name: k for k, (name, _, _) in enumerate(RULES)}
FAMILY = {name: family for name, family, _ in RULES}
CORE = tuple(name for name, _, _ in RULES[:11])
BANKS = {"core": CORE, "asymmetric": tuple(n for n, _, a in RULES if a or n in CORE), "extended": tuple(n for n, _, _ in RULES)}
# Pairings (places of the operands' digits) and motifs in the order they are tried.
PAIRINGS = {"AB_CD": (0, 1, 3, 4), "AB_DC": (0, 1, 4, 3), "BA_CD": (1, 0, 3, 4), "BA_DC": (1, 0, 4, 3)}
PLAIN_MOTIFS = (
    ("BA_DC", "rev"), ("AB_CD", "raw"), ("AB_CD", "rev"), ("BA_DC", "raw"), ("AB_DC", "raw"), ("AB_DC", "rev"), ("BA_CD", "raw"), ("BA_CD", "rev"),
    ("AB_CD", "abs"), ("BA_DC", "abs"), ("AB_DC", "abs"), ("BA_CD", "abs"),
)
MOTIFS = PLAIN_MOTIFS + tuple((p, m) for m in ("last", "last_rev", "op_prefix_if_neg", "op_suffix_rev_if_neg") for p in PAIRINGS)
MOTIF_RANK = {m: k for k, m in enumerate(MOTIFS)}
OPEN, SIGN = -1, -2


def apply(rule: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and where they are defined; operands are 0 to 99."""
    big, small = np.maximum(x, y), np.minimum(x, y)
    whole = np.ones(len(x), dtype=bool)

    def by(a, b, f):
        return f(a, np.where(b == 0, 1, b)), b != 0

    forms: dict[str, Callable] = {
        "x * y": lambda: (x * y, whole), "x + y": lambda: (x + y, whole), "x + y + 1": lambda: (x + y + 1, whole), "x + y - 1": lambda: (x + y - 1, whole),
        "x * y + 1": lambda: (x * y + 1, whole), "x * y - 1": lambda: (x * y - 1, whole), "x - y": lambda: (x - y, whole), "y - x": lambda: (y - x, whole),
        "|x - y|": lambda: (big - small, whole), "max - min": lambda: (big - small, whole),
        "concat(x, y)": lambda: (x * np.where(y > 9, 100, 10) + y, whole), "concat(y, x)": lambda: (y * np.where(x > 9, 100, 10) + x, whole),
        "x % y": lambda: by(x, y, np.mod), "y % x": lambda: by(y, x, np.mod), "max % min": lambda: by(big, small, np.mod), "min % max": lambda: by(small, big, np.mod),
        "x // y": lambda: by(x, y, np.floor_divide), "y // x": lambda: by(y, x, np.floor_divide),
        "x + y^2": lambda: (x + y * y, whole), "y + x^2": lambda: (y + x * x, whole), "x^2 - y": lambda: (x * x - y, whole), "y^2 - x": lambda: (y * y - x, whole),
    }
    return forms[rule]()


def sized(value: np.ndarray, mode: str, length: int) -> np.ndarray:
    """Where the mode can write a result in ``length`` places."""
    if mode.startswith("last"):
        return value >= 0
    size = np.abs(value) if mode == "abs" or mode.startswith("op_") else value
    least = 10 ** (length - 1) if length > 1 else 0
    if mode.startswith("op_"):
        least = np.where(value < 0, least // 10 if length > 2 else 1, least)
        return (size >= least) & (size < np.where(value < 0, 10 ** (length - 1), 10**length))
    return (size >= least) & (size < 10**length)


def tokens(value: np.ndarray, mode: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The result's digits (or SIGN) in ``length`` places, and where the mode writes exactly so many."""
    size = np.abs(value.astype(np.int64))
    digits = size[:, None] // 10 ** np.arange(length - 1, -1, -1, dtype=np.int64) % 10
    n_digits = np.ones(len(size), dtype=np.int64)
    for k in range(1, 9):
        n_digits += size >= 10**k
    fits, negative = n_digits == length, value < 0
    if mode == "abs":
        return digits, fits
    if mode in ("raw", "rev"):
        return digits if mode == "raw" else digits[:, ::-1], fits & ~negative
    if mode in ("last", "last_rev"):
        return digits if mode == "last" else digits[:, ::-1], ~negative
    out = digits.copy()
    marked = negative & (n_digits == length - 1)
    if mode == "op_prefix_if_neg":
        out[marked, 0] = SIGN
    else:
        out[marked, :-1] = digits[marked][:, :0:-1]
        out[marked, -1] = SIGN
    return out, marked | (fits & ~negative)


@dataclass(frozen=True)
class Candidate:
    prediction: str
    pairing: str
    mode: str
    rule: str
    seen: bool
    query_examples: int
    mapped: int
    completed: int
    rules: tuple[tuple[str, str], ...]

    @property
    def order(self) -> tuple:
        asymmetric = dict((n, a) for n, _, a in RULES)[self.rule]
        return (not self.seen, -self.query_examples, MOTIF_RANK[self.pairing, self.mode], RANK[self.rule], not asymmetric, self.completed, -self.mapped, self.prediction)


def best_of(found: list[Candidate]) -> list[Candidate]:
    """The best candidate of each prediction, motif and rule, in order."""
    held: dict[tuple, Candidate] = {}
    for c in sorted(found, key=lambda c: c.order):
        held.setdefault((c.prediction, c.pairing, c.mode, c.rule), c)
    return sorted(held.values(), key=lambda c: c.order)


#: Expanded rows that are held at once.
CHUNK_ROWS = 1 << 17
#: Ways to give k symbols different ones of n digits.
N_WAYS = np.array([[perm(n, k) for k in range(5)] for n in range(11)])


@cache
def _ways(n: int, k: int) -> np.ndarray:
    return np.array(list(permutations(range(n), k)), dtype=np.int64)


def in_order(states: np.ndarray) -> list[np.ndarray]:
    """Sort keys, last one first: many symbols known, then the order of (symbol, digit) lists; an open symbol comes last."""
    return [*np.where(states == OPEN, 99, states).T[::-1], -(states >= 0).sum(axis=1)]


class Puzzle:
    def __init__(self, examples: list[tuple[str, str]], query: str):
        self.examples, self.query, self.operator = examples, query, query[2]
        spots = [lhs[k] for lhs, _ in [*examples, (query, "")] for k in (0, 1, 3, 4)]
        self.symbols = sorted({*spots, *(c for _, rhs in examples for c in rhs)})
        self.place = {c: k for k, c in enumerate(self.symbols)}
        self.groups: dict[str, list[tuple[str, str]]] = {}
        for lhs, rhs in examples:
            self.groups.setdefault(lhs[2], []).append((lhs, rhs))
        self.same = self.groups.get(self.operator, [])
        self.lengths = sorted({len(rhs) for _, rhs in self.same})
        self.asked = sorted({query[k] for k in (0, 1, 3, 4)})

    def blank(self) -> np.ndarray:
        return np.full((1, len(self.symbols)), OPEN, dtype=np.int16)

    def completed(self, states: np.ndarray, lhs: str) -> np.ndarray:
        """The states with every way to give the open operand symbols of ``lhs`` unused digits."""
        return self.assigned(states, [lhs[k] for k in (0, 1, 3, 4)])[0]

    def assigned(self, states: np.ndarray, symbols: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The states with every way to give ``symbols`` that are open unused digits, and the row each came from."""
        spots = sorted({self.place[c] for c in symbols})
        out, source = [states[:0]], [np.zeros(0, dtype=np.int64)]
        known = states >= 0
        alike = len(known) > 0 and bool((known == known[0]).all())
        for shape in known[:1] if alike else np.unique(known, axis=0):
            at = np.arange(len(known)) if alike else np.flatnonzero((known == shape).all(axis=1))
            opened = [s for s in spots if not shape[s]]
            n_free = 10 - int(shape.sum())
            if len(opened) > n_free:
                continue
            if not opened:
                out.append(states[at])
                source.append(at)
                continue
            rows = states[at]
            taken = np.zeros((len(rows), 10), dtype=bool)
            taken[np.arange(len(rows))[:, None], rows[:, shape]] = True
            free = np.nonzero(~taken)[1].astype(np.int16).reshape(len(rows), n_free)
            ways = _ways(n_free, len(opened))
            made = np.repeat(rows, len(ways), axis=0)
            made[:, opened] = free[:, ways].reshape(-1, len(opened))
            out.append(made)
            source.append(np.repeat(at, len(ways)))
        return np.concatenate(out), np.concatenate(source)

    def operands(self, states: np.ndarray, lhs: str, pairing: str) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = (states[:, self.place[lhs[k]]] for k in PAIRINGS[pairing])
        return 10 * a + b, 10 * c + d

    def accepted(self, states: np.ndarray, example: tuple[str, str], pairing: str, rule: str, mode: str) -> np.ndarray:
        """The states under which the rule gives the example, with what its right side tells."""
        return self.met(states, example, pairing, rule, mode)[0]

    def met(self, states: np.ndarray, example: tuple[str, str], pairing: str, rule: str, mode: str) -> tuple[np.ndarray, np.ndarray]:
        """``accepted`` with the row that each state came from."""
        lhs, rhs = example
        value, defined = apply(rule, *self.operands(states, lhs, pairing))
        keep = np.flatnonzero(defined & sized(value, mode, len(rhs)))
        written, ok = tokens(value[keep], mode, len(rhs))
        keep, written = keep[ok], written[ok]
        states = states[keep]
        used = np.where(states >= 0, 1 << np.maximum(states, 0), 0).sum(axis=1)
        good = np.ones(len(states), dtype=bool)
        for k, symbol in enumerate(rhs):
            digit, have = written[:, k], states[:, self.place[symbol]]
            sign = digit == SIGN
            bit = 1 << np.maximum(digit, 0)
            fresh = ~sign & (have == OPEN) & (used & bit == 0)
            good &= np.where(sign, (have == OPEN) & (symbol == lhs[2]), (have == digit) | fresh)
            states[fresh, self.place[symbol]] = digit[fresh]
            used |= np.where(fresh, bit, 0)
        return states[good], keep[good]

    def grown(self, states: np.ndarray, example: tuple[str, str], motif: tuple[str, str], rule: str) -> tuple[np.ndarray, np.ndarray]:
        """All states that extend the given ones and give the example, and the row each came from; a bounded number of rows at a time."""
        lhs = example[0]
        spots = sorted({self.place[lhs[k]] for k in (0, 1, 3, 4)})
        opened, free = (states[:, spots] < 0).sum(axis=1), 10 - (states >= 0).sum(axis=1)
        ways = N_WAYS[free, opened]
        cuts = np.searchsorted(np.cumsum(ways), np.arange(CHUNK_ROWS, int(ways.sum()) + CHUNK_ROWS, CHUNK_ROWS))
        out, source = [states[:0]], [np.zeros(0, dtype=np.int64)]
        for low, high in zip([0, *(cuts[:-1] + 1)], [*(cuts[:-1] + 1), len(states)]):
            made, parent = self.assigned(states[low:high], [lhs[k] for k in (0, 1, 3, 4)])
            made, at = self.met(made, example, motif[0], rule, motif[1])
            out.append(made)
            source.append(parent[at] + low)
        return np.concatenate(out), np.concatenate(source)

    def fits(self, examples: list[tuple[str, str]], motif: tuple[str, str], rules: tuple[str, ...], most: int, first: list[str] = ()) -> list[tuple[str, np.ndarray]]:
        """For each rule that gives all examples its ``most`` best states: symbols of ``first`` known first, then many symbols known, then in order of symbols and digits."""
        start = self.completed(self.blank(), examples[0][0])
        early = [self.place[c] for c in first]
        out = []
        for rule in rules:
            states = start
            for k, example in enumerate(examples):
                states = self.accepted(states, example, motif[0], rule, motif[1]) if k == 0 else self.grown(states, example, motif, rule)[0]
                if not len(states):
                    break
                known = states >= 0
                order = np.lexsort([*in_order(states), -known[:, early].sum(axis=1)])
                states = states[order][:most]
            if len(states):
                out.append((rule, states))
        return out

    def answers(self, states: np.ndarray, motif: tuple[str, str], rule: str, lengths: list[int], unknowns: int, least: int = 0) -> list[tuple[int, str, int, int]]:
        """(row of ``states``, prediction, symbols known, symbols completed): the query under each state, one for each prediction, with least completed and most known.

        Up to ``unknowns`` open symbols of the query are given every unused digit; results with fewer than ``least`` known symbols don't count.
        """
        opened = (states[:, [self.place[c] for c in self.asked]] < 0).sum(axis=1)
        use = np.flatnonzero(opened <= unknowns)
        rows, source = self.assigned(states[use], self.asked)
        mapped = (rows >= 0).sum(axis=1)
        value, defined = apply(rule, *self.operands(rows, self.query, motif[0]))
        keep = np.flatnonzero(defined & (mapped >= least))
        rows, value, mapped, source = rows[keep], value[keep], mapped[keep], use[source[keep]]
        symbol_of = np.full((len(rows), 10), -1)
        at, spot = np.nonzero(rows >= 0)
        symbol_of[at, rows[at, spot]] = spot
        signed = rows[:, self.place[self.operator]] == OPEN if self.operator in self.place else np.ones(len(rows), dtype=bool)
        best: dict[str, tuple] = {}
        own = np.array([len(str(v)) for v in np.abs(value).tolist()], dtype=np.int64) + ((value < 0) if motif[1].startswith("op_") else 0)
        more = {n for n in lengths if 1 <= n <= 4} if motif[1].startswith("last") else set()
        for length in sorted({*own.tolist(), *more}):
            some = np.flatnonzero((own == length) | (length in more))
            written, ok = tokens(value[some], motif[1], length)
            some, written = some[ok], written[ok]
            sign = written == SIGN
            letters = np.where(sign, len(self.symbols), symbol_of[some[:, None], np.maximum(written, 0)])
            good = (letters >= 0).all(axis=1) & (signed[some] | ~sign.any(axis=1))
            some, letters = some[good], letters[good]
            order = np.lexsort((some, -mapped[some], opened[source[some]]))
            _, first = np.unique(letters[order], axis=0, return_index=True)
            for k in order[first].tolist():
                text = "".join([*self.symbols, self.operator][c] for c in letters[k].tolist())
                row = int(some[k])
                told = (int(opened[source[row]]), -int(mapped[row]), row)
                best[text] = min(told, best.get(text, told))
        return [(int(source[row]), text, -known, completed) for text, (completed, known, row) in best.items()]

    def gaps(self, state: np.ndarray, motif: tuple[str, str], rule: str) -> set[int]:
        """Digits that the query's result takes and no symbol has, where all its operands are known."""
        if any(state[self.place[c]] == OPEN for c in self.asked):
            return set()
        value, defined = apply(rule, *self.operands(state[None, :], self.query, motif[0]))
        missing: set[int] = set()
        for length in self.sizes(int(value[0]), motif[1], self.lengths) if defined[0] else ():
            written, ok = tokens(value, motif[1], length)
            if ok[0]:
                missing |= {int(t) for t in written[0] if t != SIGN} - set(state[state >= 0].tolist())
        return missing

    @staticmethod
    def sizes(value: int, mode: str, lengths: list[int]) -> list[int]:
        """The lengths in which a result may be written."""
        own = len(str(abs(value)))
        if mode.startswith("last"):
            return sorted({own, *(n for n in lengths if 1 <= n <= 4)})
        return [own + (value < 0 and mode.startswith("op_"))]

    def same_operator(self, rules: str = "asymmetric", motifs: tuple = PLAIN_MOTIFS, most: int = 120, unknowns: int = 0) -> list[Candidate]:
        """Candidates from the query operator's examples alone, of which there must be two."""
        same = self.same
        if len(same) < 2:
            return []
        found = []
        for motif in motifs:
            for rule, states in self.fits(same, motif, BANKS[rules], most):
                for _, prediction, mapped, completed in self.answers(states, motif, rule, self.lengths, unknowns):
                    found.append(Candidate(prediction, *motif, rule, True, len(same), mapped, completed, ((self.operator, rule),)))
        return best_of(found)

    def merged(self, partial: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joins of one state with many, and which of those agree and keep digits apart."""
        both = np.where(partial >= 0, partial, states)
        agree = ((partial < 0) | (states < 0) | (partial == states)).all(axis=1)
        bits = np.where(both >= 0, 1 << np.maximum(both, 0), 0)
        return both, agree & (np.bitwise_or.reduce(bits, axis=1) == bits.sum(axis=1))

    def all_operators(self, rules: str = "asymmetric", motifs: tuple = PLAIN_MOTIFS, most: int = 120, combined: int = 200, absent: bool = False, least: int = 2, unknowns: int = 0) -> list[Candidate]:
        """Candidates under one motif for all operators, whose states must agree."""
        if (self.operator not in self.groups and not absent) or 0 < len(self.groups.get(self.operator, [])) < least:
            return []
        lengths = sorted({len(rhs) for _, rhs in self.groups.get(self.operator, self.examples)})
        names = sorted(RANK)
        found = []
        for motif in motifs:
            fits = {}
            for op, examples in self.groups.items():
                fits[op] = self.fits(examples, motif, BANKS[rules], most)
                if not fits[op]:
                    break
            if not all(fits.get(op) for op in self.groups):
                continue
            order = sorted(self.groups, key=lambda op: (op != self.operator, sum(len(s) for _, s in fits[op]), op))
            partials: list[tuple[np.ndarray, dict[str, str]]] = [(self.blank()[0], {})]
            for op in order:
                states = np.concatenate([s for _, s in fits[op]])
                rule_of = [r for r, s in fits[op] for _ in range(len(s))]
                made, chosen, keys = [], [], []
                done = sorted([*partials[0][1], op])
                for state, rules_so_far in partials:
                    both, ok = self.merged(state, states)
                    for k in np.flatnonzero(ok).tolist():
                        now = rules_so_far | {op: rule_of[k]}
                        made.append(both[k])
                        chosen.append(now)
                        keys.append((len({FAMILY[r] for r in now.values()}), sum(RANK[r] for r in now.values()), -int((both[k] >= 0).sum()), *(names.index(now[o]) for o in done)))
                best = sorted(range(len(made)), key=keys.__getitem__)[:combined]
                partials = [(made[k], chosen[k]) for k in best]
                if not partials:
                    break
            by_rule: dict[str, list[int]] = {}
            for k, (_, told) in enumerate(partials):
                rule = told.get(self.operator) or next((n for n, _, a in RULES if a and n in BANKS[rules] and n not in told.values()), None)
                if rule is not None:
                    by_rule.setdefault(rule, []).append(k)
            for rule, at in by_rule.items():
                for row, prediction, mapped, completed in self.answers(np.stack([partials[k][0] for k in at]), motif, rule, lengths, unknowns):
                    told = partials[at[row]][1]
                    found.append(Candidate(prediction, *motif, rule, self.operator in told, len(self.same), mapped, completed, tuple(sorted(told.items()))))
        return best_of(found)
