"""Which search answers a symbol equation.

The searches of ``encrypted`` can disagree: the query operator's own examples often
leave several alphabets, and a rule that fits them may not fit the other
operators. Here the searches are put in order, each behind the evidence that it needs, and
nothing is answered where what was found disagrees.

Rules are routed by the length of right-hand sides, so that a group of an operator
is fitted from partial alphabets under few rules. Partial alphabets are the rows of
one matrix, beside them one of the rules chosen for each operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.solve import symbol
from lexforge.solve.encrypted import BANKS, FAMILY, MOTIFS, PLAIN_MOTIFS, RANK, Candidate, Puzzle, apply, best_of, in_order

# Motifs that are trusted most, and rules by family in order of trial.
DOMINANT = (("BA_DC", "rev"), ("AB_CD", "raw"))
ADDS, SUBS, PRODUCTS = ("x + y", "x + y + 1", "x + y - 1"), ("x - y", "y - x", "|x - y|"), ("x * y", "x * y + 1", "x * y - 1")
SHORT_ADDS = ("x + y", "x * y", "x + y + 1", "x + y - 1", "x * y + 1", "x * y - 1")
TWO_DIGITS = {
    ("BA_DC", "rev"): ("x + y", "x - y", "x + y - 1", "x + y + 1", "|x - y|", "y - x"),
    ("AB_CD", "raw"): ("x - y", "|x - y|", "x + y", "x + y + 1", "x + y - 1", "y - x"),
}
# Guards of the rescues.
RESCUE_STATES, LEAST_MAPPED, WHOLE_ALPHABET, LEAST_SUPPORT, WIDE_STATES, PRODUCT_STATES, MOST_VARIANTS = 80, 9, 10, 4, 5000, 5000, 12
SIGNED, LAST, BACKWARDS = ("AB_CD", "op_prefix_if_neg"), ("AB_CD", "last"), ("BA_DC", "rev")
_ALPHABETIC = np.array([sorted(RANK).index(name) for name in RANK])


@dataclass(frozen=True)
class Options:
    """``most`` states a rule and ``combined`` over operators are kept; ``unknowns`` symbols of the query may be guessed."""

    rules: str = "asymmetric"
    absolute: bool = True
    formats: bool = False
    most: int = 120
    combined: int = 200
    absent: bool = False
    least: int = 2
    unknowns: int = 0
    ranked: bool = False
    family: bool = False
    completion: bool = True
    single: bool = True
    signed: bool = True
    last: bool = True
    backwards: bool = True
    #: States a rule of a second try, where the first gave no rule (with ``retry_ambiguous`` also where it was ambiguous).
    retry: int = 0
    retry_ambiguous: bool = False

    @property
    def motifs(self) -> tuple:
        return tuple(m for m in (MOTIFS if self.formats else PLAIN_MOTIFS) if self.absolute or m[1] != "abs")


class Answer(NamedTuple):
    prediction: str | None
    confidence: str
    method: str
    candidates: int
    predictions: tuple[str, ...]
    chosen: Candidate | None = None
    note: str | None = None


class Held(NamedTuple):
    """Partial alphabets and, for each, the rank of the rule of every operator (-1: none yet)."""

    states: np.ndarray
    rules: np.ndarray

    def cut(self, order: np.ndarray) -> Held:
        return Held(self.states[order], self.rules[order])

    def told(self, row: int, ops: list[str]) -> tuple[tuple[str, str], ...]:
        names = list(RANK)
        return tuple((op, names[r]) for op, r in zip(ops, self.rules[row].tolist()) if r >= 0)


def longest(examples: list[tuple[str, str]]) -> int:
    return max(len(rhs) for _, rhs in examples)


def family_rules(motif: tuple[str, str], examples: list[tuple[str, str]]) -> tuple[str, ...]:
    """The rules that results of such lengths can come from, in order of trial."""
    size = longest(examples)
    if size >= 4:
        return PRODUCTS
    if size == 3:
        return ADDS + PRODUCTS + SUBS
    if size == 1:
        return SUBS
    return TWO_DIGITS.get(motif, ADDS + SUBS)


def short_rules(examples: list[tuple[str, str]]) -> tuple[str, ...]:
    """The same for helpers of one-symbol differences."""
    size = longest(examples)
    return PRODUCTS if size >= 4 else SHORT_ADDS if size == 3 else SUBS if size == 1 else ADDS + SUBS


def _differs(rows: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    return np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)] if len(rows) else np.zeros(0, dtype=bool)


def _best_of_each(states: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's ``most`` best distinct states."""
    order = np.lexsort([*in_order(states), owner])
    states, owner = states[order], owner[order]
    fresh = _differs(np.column_stack([owner, states]))
    states, owner = states[fresh], owner[fresh]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return states[place < most], owner[place < most]


def _by_rules(rules: np.ndarray) -> list[np.ndarray]:
    """Sort keys, last one first, for the order of the lists of (operator, name of its rule)."""
    code = np.where(rules >= 0, np.arange(rules.shape[1]) * 64 + _ALPHABETIC[np.maximum(rules, 0)], -1)
    packed = np.take_along_axis(code, np.argsort(rules < 0, axis=1, kind="stable"), axis=1)
    return list(packed.T[::-1])


def _ranks(rules: np.ndarray) -> np.ndarray:
    return np.where(rules >= 0, rules, 0).sum(axis=1)


class Cascade:
    """The searches over one puzzle, each run when it is first asked for."""

    def __init__(self, puzzle: Puzzle, options: Options):
        self.p, self.o = puzzle, options
        self.ops = sorted(puzzle.groups)
        self.others = [op for op in self.ops if op != puzzle.operator]
        self.over_cap: list[str] = []

    # Fits from partial alphabets.

    def blank(self) -> Held:
        return Held(self.p.blank(), np.full((1, len(self.ops)), -1, dtype=np.int16))

    def joined(self, held: Held, op: str, motif: tuple[str, str], rules: tuple[str, ...], most: int) -> Held:
        """The partial alphabets extended by all examples of an operator under one of the rules; many symbols known first, then plain rules."""
        column, states, chosen = self.ops.index(op), [], []
        for rule in rules:
            now, owner = held.states, np.arange(len(held.states))
            for example in self.p.groups[op]:
                now, parent = self.p.grown(now, example, motif, rule)
                now, owner = _best_of_each(now, owner[parent], most)
            told = held.rules[owner]
            told[:, column] = RANK[rule]
            states.append(now)
            chosen.append(told)
        if not states:
            return Held(held.states[:0], held.rules[:0])
        both = distinct(Held(np.concatenate(states), np.concatenate(chosen)))
        order = np.lexsort([*in_order(both.states)[:-1], *_by_rules(both.rules), _ranks(both.rules), -(both.states >= 0).sum(axis=1)])
        return both.cut(order[:most])

    def candidates(self, held: Held, motif: tuple[str, str], unknowns: int, least: int = 0) -> list[Candidate]:
        """What partial alphabets say of the query, under the rule that each has for its operator."""
        column, out, names = self.ops.index(self.p.operator), [], list(RANK)
        for rank in np.unique(held.rules[:, column]).tolist():
            if rank < 0:
                continue
            at = np.flatnonzero(held.rules[:, column] == rank)
            for row, prediction, mapped, completed in self.p.answers(held.states[at], motif, names[rank], self.p.lengths, unknowns, least):
                out.append(Candidate(prediction, *motif, names[rank], True, len(self.p.same), mapped, completed, held.told(int(at[row]), self.ops)))
        return out

    # Searches.

    @cached_property
    def own(self) -> list[Candidate]:
        return self.p.same_operator(self.o.rules, self.o.motifs, self.o.most, self.o.unknowns)

    @cached_property
    def everywhere(self) -> list[Candidate]:
        o = self.o
        return self.p.all_operators(o.rules, o.motifs, o.most, o.combined, o.absent, o.least, o.unknowns)

    @cached_property
    def completed(self) -> list[Candidate]:
        """Own examples fix the rule; any of the other operators that fit may tell the symbols that the query lacks."""
        p, found = self.p, []
        if not p.same or not self.others:
            return []
        text = {op: {c for lhs, rhs in p.groups[op] for c in lhs + rhs} for op in self.others}
        helped = set().union(*text.values())
        order = sorted(self.others, key=lambda op: (not text[op] & set(p.asked), -len(p.groups[op]), -longest(p.groups[op]), op))
        for motif in (m for m in DOMINANT if m in self.o.motifs):
            rules = tuple(r for r in family_rules(motif, p.same) if r in BANKS[self.o.rules])
            for rule, states in p.fits(p.same, motif, rules, self.o.most, first=p.asked):
                states = states[: self.o.combined]
                seeds = states[[self._lacks(state, motif, rule, helped) for state in states]]
                if not len(seeds):
                    continue
                told = np.full((len(seeds), len(self.ops)), -1, dtype=np.int16)
                told[:, self.ops.index(p.operator)] = RANK[rule]
                held = Held(seeds, told)
                for op in order:
                    more = self.joined(held, op, motif, family_rules(motif, p.groups[op]), self.o.combined)
                    if not len(more.states):
                        continue
                    # What the operator doesn't extend stays too: it may be one that follows no rule here.
                    held = distinct(Held(*(np.concatenate(x) for x in zip(held, more))))
                    lacking = (held.states[:, [p.place[c] for c in p.asked]] < 0).sum(axis=1)
                    known = -(held.states >= 0).sum(axis=1)
                    held = held.cut(np.lexsort([*in_order(held.states)[:-1], *_by_rules(held.rules), _ranks(held.rules), known, lacking])[: self.o.combined])
                    found += self.candidates(held, motif, 0)
        return best_of(found)

    def _lacks(self, state: np.ndarray, motif: tuple[str, str], rule: str, helped: set[str]) -> bool:
        """Whether the state leaves symbols or digits of the query open that other operators may tell."""
        missing = {c for c in self.p.asked if state[self.p.place[c]] < 0}
        if missing:
            return len(missing) <= 2 and missing <= helped
        digits = self.p.gaps(state, motif, rule)
        # Operators among the helpers' characters may stand for digits too.
        free = sum(1 for c in helped if c not in self.p.place or state[self.p.place[c]] < 0)
        return bool(digits) and FAMILY[rule] == "mul" and free >= len(digits)

    def products(self, motifs: tuple = DOMINANT, most: int = PRODUCT_STATES) -> list[Candidate]:
        """Own examples as products, from the digits of the units on; a rule with more than ``most`` alphabets is given up and named in ``over_cap``."""
        p, found = self.p, []
        if len(p.same) < 2 or all(len(rhs) != 4 for _, rhs in p.same):
            return []
        for motif in motifs:
            for rule in PRODUCTS:
                states = self._product_states(motif, rule, most)
                if states is None:
                    self.over_cap.append(f"{motif[0]} {motif[1]} {rule}")
                    continue
                for _, prediction, mapped, completed in p.answers(states, motif, rule, p.lengths, self.o.unknowns):
                    found.append(Candidate(prediction, *motif, rule, True, len(p.same), mapped, completed, ((p.operator, rule),)))
        return best_of(found)

    def _product_states(self, motif: tuple[str, str], rule: str, most: int) -> np.ndarray | None:
        """All alphabets under which the rule gives the own examples; None beyond ``most``."""
        p, states = self.p, self.p.blank()
        for example in sorted(p.same, key=lambda e: (-len(e[1]), len(set(e[0] + e[1])), e)):
            lhs, rhs = example
            ones = [lhs[1], lhs[4]] if motif[0] == "AB_CD" else [lhs[0], lhs[3]]
            unit = p.place[rhs[-1] if motif[1] == "raw" else rhs[0]]
            # Units first: of all pairs of last digits only those whose product ends as the result does go on.
            states, _ = p.assigned(states, ones)
            x, y = (states[:, p.place[c]] for c in ones)
            ends = apply(rule, x, y)[0] % 10
            taken = (states == ends[:, None]).any(axis=1)
            states = states[(states[:, unit] == ends) | (states[:, unit] < 0) & ~taken]
            grown, parent = p.grown(states, example, motif, rule)
            if len(grown) > 2 * most or (len(parent) and np.bincount(parent).max() > most):
                return None
            states = distinct(Held(grown, np.zeros((len(grown), 0), dtype=np.int64))).states
            if len(states) > most:
                return None
        return states

    @cached_property
    def trusted_products(self) -> list[Candidate]:
        """Of products only the plain way of writing is trusted, and x * y only with the whole alphabet."""
        found = self.products((DOMINANT[1],))
        if self.over_cap:
            return []
        return [c for c in found if c.rule != "x * y" or c.mapped >= WHOLE_ALPHABET]

    @cached_property
    def singles(self) -> list[Candidate]:
        """One own example, but all operators together fix the whole alphabet under a dominant motif."""
        p, found = self.p, []
        if len(p.same) != 1 or len(p.examples) < LEAST_SUPPORT:
            return []
        order = sorted(self.ops, key=lambda op: (-len(p.groups[op]), -longest(p.groups[op]), op != p.operator, op))
        for motif in (m for m in DOMINANT if m in self.o.motifs):
            held = self.blank()
            for op in order:
                rules = tuple(r for r in family_rules(motif, p.groups[op]) if r in BANKS[self.o.rules])
                held = self.joined(held, op, motif, rules, max(self.o.most, self.o.combined))
                held = held.cut(np.arange(len(held.states))[: self.o.combined])
            found += self.candidates(held, motif, self.o.unknowns, least=WHOLE_ALPHABET)
        return best_of(found)

    @cached_property
    def differences(self) -> list[Candidate]:
        """Own results of one symbol are differences; a helper of three symbols that adds plainly anchors the alphabet."""
        p, found = self.p, []
        if not p.same or longest(p.same) != 1 or not self.others:
            return []
        wide = max(self.o.most, self.o.combined, WIDE_STATES)
        both = max(self.o.combined, WIDE_STATES)
        order = sorted(self.others, key=lambda op: (-longest(p.groups[op]), -len(p.groups[op]), op))
        for motif in (DOMINANT[1], DOMINANT[0]):
            each = [self.joined(self.blank(), p.operator, motif, (rule,), wide) for rule in SUBS]
            held = Held(*(np.concatenate(x)[:both] for x in zip(*each)))
            if not len(held.states):
                continue
            anchored = False
            for op in order:
                for rule in short_rules(p.groups[op]):
                    more = self.joined(held, op, motif, (rule,), wide)
                    if len(more.states):
                        held = more.cut(np.arange(len(more.states))[:both])
                        anchored |= rule == "x + y" and longest(p.groups[op]) == 3
                        break
            if anchored:
                found += self.candidates(held, motif, self.o.unknowns)
        return best_of(found)

    @cached_property
    def families(self) -> list[Candidate]:
        """All operators under routed rules, with up to two symbols of the query guessed; a rule with too many predictions says nothing. One candidate a prediction."""
        p, found = self.p, []
        if len(p.same) < 2 or all(len(rhs) > 2 for _, rhs in p.same) or not self.others:
            return []
        order = sorted(self.others, key=lambda op: (-len(p.groups[op]), -longest(p.groups[op]), op))
        for motif in DOMINANT:
            for rule in family_rules(motif, p.same):
                held = self.joined(self.blank(), p.operator, motif, (rule,), RESCUE_STATES)
                for op in order:
                    held = self.joined(held, op, motif, family_rules(motif, p.groups[op]), RESCUE_STATES)
                made = self.candidates(held, motif, max(2, self.o.unknowns))
                if len({c.prediction for c in made}) <= MOST_VARIANTS:
                    found += made
        held_by: dict[str, Candidate] = {}
        for c in found:
            if c.prediction not in held_by or RANK[c.rule] < RANK[held_by[c.prediction].rule]:
                held_by[c.prediction] = c
        return sorted(held_by.values(), key=lambda c: (RANK[c.rule], c.prediction))

    def rescued(self, motif: tuple[str, str], trusted: Callable[[Candidate], bool]) -> list[Candidate]:
        made = self.p.all_operators("core", (motif,), RESCUE_STATES, RESCUE_STATES, least=1, unknowns=self.o.unknowns)
        return [c for c in made if trusted(c)]

    def signed(self) -> list[Candidate]:
        """Some example shows its operator as a sign; sums alone are not trusted."""
        if not any(rhs.startswith(lhs[2]) for lhs, rhs in self.p.examples):
            return []

        def trusted(c: Candidate) -> bool:
            least = WHOLE_ALPHABET if c.rule == "x * y - 1" else LEAST_MAPPED
            return not _concats(c) and _families(c) != {"add"} and c.mapped >= least

        return self.rescued(SIGNED, trusted)

    def last_digits(self) -> list[Candidate]:
        """Results are cut to their last digits: one own example, helpers of other families."""
        helpers = [rhs for lhs, rhs in self.p.examples if lhs[2] != self.p.operator]
        if len(self.p.same) != 1 or max(map(len, helpers), default=0) < 3:
            return []
        return self.rescued(LAST, lambda c: FAMILY[c.rule] in ("add", "mul") and not _concats(c) and c.mapped >= LEAST_MAPPED and _families(c) not in ({"add"}, {"mul"}))

    def backwards(self) -> list[Candidate]:
        """Operands and results written backwards, behind narrow guards."""
        same = self.p.same
        if not same or longest(same) not in (3, 4):
            return []

        def trusted(c: Candidate) -> bool:
            if longest(same) == 3:
                return c.rule == "x + y" and c.mapped >= LEAST_MAPPED and (len(same) > 1 or not _concats(c))
            return len(same) == 1 and not _concats(c) and FAMILY[c.rule] == "mul" and c.mapped >= WHOLE_ALPHABET

        return self.rescued(BACKWARDS, trusted)

    # Decisions. The names of methods and confidences are fixed values.

    def agreed(self, found: list[Candidate], method: str, confidence: str | Callable[[Candidate], str]) -> Answer | None:
        """An answer if all candidates predict the same."""
        told = tuple(sorted({c.prediction for c in found}))
        if len(told) != 1:
            return None
        return Answer(told[0], confidence if isinstance(confidence, str) else confidence(found[0]), method, len(found), told, found[0])

    def unsure(self, found: list[Candidate], method: str) -> Answer:
        told = tuple(sorted({c.prediction for c in found}))
        return Answer(None, "ambiguous", method, len(found), told, found[0], f"over the cap: {', '.join(self.over_cap)}" if self.over_cap else None)

    def by_completion(self) -> Answer | None:
        if not self.o.completion:
            return None
        return self.agreed(self.completed, "same_operator_map_completion_unique", lambda c: "high" if c.query_examples >= 2 else "medium")

    def by_products(self) -> Answer | None:
        return self.agreed(self.trusted_products, "same_operator_mul_unit_constraint_unique", "high")

    def by_single(self) -> Answer | None:
        if not self.o.single:
            return None
        return self.agreed(self.differences, "length1_subtraction_rescue_unique", "medium") or self.agreed(self.singles, "guarded_min1_global_consistency_unique", "medium")

    def by_family(self) -> Answer | None:
        if not self.o.family or not self.families:
            return None
        return self.agreed(self.families, "family_rescue_unique", "low") or self.unsure(self.families, "family_rescue_ambiguous")

    def main(self) -> Answer:
        own = self.agreed(self.own, "same_operator_encrypted_digit_transform_unique", "high")
        if own:
            # All operators together overrule the query's own examples.
            whole = self.agreed(self.everywhere, "same_operator_global_consistency_unique", "high")
            if whole:
                return whole
            if self.o.unknowns and any(c.completed for c in self.own):
                return self.by_completion() or self.by_products() or self.by_family() or self.unsure(self.own, "same_operator_query_completion_requires_global_consistency")
            return own
        if self.o.ranked and self.own:
            return self.unsure(self.own, "same_operator_encrypted_digit_transform_ranked")._replace(prediction=self.own[0].prediction, confidence="medium")
        if answer := self.by_completion():
            return answer
        if not self.everywhere:
            answer = self.by_single() or self.by_products() or self.by_family()
            return answer or (self.unsure(self.own, "same_operator_encrypted_digit_transform_ambiguous") if self.own else Answer(None, "none", "no_rule", 0, (), None, f"over the cap: {', '.join(self.over_cap)}" if self.over_cap else None))
        sure = "high" if self.everywhere[0].query_examples >= 2 else "medium"
        if answer := self.agreed(self.everywhere, "encrypted_digit_transform_unique", sure):
            return answer
        if self.o.ranked:
            sure = "medium" if self.everywhere[0].query_examples else "low"
            return self.unsure(self.everywhere, "encrypted_digit_transform_ranked")._replace(prediction=self.everywhere[0].prediction, confidence=sure)
        return self.by_products() or self.by_single() or self.by_family() or self.unsure(self.everywhere, "encrypted_digit_transform_ambiguous")

    def late(self, answer: Answer) -> Answer:
        """Rescues that only answer where nothing else did."""
        by_alphabet = lambda c: "high" if c.mapped == WHOLE_ALPHABET else "medium"
        if self.o.backwards and answer.prediction is None and (found := self.agreed(self.backwards(), "ba_dc_rev_guarded_global_unique", by_alphabet)):
            return found
        if self.o.last and answer.method == "no_rule" and (found := self.agreed(self.last_digits(), "last_digit_global_unique", "medium")):
            return found
        return answer

    def answer(self) -> Answer:
        by_alphabet = lambda c: "high" if c.mapped == WHOLE_ALPHABET else "medium"
        if self.o.signed and (found := self.agreed(self.signed(), "signed_operator_marker_global_unique", by_alphabet)):
            return found
        first = self.main()
        again = first.method == "no_rule" or self.o.retry_ambiguous and first.confidence == "ambiguous"
        if not again or self.o.retry <= self.o.most:
            return self.late(first)
        second = Cascade(self.p, replace(self.o, most=self.o.retry)).main()
        if second.prediction is not None:
            return second._replace(method=f"adaptive_retry_{second.method}")
        rescued = self.late(second)
        return rescued if rescued is not second else first


def _concats(c: Candidate) -> bool:
    return any(rule.startswith("concat(") for _, rule in c.rules)


def _families(c: Candidate) -> set[str]:
    return {FAMILY[rule] for _, rule in c.rules}


def distinct(held: Held) -> Held:
    """Each pair of alphabet and rules once, in the order of their first rows."""
    if not len(held.states):
        return held
    _, first = np.unique(np.column_stack(held), axis=0, return_index=True)
    return held.cut(np.sort(first))


def solve_one(examples: list[tuple[str, str]], query: str, options: Options = Options()) -> Answer:
    """The answer to a puzzle that no direct template answers."""
    return Cascade(Puzzle(examples, query), options).answer()


SOLVED = "prediction string, confidence string, method string, n_candidates int, predictions array<string>, pairing string, mode string, rule string, rules array<string>, mapped int, note string"
_NAMES = [c.strip().split()[0] for c in SOLVED.split(", ")]
_PARSE_FAIL = Answer(None, "none", "parse_fail", 0, ())


def _row(answer: Answer) -> dict:
    c = answer.chosen
    told = {"pairing": c.pairing, "mode": c.mode, "rule": c.rule, "rules": [f"{op} {rule}" for op, rule in c.rules], "mapped": c.mapped} if c else {}
    return dict.fromkeys(_NAMES) | told | {
        "prediction": answer.prediction, "confidence": answer.confidence, "method": answer.method, "n_candidates": answer.candidates, "predictions": list(answer.predictions), "note": answer.note,
    }


def _solver(options: Options):
    kinds = pa.schema([(n, pa.list_(pa.string()) if n in ("predictions", "rules") else pa.int32() if n in ("n_candidates", "mapped") else pa.string()) for n in _NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for told, query, direct in zip(*(batch.column(c).to_pylist() for c in ("examples", "query", "direct"))):
                examples = [(e["lhs"], e["rhs"]) for e in told or [] if e and e["lhs"] and e["rhs"] and len(e["lhs"]) == 5]
                if not examples or query is None or len(query) != 5:
                    rows.append(_row(_PARSE_FAIL))
                elif direct:
                    rows.append(_row(Answer(direct["prediction"], direct["confidence"], f"direct_template_{direct['template']}", 1, (direct["prediction"],))))
                else:
                    rows.append(_row(solve_one(examples, query, options)))
            made = pa.RecordBatch.from_pylist(rows, kinds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made.columns], ["id", *_NAMES])

    return run


def solve(puzzles: DataFrame, id_col: str = "id", options: Options = Options(), rows_per_task: int = 4) -> DataFrame:
    """(id, prediction, confidence, method, n_candidates, predictions, pairing, mode, rule, rules, mapped, note) of puzzles (id, examples lhs and rhs, query).

    Direct templates first, then the searches; null prediction where candidates
    disagree or there is none. Puzzles cost far more than rows, so they are dealt out
    ``rows_per_task`` to a task. Without a query of five characters or an example with such a
    left side the method is ``parse_fail``.
    """
    own = puzzles.select(F.col(id_col).alias("id"), F.struct("examples", "query").alias("p"))
    dealt = own.repartition(max(1, -(-own.count() // rows_per_task)))
    told = dealt.select("id", "p.examples", "p.query", F.when(symbol.whole(F.col("p")), symbol.direct_answer(F.col("p"))).alias("direct"))
    kind = told.schema["id"].dataType.simpleString()
    return told.mapInArrow(_solver(options), f"id {kind}, {SOLVED}")
