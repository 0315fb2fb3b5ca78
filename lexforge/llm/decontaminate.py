"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then overlap.

Test items are the indexed side, so the index has the size of the benchmark. Document
frequencies and lengths are taken over all items at once; the index is then built
for blocks of items of bounded size, and each block is held against all documents. Every passage of every document is a query. Impacts are BM25 weights
divided by the item's score against itself, so one threshold serves all items
and a passage is retrieved for an item if it reaches that share of a perfect match.

An exact bound comes first, for thousands of passages at once: an item's light
terms, which together stay under half the threshold, are left out, and a passage
is passed on only if for some item the heavy terms it holds plus all light ones
could reach the threshold. For those, block-max WAND walks the postings and
returns every item at or above it. A retrieved item counts as leaked only if the
passage also holds its question and its answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import _kernel, _shared, near

K1, B = 1.2, 0.75
#: Share of an item's self score from which a passage is retrieved.
THRESHOLD = 0.6
#: Share of the words of a question or an answer that must lie in runs which the passage holds too.
OVERLAP = 0.7
BLOCK = 16
#: Bytes of item text in one index.
INDEX_BYTES = 8 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FOUND = "item_id long, score double, question_overlap double, answer_overlap double"
SCHEMA = f"doc_id long, {FOUND}"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits; bytes outside ASCII count as letters."""
    return (text or "").lower().encode().translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words before and after the last sentence or line break; one text for both where there is no such break."""
    cuts = [m.end() for m in re.finditer(r"[.?!:]\s+|\n+", text.strip())]
    text = text.strip()
    for cut in reversed(cuts):
        question, answer = words_of(text[:cut]), words_of(text[cut:])
        if question and answer:
            return question, answer
    return words_of(text), words_of(text)


def run_length(words: int) -> int:
    """Words in a run that counts as held: three, two in parts of under ten, so that one changed word costs little more than itself."""
    return min(words, 3 if words >= 10 else 2)


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the part's words that lie in a run which the passage holds."""
    if not part:
        return 0.0
    size = run_length(len(part))
    there = set(zip(*(passage[k:] for k in range(size))))
    covered = bytearray(len(part))
    for i, run in enumerate(zip(*(part[k:] for k in range(size)))):
        if run in there:
            covered[i : i + size] = b"\x01" * size
    return sum(covered) / len(part)


@dataclass
class Statistics:
    """What BM25 and the passages take from the whole benchmark: items with a word, their mean and greatest length."""

    items: int
    mean: float
    longest: int


@dataclass
class Index:
    """Postings of a block of items: for each term ascending items, impacts, and the maximum of each block."""

    ids: list[int]
    parts: list[tuple[list[bytes], list[bytes]]]
    longest: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    tops: list[float] = field(default_factory=list)
    block_tops: list[list[float]] = field(default_factory=list)
    heavy: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    light: np.ndarray | None = None


def build_index(items: list[tuple[int, str, dict[bytes, int]]], statistics: Statistics, threshold: float = THRESHOLD) -> Index:
    """The index of (id, text, document frequency of each of its words) under the statistics of all items."""
    texts = [(i, t, words_of(t), df) for i, t, df in items]
    index = Index([i for i, *_ in texts], [question_and_answer(t) for _, t, *_ in texts], statistics.longest)
    counts: list[dict[bytes, int]] = []
    df: dict[bytes, int] = {}
    for _, _, words, of_all in texts:
        tf: dict[bytes, int] = {}
        for w in words:
            tf[w] = tf.get(w, 0) + 1
        counts.append(tf)
        df.update(of_all)
    n, mean = statistics.items, statistics.mean
    per_term: dict[bytes, list[tuple[int, float]]] = {}
    heavy: list[tuple[int, int, float]] = []
    light = np.zeros(len(texts))
    index.vocabulary = {w: k for k, w in enumerate(df)}
    for i, (_, _, words, _) in enumerate(texts):
        norm = K1 * (1 - B + B * len(words) / mean)
        impact = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in counts[i].items()}
        whole = sum(impact.values())
        for w, x in sorted(impact.items(), key=lambda p: p[1]):
            per_term.setdefault(w, []).append((i, x / whole))
            if light[i] + x / whole < threshold / 2:
                light[i] += x / whole
            else:
                heavy.append((index.vocabulary[w], i, x / whole))
    for w in index.vocabulary:
        some = sorted(per_term[w])
        index.postings.append(([i for i, _ in some], [x for _, x in some]))
        index.block_tops.append([max(x for _, x in some[at : at + BLOCK]) for at in range(0, len(some), BLOCK)])
        index.tops.append(max(x for _, x in some))
    heavy.sort()
    terms = np.array([t for t, _, _ in heavy], dtype=np.int64)
    index.heavy = np.searchsorted(terms, np.arange(len(index.vocabulary) + 1)), np.array([i for _, i, _ in heavy], dtype=np.int64), np.array([x for _, _, x in heavy])
    index.light = light
    return index


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """Every item whose impacts over the distinct terms add up to the threshold, with its score."""
    cursors = [[t, 0] for t in terms if index.postings[t][0]]
    found = []
    slack = threshold - 1e-9

    def item(c):
        return index.postings[c[0]][0][c[1]]

    def advance(c, target) -> bool:
        ids = index.postings[c[0]][0]
        c[1] = int(np.searchsorted(ids, target)) if len(ids) > 64 else next((k for k in range(c[1], len(ids)) if ids[k] >= target), len(ids))
        return c[1] < len(ids)

    while cursors:
        cursors.sort(key=item)
        bound, pivot = 0.0, None
        for k, c in enumerate(cursors):
            bound += index.tops[c[0]]
            if bound >= slack:
                pivot = k
                break
        if pivot is None:
            return found
        target = item(cursors[pivot])
        while pivot + 1 < len(cursors) and item(cursors[pivot + 1]) == target:
            pivot += 1
        near, ends = 0.0, []
        for t, at in cursors[: pivot + 1]:
            ids = index.postings[t][0]
            block = at // BLOCK
            while ids[min((block + 1) * BLOCK, len(ids)) - 1] < target and (block + 1) * BLOCK < len(ids):
                block += 1
            last = ids[min((block + 1) * BLOCK, len(ids)) - 1]
            if last >= target:
                near += index.block_tops[t][block]
                ends.append(last)
        if near < slack:  # no item up to the nearest block end can reach it
            step = min(ends) + 1
            if pivot + 1 < len(cursors):
                step = min(step, item(cursors[pivot + 1]))
            step = max(step, target + 1)
        elif item(cursors[0]) == target:
            score = sum(index.postings[t][1][at] for t, at in cursors[: pivot + 1])
            if score >= slack:
                found.append((target, score))
            step = target + 1
        else:
            step = target
        cursors = [c for k, c in enumerate(cursors) if k > pivot or item(c) >= step or advance(c, step)]
    return found


def _possible(index: Index, passage: np.ndarray, terms: np.ndarray, n_passages: int, threshold: float) -> np.ndarray:
    """Passages for which some item's bound reaches the threshold; (passage, term) pairs are distinct."""
    starts, items, impacts = index.heavy
    sizes = starts[terms + 1] - starts[terms]
    at = np.repeat(starts[terms], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.repeat(passage, sizes) * len(index.ids) + items[at]
    keys, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, weights=impacts[at], minlength=len(keys)) + index.light[keys % len(index.ids)]
    return np.unique(keys[total >= threshold - 1e-9] // len(index.ids))


def _searcher(index: Index, threshold: float, carried: list[str]):
    size = max(2 * index.longest, 2)
    step = size // 2

    def passages_of(words):
        return range(0, max(1, len(words) - size + step), step) if words else range(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.vocabulary.get
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", 1 << 20):
                docs = [words_of(t) for t in batch.column("text").to_pylist()]
                where: list[tuple[int, int]] = []
                pairs = []
                for d, words in enumerate(docs):
                    ids = np.fromiter((known(w, -1) for w in words), dtype=np.int64, count=len(words))
                    for s in passages_of(words):
                        own = np.unique(ids[s : s + size])
                        pairs.append(own[own >= 0])
                        where.append((d, s))
                if not where:
                    continue
                passage = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for p in _possible(index, passage, np.concatenate(pairs), len(pairs), threshold).tolist():
                    d, s = where[p]
                    text = docs[d][s : s + size]
                    for i, score in block_max_wand(index, pairs[p].tolist(), threshold):
                        question, answer = (overlap(part, text) for part in index.parts[i])
                        if question >= OVERLAP and answer >= OVERLAP:
                            best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (score, question, answer))
                rows = [(*(batch.column(c)[d].as_py() for c in carried), index.ids[i], *x) for (d, i), x in best.items()]
                if rows:
                    types = [*[pa.int64()] * (len(carried) + 1), *[pa.float64()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], [*carried, *(f.split()[0] for f in FOUND.split(", "))])

    return run


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, i, text in zip(*(batch.column(c).to_pylist() for c in ("row", "item_id", "text"))):
            words = words_of(text)
            own = sorted(set(words))
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array([len(words)] * n, pa.int64()), pa.array(own, pa.binary())], ["row", "length", "word"])


def with_frequencies(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, Statistics]:
    """(row, item_id, text, frequencies) of the items with a word, and the statistics, both over the whole benchmark."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    rows = _shared.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    terms = _shared.materialize(rows.mapInArrow(_words_of_items, "row long, length long, word binary"), "terms")
    sizes = terms.groupBy("row").agg(F.first("length").alias("length")).agg(F.count("*"), F.avg("length"), F.max("length")).first()
    often = _shared.materialize(terms.groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    each = terms.join(often.hint("merge"), "word").groupBy("row").agg(F.collect_list(F.struct("word", "df")).alias("frequencies"))
    return rows.join(each.hint("merge"), "row"), Statistics(sizes[0], sizes[1] or 1.0, sizes[2] or 0)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str, dict[bytes, int]]]]:
    """Items in blocks of at most INDEX_BYTES of text (or one item), one block on the driver at a time."""
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + len(r.text) > INDEX_BYTES:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text, {bytes(f.word): f.df for f in r.frequencies}))
        size += len(r.text)
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each item that a document holds, best passage.

    Passages are twice as long as the benchmark's longest item and half overlap, so
    a copy of an item always lies whole inside one, in texts of any length. Scores
    rest on all items, in however many blocks and whatever order they are searched.
    Null and wordless texts, on either side, match nothing; repeated rows are rows
    of their own, equal items are all found; ids may be null. Other columns are not read.
    """
    text = F.col(text_col).cast("string").alias("text")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    return _search(own, ["doc_id"], benchmark, threshold, item_col, item_text_col)


def _search(own: DataFrame, carried: list[str], benchmark: DataFrame, threshold: float, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each item that a text of ``own`` holds, with the long columns ``carried`` of its row."""
    schema = ", ".join([*(f"{c} long" for c in carried), FOUND])
    found = None
    items, statistics = with_frequencies(benchmark, item_col, item_text_col)
    for block in _blocks(items):
        index = build_index(block, statistics, threshold)
        if index.ids:
            part = own.mapInArrow(_searcher(index, threshold, carried), schema)
            found = part if found is None else found.unionByName(part)
    return found if found is not None else own.sparkSession.createDataFrame([], schema)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item; ids need be neither unique nor there."""
    own = docs.select(*near.row_key(), F.col("text").cast("string").alias("text"))
    leaked = _search(own, near.ROW_KEY, benchmark, threshold).select(*near.ROW_KEY).distinct()
    return near.only_keyed(docs, leaked, "left_anti").select(docs.columns)
