"""Stupid-backoff language-model scores over hash-partitioned n-gram count tables.

The model is the corpus itself: S(w | v) = c(v w) / c(v) where the pair occurs at
least ``min_count`` times, else alpha * c(w) / N. A document starts after a
begin mark, which counts as a word before its first; n words give n scores.

Words and pairs are exploded in the tasks that read the text and dealt by hash,
packed in blobs; the bucket of a pair holds its count, joins it to every
occurrence and sums the logarithms for each document. What is frequent never
meets in one bucket: words and pairs among the ``HEAVY`` most frequent are
counted from sums that each batch has made, and their counts are broadcast; their
occurrences are scored where they are read. Others have at most a ``HEAVY``-th of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import _kernel, _shared
from lexforge.llm._kernel import BASES, U64
from lexforge.llm.substring import _spread

#: At most so many words and so many pairs are heavy.
HEAVY = 1 << 16
BATCH_BYTES = 4 << 20
BUCKET_ENTRIES = 2 << 20
NULL_ID = -(1 << 63)
#: Codes of the marks around a document; hashes of words lie above all codes.
BEGIN, END, FIRST_CODE = 0, 1, 2
COUNTS = "bucket int, entries binary"
SCORES = "kind int, bucket int, docs binary, entries binary"
#: Kinds of packed rows: occurrences that ask a bucket, and sums that a bucket has finished.
ASKED, FINISHED = 0, 1
#: Sums that meet in one task, at most one for each word of a document.
SUMS_PER_TASK = 1 << 22


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row ids, word hashes (over FIRST_CODE + HEAVY), first word of each row and words of each row."""
    body, rows = _kernel.text_bytes(batch.column("text"))
    starts, ends, first = _kernel.word_bounds(body, rows)
    hashes = _kernel.word_hashes(body, starts, ends, BASES[0]) | U64(1 << 32)
    ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    return ids, hashes, first, np.diff(first)


def _coded(words: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Heavy words as their place in ``heavy`` (ascending hashes) + FIRST_CODE, others as their hash."""
    if not len(heavy):
        return words
    at = np.minimum(np.searchsorted(heavy, words), len(heavy) - 1)
    return np.where(heavy[at] == words, at.astype(U64) + U64(FIRST_CODE), words)


def _pairs(codes: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, left, right): each row's begin mark, its words and its end mark, two by two."""
    full = np.flatnonzero(words)
    n = words[full] + 1
    row = np.repeat(full, n)
    head = np.cumsum(n) - n
    left, right = np.empty(n.sum(), dtype=U64), np.empty(n.sum(), dtype=U64)
    inner = np.ones(len(row), dtype=bool)
    inner[head] = False
    left[inner], left[head] = codes, U64(BEGIN)
    inner[:] = True
    inner[head + n - 1] = False
    right[inner], right[head + n - 1] = codes, U64(END)
    return row, left, right


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _kernel.mix(left * U64(BASES[0]) + right * U64(BASES[1]) + U64(1))


def _sum_blobs(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    cut = _spread(buckets, keys)
    some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    blobs = [_kernel.pack(np.diff(keys[cut[b] : cut[b + 1]], prepend=U64(0)), counts[cut[b] : cut[b + 1]].astype(np.uint32)) for b in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "entries"])


def _word_counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", BATCH_BYTES):
                _, words, _, _ = _words(batch)
                yield _sum_blobs(*np.unique(words, return_counts=True), buckets)

    return run


def _pair_counter(buckets: int, heavy: np.ndarray):
    """Pairs of heavy words; only those can be heavy pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", BATCH_BYTES):
                _, hashes, first, words = _words(batch)
                _, left, right = _pairs(_coded(hashes, heavy), first, words)
                both = (left < U64(1 << 32)) & (right < U64(1 << 32)) & (right != U64(END))
                yield _sum_blobs(*np.unique(_pair_hash(left[both], right[both]), return_counts=True), buckets)

    return run


def _numbered(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch] | None = None) -> Iterator[tuple[int, list[tuple[bytes | None, bytes]]]]:
    """Each bucket with its (docs, entries); rows come sorted. Rows of finished scores go to ``passed``."""
    held: list[tuple[bytes | None, bytes]] = []
    now = None
    for batch in batches:
        if passed is not None:
            asked = pc.equal(batch.column("kind"), ASKED)
            passed.append(batch.filter(pc.invert(asked)))
            batch = batch.filter(asked)
        docs = batch.column("docs").to_pylist() if "docs" in batch.schema.names else [None] * batch.num_rows
        for bucket, *rest in zip(batch.column("bucket").to_pylist(), docs, batch.column("entries").to_pylist()):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(tuple(rest))
    if held or passed:
        yield now, held


COUNTED = "bucket int, entries binary, h long, n long"


def _summer(floor: int, keep_all: bool):
    """The counts of a bucket: all of them packed (if asked for), and (h, n) rows of those of at least ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _numbered(batches):
            keys, counts = zip(*(_kernel.unpack(e, U64, np.uint32) for _, e in parts))
            key, back = np.unique(np.concatenate([np.cumsum(k, dtype=U64) for k in keys]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
            often = n >= floor
            h, some = key[often].view(np.int64), n[often]
            blob = [_kernel.pack(np.diff(key, prepend=U64(0)), n)] if keep_all else []
            k, none = len(blob), len(h)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket] * k + [None] * none, pa.int32()), pa.array(blob + [None] * none, pa.binary()),
                    pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(h)]), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(some)]),
                ],
                ["bucket", "entries", "h", "n"],
            )

    return run


def _counted(packed: DataFrame, spread: int, total: int, least: int, keep_all: bool, label: str) -> DataFrame:
    """Counts over all batches. What is listed by row has a 2^20th of all occurrences or more, so that is at most 2^20 rows."""
    floor = max(total >> 20, least)
    dealt = packed.repartition(spread, "bucket").sortWithinPartitions("bucket")
    return _shared.materialize(dealt.mapInArrow(_summer(floor, keep_all), COUNTED), label)


def _heavy(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of the most frequent, at most HEAVY: all above the lowest step that leaves so few."""
    steps = [int(2 ** (k / 4)) for k in range(4, 4 * 60)]
    listed = counts.filter("h IS NOT NULL").select("h", "n")
    many = listed.agg(*[F.count_if(F.col("n") >= t).alias(f"t{k}") for k, t in enumerate(steps)]).first()
    least = next((t for k, t in enumerate(steps) if many[k] <= HEAVY), steps[-1])
    rows = listed.filter(F.col("n") >= least).collect()
    h = np.array([r.h for r in rows], dtype=np.int64).view(U64)
    order = np.argsort(h)
    return h[order], np.array([r.n for r in rows], dtype=np.int64)[order]


def _packed(kind: int, buckets: list[int], docs: list[bytes], entries: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([kind] * len(buckets), pa.int32()), pa.array(buckets, pa.int32()), pa.array(docs, pa.binary()), pa.array(entries, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "docs", "entries"])


def _sums(row: np.ndarray, score: np.ndarray, ids: np.ndarray, tasks: int) -> pa.RecordBatch:
    """Sums by document of what has been scored, packed by the task that will put the document together."""
    own, back = np.unique(ids[row], return_inverse=True)
    n = np.bincount(back, minlength=len(own))
    total = np.bincount(back, weights=score, minlength=len(own))
    task = (_kernel.mix(own.view(U64)) % U64(tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    some, starts = np.unique(task[order], return_index=True)
    docs, entries = [], []
    for part in np.split(order, starts[1:]) if len(order) else []:
        docs.append(_kernel.pack(np.diff(own[part], prepend=0)))
        entries.append(_kernel.pack(n[part].astype(np.uint32), total[part]))
    return _packed(FINISHED, some.tolist(), docs, entries)


def _asked(rows: np.ndarray, columns: tuple[np.ndarray, ...], place: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Occurrences with their rows, dealt by ``place`` (a hash); docs are the ids."""
    order = np.argsort(place, kind="stable")
    cut = _spread(buckets, place[order])
    some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    docs, blobs = [], []
    for b in some:
        part = order[cut[b] : cut[b + 1]]
        part = part[np.argsort(rows[part], kind="stable")]
        own, back = np.unique(rows[part], return_inverse=True)
        docs.append(_kernel.pack(np.diff(ids[own], prepend=0)))
        blobs.append(_kernel.pack(np.diff(back, prepend=0).astype(np.uint32), *(c[part] for c in columns)))
    return _packed(ASKED, some, docs, blobs)


class Model:
    """What every task knows: heavy words and pairs with their counts, and the totals."""

    def __init__(self, words, word_counts, pairs, pair_counts, n_docs: int, n_words: int, alpha: float, min_count: int, buckets: int, tasks: int):
        self.words, self.pairs, self.buckets, self.tasks, self.min_count = words, pairs, buckets, tasks, min_count
        self.log_words = np.log(np.r_[max(n_docs, 1), 1, word_counts].astype(np.float64))  # by code
        self.pair_counts = pair_counts
        self.floor = math.log(alpha) - math.log(max(n_words, 1))


def _occurrences(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", BATCH_BYTES):
                ids, hashes, first, words = _words(batch)
                row, left, right = _pairs(_coded(hashes, model.words), first, words)
                # The bucket of a pair goes by the pair if the left word is heavy, else by that word, whose count is then the bucket's to make.
                light = left >= U64(1 << 32)
                both = _pair_hash(left, right)
                if len(model.pairs):
                    at = np.minimum(np.searchsorted(model.pairs, both), len(model.pairs) - 1)
                    known = (model.pairs[at] == both) & ~light & (right < U64(1 << 32)) & (right != U64(END))
                    here = np.log(model.pair_counts[at[known]]) - model.log_words[left[known].astype(np.int64)]
                    yield _sums(row[known], here, ids, model.tasks)
                else:
                    known = np.zeros(len(row), dtype=bool)
                rest = ~known & (light | (right != U64(END)))
                place = np.where(light, _kernel.mix(left), both)[rest]
                yield _asked(row[rest], (left[rest], right[rest]), place, ids, model.buckets)

    return run


def _gather(parts: list[tuple[bytes, bytes]], *dtypes: type) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Document ids of all senders, each occurrence's place among them, and its columns."""
    ids, rows, columns, n = [], [], [], 0
    for docs, entries in parts:
        own = np.cumsum(_kernel.unpack(docs, np.int64)[0])
        row, *rest = _kernel.unpack(entries, np.uint32, *dtypes)
        ids.append(own)
        rows.append(np.cumsum(row, dtype=np.int64) + n)
        columns.append(rest)
        n += len(own)
    return np.concatenate(ids), np.concatenate(rows), [np.concatenate(c) for c in zip(*columns)]


def _pair_scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for _, parts in _numbered(batches, passed):
            yield from passed
            passed.clear()
            if not parts:
                continue
            ids, row, (left, right) = _gather(parts, U64, U64)
            order = np.lexsort((right, left))
            row, left, right = row[order], left[order], right[order]
            new_left = np.r_[True, left[1:] != left[:-1]]
            new_pair = new_left | np.r_[True, right[1:] != right[:-1]]
            pair = np.cumsum(new_pair) - 1
            count = np.bincount(pair)[pair]
            group = np.cumsum(new_left) - 1
            # A light left word's pairs are all here, its end marks too, so they are as many as the word.
            heavy = left < U64(1 << 32)
            base = np.log(np.bincount(group)[group])
            base[heavy] = model.log_words[left[heavy].astype(np.int64)]
            word = right != U64(END)
            seen = word & (count >= model.min_count)
            plain = word & ~seen & (right < U64(1 << 32))
            score = np.log(count) - base
            score[plain] = model.floor + model.log_words[right[plain].astype(np.int64)]
            done = seen | plain
            yield _sums(row[done], score[done], ids, model.tasks)
            back = word & ~seen & ~plain
            if back.any():
                yield _asked(row[back], (right[back],), right[back], ids, model.buckets)

    return run


def _word_scorer(model: Model):
    """Joins a bucket of the word counts (rows without docs) to the occurrences that backed off to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _numbered(batches):
            asked = [p for p in parts if p[0] is not None]
            if not asked:
                continue
            step, count = next(_kernel.unpack(e, U64, np.int64) for d, e in parts if d is None)
            key, log_count = np.cumsum(step, dtype=U64), np.log(count)
            ids, row, (word,) = _gather(asked, U64)
            score = model.floor + log_count[np.searchsorted(key, word)]
            yield _sums(row, score, ids, model.tasks)

    return run


def _sizes(own: DataFrame) -> tuple[int, int, int]:
    """Bytes, documents with a word, and words."""
    n = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    return tuple(x or 0 for x in own.select(F.octet_length("text").alias("size"), n.alias("n")).agg(F.sum("size"), F.count_if(F.col("n") > 0), F.sum("n")).first())


def scores(docs: DataFrame, alpha: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score): the words of each document and the sum of their log scores.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged, of whole texts; null and wordless
    texts have no words and score 0. Rows that share an id are scored as one
    document's parts, their sums added up; a null id is an id. Other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size, n_docs, n_words = _sizes(own)
    buckets = max(1, math.ceil(size / 6 / BUCKET_ENTRIES))
    spread = max(buckets, _shared.partitions(spark))

    counts = _counted(own.mapInArrow(_word_counter(buckets), COUNTS), spread, n_words, 2, True, "word-counts")
    words, word_counts = _heavy(counts)
    pair_sums = _counted(own.mapInArrow(_pair_counter(buckets, words), COUNTS), spread, n_words, min_count, False, "pair-counts")
    pairs, pair_counts = _heavy(pair_sums)
    _shared.drop(pair_sums)
    _shared.free_shuffles(spark)
    model = Model(words, word_counts, pairs, pair_counts, n_docs, n_words, alpha, min_count, buckets, max(1, -(-min(n_words, n_docs * 3 * buckets) // SUMS_PER_TASK)))

    first = _pair_scores(own, model, spread)
    _shared.free_shuffles(spark)
    asked = first.filter(F.col("kind") == ASKED).select("bucket", "docs", "entries")
    table = counts.filter("entries IS NOT NULL").select("bucket", F.lit(None).cast("binary").alias("docs"), "entries")
    last = table.unionByName(asked).repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(_word_scorer(model), SCORES)
    sums = first.filter(F.col("kind") == FINISHED).unionByName(last).select("bucket", "docs", "entries")
    done = sums.repartition(model.tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_adder, "doc_id long, n_tokens long, score double")
    every = own.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id")).distinct()
    total = every.join(done, "doc_id", "left").select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return total


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each document over all buckets."""
    for _, parts in _numbered(batches):
        if not parts:
            continue
        ids = np.concatenate([np.cumsum(_kernel.unpack(d, np.int64)[0]) for d, _ in parts])
        n, total = (np.concatenate(x) for x in zip(*(_kernel.unpack(e, np.uint32, np.float64) for _, e in parts)))
        own, back = np.unique(ids, return_inverse=True)
        columns = [pa.array(own), pa.array(np.bincount(back, weights=n).astype(np.int64)), pa.array(np.bincount(back, weights=total))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "score"])


def _pair_scores(own: DataFrame, model: Model, spread: int) -> DataFrame:
    # Finished sums keep their own bucket number and ride along, so the texts are read once.
    made = own.mapInArrow(_occurrences(model), SCORES)
    scored = made.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(_pair_scorer(model), SCORES)
    return _shared.materialize(scored, "pair-scores")
