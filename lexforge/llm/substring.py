"""Exact substring dedup with fixed-block anchors.

A window of ``window`` words always holds a whole block that starts at a multiple
of ``window // 2`` words, so two equal windows each hold a reference block that
the other's rolling windows meet.

1. Index and probe. Every run of ``block`` words is hashed; runs at block
   boundaries are the index, all runs are probes. Hashes are dealt by value in
   packed blobs of a few bytes a run, and a bucket answers which runs share their
   hash with an index block elsewhere. A task sends each hash once: runs that repeat
   inside its own batch are hits already, so a passage that a third of all
   documents hold costs one entry a batch.
2. Extend. Only windows around a hit are hashed, with 128 bits, and dealt the same
   way; again each batch sends the earliest start of each window and knows the
   others to be later copies. A bucket keeps the earliest start over all batches;
   overlapping later windows add up to the maximal exact repeats.
3. Words under a later window are removed.

Places are (batch, row, start): the row of a slice of a task. In step 1 a table of a row
per document says which id and text that is; step 2 writes its texts beside their places.
So what is found holds for the row it was found in, whatever ids repeat or are null.

The short hashes of step 1 only choose candidates; their width grows with the
logarithm of the corpus, so that chance hits stay rare at any size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import _kernel, _shared
from lexforge.llm._kernel import BASES, U64

BATCH_BYTES = 4 << 20
#: Entries that one bucket is to hold on average.
BUCKET_ENTRIES = 1 << 20
NULL_ID = -(1 << 63)
PACKED = "bucket int, batch long, docs binary, entries binary, row int, start int, doc_id long, t1 long, t2 long"
#: Answers with a start are hits; those without say which document a row is.
PLACED = ["batch", "row", "start", "doc_id", "t1", "t2"]
MATCHED = "batch long, row int, start int, doc_id long, t1 long, t2 long"
KEY = ["doc_id", "t1", "t2"]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _batches() -> Iterator[int]:
    """Numbers of the slices of this task, the same whenever it runs again."""
    from pyspark import TaskContext

    return itertools.count(TaskContext.get().partitionId() << 32)


def _spans(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the flagged word places."""
    at = np.flatnonzero(flags)
    row = np.searchsorted(first, at, side="right") - 1
    return row.astype(np.int32), (at - first[row]).astype(np.int32)


def _packed(n: int, **columns) -> pa.RecordBatch:
    """Rows of ``PACKED`` with the columns that are given."""
    names, kinds = zip(*(f.split() for f in PACKED.split(", ")))
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    made = [pa.array(columns[c], type=types[k]) if c in columns else pa.nulls(n, types[k]) for c, k in zip(names, kinds)]
    return pa.RecordBatch.from_arrays(made, names)


def _deal(buckets: int, tops: np.ndarray, row: np.ndarray, place: np.ndarray, encode, ids: np.ndarray | None = None) -> tuple[list[int], list[bytes], list[bytes]]:
    """(bucket, docs, entries) blobs of entries in the order of their hashes ``tops``; a blob names only the rows that it has entries of, with their ids if given."""
    cut = _spread(buckets, tops)
    some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
    docs, blobs = [], []
    for b in some:
        part = slice(int(cut[b]), int(cut[b + 1]))
        own, back = np.unique(row[part], return_inverse=True)
        docs.append(_kernel.pack(np.diff(own, prepend=0).astype(np.uint32), *([np.diff(ids[own], prepend=0)] if ids is not None else [])))
        blobs.append(_kernel.pack(back.astype(np.uint32), place[part].astype(np.uint32), *encode(part)))
    return some, docs, blobs


def _spread(buckets: int, tops: np.ndarray) -> np.ndarray:
    """Bucket borders among ascending hashes: bucket k has the k-th part of the hash range."""
    borders = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=U64)
    return np.r_[0, np.searchsorted(tops, borders), len(tops)]


def _prober(window: int, buckets: int, width: int):
    block = window // 2
    shift = U64(64 - 8 * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _batches()
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", BATCH_BYTES):
                number = next(numbers)
                body, rows = _kernel.text_bytes(batch.column("text"))
                starts, ends, first = _kernel.word_bounds(body, rows)
                words = np.diff(first)
                hashes = _kernel.window_hashes(_kernel.word_hashes(body, starts, ends, BASES[0]), block, BASES[0])
                if not len(hashes):
                    continue
                row = np.repeat(np.arange(len(words)), words)[: len(hashes)]
                place = np.arange(len(hashes)) - first[row]
                use = np.flatnonzero((words[row] >= window) & (place <= words[row] - block))
                hashes = (hashes[use] >> shift) << shift
                order = np.argsort(hashes, kind="stable")
                hashes, use = hashes[order], use[order]
                if not len(use):
                    continue
                heads = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
                sizes = np.diff(np.r_[heads, len(hashes)])
                aligned = np.logical_or.reduceat(place[use] % block == 0, heads)
                flags = np.zeros(len(starts), dtype=bool)
                flags[use[np.repeat(sizes > 1, sizes)]] = True
                long = np.flatnonzero(words >= window).astype(np.int32)
                told = {c: batch.column(c).take(pa.array(long)) for c in KEY}
                yield _packed(len(long), bucket=long % buckets, batch=np.full(len(long), number), row=long, **told)
                row_of, start = _spans(flags, first[:-1])
                yield _packed(len(start), bucket=row_of % buckets, batch=np.full(len(start), number), row=row_of, start=start)
                keys, lead = hashes[heads], use[heads]
                spot = place[lead] * 2 + aligned
                made = _deal(buckets, keys, row[lead], spot, lambda part: [np.diff(keys[part] >> shift, prepend=U64(0))])
                yield _packed(len(made[0]), bucket=made[0], batch=np.full(len(made[0]), number), docs=made[1], entries=made[2])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """The (batch, docs, entries) blobs of one bucket after the other, as rows come sorted by bucket; finished answers go to ``passed``."""
    held: list[tuple[int, bytes, bytes]] = []
    now = None
    for batch in batches:
        packed = batch.column("docs").is_valid()
        if "start" in batch.schema.names:
            passed.append(batch.filter(pc.invert(packed)).select(PLACED))
        batch = batch.filter(packed)
        for bucket, number, docs, entries in zip(*(batch.column(c).to_pylist() for c in ("bucket", "batch", "docs", "entries"))):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append((number, docs, entries))
    yield held


def _answer(number: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(number), pa.array(row.astype(np.int32)), pa.array(start.astype(np.int32))], ["batch", "row", "start"])


def _opened(parts: list[tuple[int, bytes, bytes]], with_ids: bool, *dtypes: type) -> tuple[np.ndarray, ...]:
    """(batch, row, doc_id, place, columns...) of all entries of a bucket, as lists by sender for the columns; ids are zero where they were not sent."""
    numbers, rows, ids, places, columns = [], [], [], [], []
    for number, docs, entries in parts:
        steps, *own = _kernel.unpack(docs, np.uint32, *([np.int64] if with_ids else []))
        back, place, *rest = _kernel.unpack(entries, np.uint32, np.uint32, *dtypes)
        numbers.append(np.full(len(back), number, dtype=np.int64))
        rows.append(np.cumsum(steps, dtype=np.int64)[back])
        ids.append(np.cumsum(own[0])[back] if own else np.zeros(0, dtype=np.int64))
        places.append(place.astype(np.int64))
        columns.append(rest)
    return *(np.concatenate(x) for x in (numbers, rows, ids, places)), list(zip(*columns))


def _matcher():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for parts in _by_bucket(batches, passed):
            yield from passed
            passed.clear()
            if not parts:
                continue
            number, row, _, spot, (steps,) = _opened(parts, False, U64)
            key = np.concatenate([np.cumsum(k, dtype=U64) for k in steps])
            order = np.argsort(key, kind="stable")
            key, spot = key[order], spot[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[heads, len(key)])
            hit = (sizes > 1) & (np.bitwise_or.reduceat(spot, heads) & 1).astype(bool)
            take = np.repeat(hit, sizes)
            order = order[take]
            found, n = _answer(number[order], row[order], spot[take] >> 1), int(take.sum())
            yield pa.RecordBatch.from_arrays([*found.columns, *[pa.nulls(n, pa.int64())] * 3], PLACED)

    return run


EXTENDED = "kind int, batch long, row int, doc_id long, n_words long, text binary, start int, bucket int, docs binary, entries binary"


def _extended(n: int, kind: int, **columns) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in EXTENDED.split(", ")]
    columns["kind"] = np.full(n, kind, dtype=np.int32)
    made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], type=t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)]
    return pa.RecordBatch.from_arrays(made, names)


def _extender(window: int, buckets: int):
    """Rows of four kinds: 0 a document that no hit touches, with its kept text; 1 one with hits; 2 later windows known already; 3 packed windows."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _batches()
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", BATCH_BYTES):
                number = next(numbers)
                body, rows = _kernel.text_bytes(batch.column("text"))
                starts, ends, first = _kernel.word_bounds(body, rows)
                words = np.diff(first)
                ids = _ids(batch.column("doc_id"))
                flags = np.zeros(len(starts) + 1, dtype=np.int32)
                flags[_kernel.places(batch.column("hits"), first)] = 1
                met = np.cumsum(flags)
                row = np.repeat(np.arange(len(words)), words)
                place = np.arange(len(starts))
                fits = np.flatnonzero(place - first[row] <= words[row] - window)
                near = fits[met[np.minimum(fits + window - block, len(starts))] > np.where(fits > 0, met[fits - 1], 0)] if len(fits) else fits
                touched = np.zeros(len(words), dtype=bool)
                touched[row[near]] = True
                texts = batch.column("text").cast(pa.binary()).fill_null(b"")
                yield _extended(int((~touched).sum()), 0, doc_id=ids[~touched], n_words=words[~touched], text=texts.filter(pa.array(~touched)))
                if not len(near):
                    continue
                held = np.flatnonzero(touched).astype(np.int32)
                yield _extended(len(held), 1, batch=np.full(len(held), number), row=held, doc_id=ids[touched], n_words=words[touched], text=texts.filter(pa.array(touched)))
                hashed = [_kernel.window_hashes(_kernel.word_hashes(body, starts, ends, b), window, b)[near] for b in BASES]
                where, doc = near - first[row[near]], ids[row[near]]
                order = np.lexsort((where, doc, hashed[1], hashed[0]))
                a, b, doc, where, near = hashed[0][order], hashed[1][order], doc[order], where[order], near[order]
                fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                heads = np.flatnonzero(fresh)
                lead = heads[np.cumsum(fresh) - 1]
                later = (doc != doc[lead]) | (where != where[lead])
                later_flags = np.zeros(len(starts), dtype=bool)
                later_flags[near[later]] = True
                got_row, got = _spans(later_flags, first[:-1])
                yield _extended(len(got), 2, batch=np.full(len(got), number), row=got_row, start=got)
                # Every start that ties with the earliest is sent, so rows that repeat an id fare alike.
                send = np.flatnonzero(~later)
                a, b, near = a[send], b[send], near[send]
                made = _deal(buckets, a, row[near], near - first[row[near]], lambda part: [a[part], b[part]], ids)
                yield _extended(len(made[0]), 3, bucket=made[0], batch=np.full(len(made[0]), number), docs=made[1], entries=made[2])

    return run


def _earliest():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for parts in _by_bucket(batches, passed):
            yield from passed
            passed.clear()
            if not parts:
                continue
            number, row, doc, where, (low, high) = _opened(parts, True, U64, U64)
            a, b = np.concatenate(low), np.concatenate(high)
            order = np.lexsort((where, doc, b, a))
            a, b, doc, number, row, where = (x[order] for x in (a, b, doc, number, row, where))
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            later = (doc != doc[lead]) | (where != where[lead])
            yield _answer(number[later], row[later], where[later])

    return run


def _remover(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", BATCH_BYTES):
                words = batch.column("n_words").to_numpy()
                first = np.r_[0, np.cumsum(words)]
                edge = np.zeros(int(first[-1]) + 1, dtype=np.int32)
                at = np.unique(_kernel.places(batch.column("later"), first[:-1]))
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                total = np.r_[0, np.cumsum(gone)]
                removed = total[first[1:]] - total[first[:-1]]
                kept = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    split = text.split()
                    if removed[i]:
                        split = [w for w, g in zip(split, gone[first[i] : first[i + 1]].tolist()) if not g]
                    kept.append(b" ".join(split))
                ids = batch.column("doc_id")
                ids = pc.if_else(pc.equal(ids, NULL_ID), pa.scalar(None, pa.int64()), ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(removed), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


ANSWER = "batch long, row int, start int"


def _starts(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("batch", "row").agg(F.collect_list("start").alias(name))


def _hits(own: DataFrame, window: int, buckets: int, width: int, spread: int) -> DataFrame:
    packed = own.mapInArrow(_prober(window, buckets, width), PACKED)
    dealt = packed.repartition(spread, "bucket").sortWithinPartitions("bucket")
    return _shared.materialize(dealt.mapInArrow(_matcher(), MATCHED), "hits")


def _extend(own: DataFrame, hits: DataFrame, window: int, buckets: int) -> DataFrame:
    found = hits.filter("start IS NOT NULL").select("batch", "row", "start")
    known = hits.filter("start IS NULL").select("batch", "row", *KEY)
    # Rows of one id and one text need the same windows looked at, so any one's hits do for all.
    of_text = _starts(found, "hits").join(known, ["batch", "row"]).groupBy(*KEY).agg(F.any_value("hits").alias("hits"))
    joined = own.join(of_text.hint("merge"), KEY, "left")
    return _shared.materialize(joined.mapInArrow(_extender(window, buckets), EXTENDED), "extended")


def _later(extended: DataFrame, spread: int) -> DataFrame:
    dealt = extended.filter("kind = 3").select("bucket", "batch", "docs", "entries").repartition(spread, "bucket").sortWithinPartitions("bucket")
    known = extended.filter("kind = 2").select("batch", "row", "start")
    return _shared.materialize(dealt.mapInArrow(_earliest(), ANSWER).unionByName(known), "later")


def dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space, as UTF-8 bytes).

    Words are ``[^\\x20\\x09-\\x0D]+``; ``window`` is even. A word goes if a window
    over it also starts earlier, in a document with a smaller id or earlier in
    the same one; all windows are judged on the input. Null and empty texts have no
    words. A null id is the smallest. Rows that share an id stand at the same place: a window is later than
    one that begins further up in another of them, and of windows at one place neither is. Words go only
    from the rows whose windows are later. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), *_shared.text_marks(text), text.alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = max(1, size // 5)
    buckets = max(1, math.ceil(runs / BUCKET_ENTRIES))
    width = min(8, max(3, math.ceil((math.log2(runs) + 7) / 8)))
    spread = max(buckets, _shared.partitions(spark))

    hits = _hits(own, window, buckets, width, spread)
    _shared.free_shuffles(spark)
    extended = _extend(own, hits, window, buckets)
    _shared.drop(hits)
    _shared.free_shuffles(spark)
    later = _later(extended, spread)
    _shared.free_shuffles(spark)
    left = extended.filter("kind <= 1").select("kind", "batch", "row", "doc_id", "text", "n_words")
    some = left.filter("kind = 1").join(_starts(later, "later").hint("merge"), ["batch", "row"], "left").select("doc_id", "text", "n_words", "later")
    none = left.filter("kind = 0").select("doc_id", "text", "n_words", F.lit(None).cast("array<int>").alias("later"))
    return none.unionByName(some).mapInArrow(_remover(window), "doc_id long, n_words long, n_removed long, kept binary")
