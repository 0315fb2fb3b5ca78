"""SimHash near-duplicate detection by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` of 64 bits agree on some choice of
``bands - radius`` of the ``bands`` bit groups, so each distinct fingerprint is
dealt once for each such choice. Within a bucket the fingerprints are stored
vertically, a plane of machine words for each bit; one pass over the planes
updates 64 distances a word in carry-save counters, and words in which every
lane has passed the radius are abandoned. A bucket is searched from its members
outwards and emits one link for each member reached, never its pairs. At radius
2 a bucket fixes 48 bits, so it can't hold more than 65,536 fingerprints,
whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import _kernel, _shared
from lexforge.llm.components import connected_components

U64 = np.uint64
SEED = 42
_LANES = U64(0x0101010101010101)
_ALL = U64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints ---------------------------------------------------------


def shingle_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle (words joined by one space) and the number of shingles of each row."""
    words = np.diff(first)
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    lead = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(first[:-1], counts) + lead
    last = np.minimum(begin + size, np.repeat(first[1:], counts)) - 1
    edge = np.zeros(len(body) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    keep = inside.copy()
    keep[1:] |= inside[:-1] & ~inside[1:]
    place = np.cumsum(keep) - 1
    text = np.where(inside, body, np.uint8(0x20))[keep].tobytes()
    digest = xxhash.xxh64_intdigest
    spans = zip(place[starts[begin]].tolist(), (place[ends[last] - 1] + 1).tolist())
    return np.fromiter((digest(text[s:e], SEED) for s, e in spans), dtype=U64, count=len(begin)), counts


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the word whose bits are set in over half of its hashes; zero for none.

    Eight byte-wide counters share a machine word, for at most 255 hashes at a time.
    """
    out = np.zeros(len(counts), dtype=U64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // 255)
    row_of = np.repeat(np.cumsum(n) - n, pieces)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts, rows = row_of + 255 * step, np.cumsum(pieces) - pieces
    bits = np.zeros(len(full), dtype=U64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> U64(k)) & _LANES, cuts)
        totals = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), rows, axis=0)
        for byte in range(8):
            bits |= (2 * totals[:, byte] > n).astype(U64) << U64(8 * byte + k)
    out[full] = bits
    return out


def _fingerprinter(shingle: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", 4 << 20):
                body, rows = _kernel.text_bytes(batch.column("text"))
                body = body + ((body >= 65) & (body <= 90)).astype(np.uint8) * np.uint8(32)
                starts, ends, first = _kernel.word_bounds(body, rows)
                prints = majority_bits(*shingle_hashes(body, starts, ends, first, shingle))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text; null and wordless texts have 0."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_fingerprinter(shingle, pa.int64()), "doc_id long, fp long")


# --- comparison -----------------------------------------------------------


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above the radius."""
    above, equal = over.copy(), np.full_like(over, _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def within_radius(planes: np.ndarray, queries: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """For each pair of a query and a plane word, the lanes within the radius.

    planes: 64 x words; queries, word, valid: a fingerprint, a word number and the
    lanes asked for, for each pair. Every eight planes the pairs whose lanes have
    all passed the radius are abandoned.
    """
    out = np.zeros(len(queries), dtype=U64)
    live = np.arange(len(queries))
    counters = [np.zeros(len(queries), dtype=U64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(queries), dtype=U64)
    for bit in range(64):
        carry = planes[bit][word] ^ (U64(0) - ((queries >> U64(bit)) & U64(1)))
        for k, have in enumerate(counters):
            counters[k], carry = have ^ carry, have & carry
        over |= carry
        if bit % 8 == 7:
            near = ~_exceeds(counters, over, radius) & valid
            if bit == 63:
                out[live] = near
                break
            stay = np.flatnonzero(near)
            if len(stay) < len(live):
                live, word, queries, valid, over = live[stay], word[stay], queries[stay], valid[stay], over[stay]
                counters = [x[stay] for x in counters]
            if not len(live):
                break
    return out


def _planes(fps: np.ndarray, slot: np.ndarray, words: int) -> np.ndarray:
    """Bit planes with fingerprint i in lane ``slot[i] % 64`` of word ``slot[i] // 64``; slots ascend."""
    planes = np.zeros((64, words), dtype=U64)
    word, lane = slot >> 6, (slot & 63).astype(U64)
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    for bit in range(64):
        planes[bit, word[heads]] = np.bitwise_or.reduceat(((fps >> U64(bit)) & U64(1)) << lane, heads)
    return planes


def _small_groups(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indices) within groups of 2 to 64 members, a plane word for each group."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(fps)) - np.repeat(starts, sizes)
    planes = _planes(fps, group * 64 + lane, len(sizes))
    lanes = np.where(sizes == 64, _ALL, (U64(1) << np.minimum(sizes, 63).astype(U64)) - U64(1))
    near = within_radius(planes, fps, group, lanes[group] & ~(U64(1) << lane.astype(U64)), radius)
    links = []
    for g in np.unique(group[near != 0]).tolist():
        at, rows = int(starts[g]), near[starts[g] : starts[g] + sizes[g]].tolist()
        left = (1 << len(rows)) - 1
        while left:
            seed = (left & -left).bit_length() - 1
            left &= left - 1
            front = rows[seed] & left
            while front:
                left &= ~front
                reached = 0
                while front:
                    k = (front & -front).bit_length() - 1
                    front &= front - 1
                    links.append((at + seed, at + k))
                    reached |= rows[k]
                front = reached & left
    return links


def _large_group(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within one group of any size: a search outwards, each member compared once with all words left."""
    n = len(fps)
    words = -(-n // 64)
    planes = _planes(fps, np.arange(n), words)
    left = np.full(words, _ALL, dtype=U64)
    if n % 64:
        left[-1] = (U64(1) << U64(n % 64)) - U64(1)
    links, seed = [], 0
    while True:
        while seed < n and not left[seed >> 6] >> U64(seed & 63) & U64(1):
            seed += 1
        if seed == n:
            return links
        left[seed >> 6] &= ~(U64(1) << U64(seed & 63))
        front = np.array([seed])
        while len(front):
            some, front = front[:256], front[256:]
            open_words = np.flatnonzero(left)
            if not len(open_words):
                break
            pair_word = np.tile(open_words, len(some))
            near = within_radius(planes, np.repeat(fps[some], len(open_words)), pair_word, left[pair_word], radius)
            found = np.bitwise_or.reduce(near.reshape(len(some), -1), axis=0)
            lanes = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            reached = open_words[row] * 64 + lane
            left[open_words] &= ~found
            links.extend((seed, k) for k in reached.tolist())
            front = np.concatenate([front, reached])


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span each bucket's groups; equal keys stand together."""
    heads = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1)])
    sizes = np.diff(np.r_[heads, len(fps)])
    links: list[tuple[int, int]] = []
    small = (sizes >= 2) & (sizes <= 64)
    if small.any():
        members = np.flatnonzero(np.repeat(small, sizes))
        kept = sizes[small]
        links += [(members[a], members[b]) for a, b in _small_groups(fps[members], np.cumsum(kept) - kept, kept, radius)]
    for at, n in zip(heads[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        links += [(at + a, at + b) for a, b in _large_group(fps[at : at + n], radius)]
    if not links:
        return fps[:0], fps[:0]
    a, b = np.array(links, dtype=np.int64).T
    return fps[a], fps[b]


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(keys, fps):
            a, b = bucket_links(keys, fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys, fps = np.stack([c.astype(np.int64), k], axis=1), fp.view(U64)
            if held and np.array_equal(held[-1][0][-1], keys[-1]):
                held.append((keys, fps))
                continue
            cut = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            done = [*held, (keys[:cut], fps[:cut])]
            held = [(keys[cut:], fps[cut:])]
            yield links(*(np.concatenate(x) for x in zip(*done)))
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def _masks(radius: int, bands: int) -> list[int]:
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    band = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(bands)]
    masks = [sum(band[i] for i in chosen) for chosen in combinations(range(bands), bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_fingerprints(distinct: DataFrame, radius: int = 2, bands: int = 8) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within the radius of one another."""
    n = _shared.partitions(distinct.sparkSession)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in _masks(radius, bands)])
    dealt = distinct.select(F.posexplode(keys).alias("c", "k"), "fp")
    return dealt.repartition(n, "c", "k").sortWithinPartitions("c", "k").mapInArrow(_linker(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, bands: int = 8
) -> DataFrame:
    """One row per document: (doc_id, fp, component_id, is_kept).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a null,
    empty or wordless text has fingerprint 0 and links like any other. A component
    is named by its smallest doc_id (null only if all its ids are null); is_kept
    holds for rows with that id. Rows that repeat an id are rows of their own.
    Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    prints = _shared.materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = _shared.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    stars = connected_components(link_fingerprints(classes.select("fp"), radius, bands))
    rooted = classes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    # Written, so that adaptive execution can split a component that most fingerprints are in.
    rooted = _shared.materialize(rooted, "rooted")
    named = _shared.materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "named")
    of_print = _shared.materialize(rooted.join(named, "root").select("fp", "component_id"), "components")
    for done in (classes, stars, rooted, named):
        _shared.drop(done)
    _shared.free_shuffles(spark)
    return prints.join(of_print, "fp").select(
        "doc_id", "fp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("is_kept")
    )
