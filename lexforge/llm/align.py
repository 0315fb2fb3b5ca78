"""Alignment of two tokenizers' tokens over the same text.

Both tokenizers are laid over the bytes of one text. The B tokens' borders are a
static interval index: sorted starts and ends. For each A token two bisections
find the run of B tokens that its bytes meet, and those are its links. A place
that no token of either side spans is a border between groups.

Texts are cut where neither tokenizer can merge: before a space or line break that
follows another character than white space (checked for B against its pieces). No
token crosses such a cut, so tokens, groups and links of a text are those of its
parts one after another. Parts repeat, so a task aligns each part once and remembers a
bounded number of them.

How many documents hold a linked pair is counted in the same pass: each task adds up
its own documents before anything is shuffled. The ``MOST_HOT`` most frequent
pairs, a bound on what is sent to all tasks whatever the corpus, answer almost
all links where the documents are; the others are joined by pair, and none of
them is frequent enough to be a hot key.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm import _kernel, _shared

BATCH_BYTES = 4 << 20
#: Tokens and links that a task remembers of parts it has aligned.
MOST_REMEMBERED = 4 << 20
#: Distinct pairs after which a task hands on what it has counted.
MOST_COUNTED = 1 << 20
#: Pairs that are sent to all tasks.
MOST_HOT = 1 << 19

SPACE = "▁"
_CUT = re.compile(rf"(?<=[^\s{SPACE}])(?=[ \n].)", re.S)
_UNUSUAL = re.compile(rf"[\s{SPACE}][ \n]|\0")


class Tokenizers:
    """A byte-level BPE file (A) and a piece model with byte fallback (B), with the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = _byte_characters()
        names = {i: name for name, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(shown[c] for c in names[i]) if i in names and all(c in shown for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        # Without such pieces no merge reaches over a space, and a line break is a token of its own.
        self.can_cut = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces)
        self.size_b = len(pieces)

    def parts(self, text: str) -> list[str]:
        """The parts of space + text, each with the space or line break that it begins with."""
        whole = " " + text
        if not self.can_cut:
            return [whole]
        if _UNUSUAL.search(whole) or whole[-1] in " \n":
            return _CUT.split(whole)
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        parts[0] = " " + parts[0]
        return parts

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for each part."""
        a = [e.ids for e in self.a.encode_batch(parts, add_special_tokens=False)]
        # The model puts a space before its input, a token of its own where a line break follows.
        b = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return a, [ids if p[0] == " " else ids[1:] for p, ids in zip(parts, b)]


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Memory:
    """Aligned parts: counts, group texts, and links as pairs with their numbers."""

    def __init__(self, tokenizers: Tokenizers):
        self.of = tokenizers
        self.place: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)  # tokens of A, of B, groups, links
        self.pairs = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)
        self.a_sizes = np.array([len(x) for x in tokenizers.a_bytes])
        self.b_sizes = np.array([len(x) for x in tokenizers.b_bytes])

    def __len__(self) -> int:
        return int(self.counts[:, [0, 1, 3]].sum())

    def keep(self, places: np.ndarray) -> np.ndarray:
        """Forget all parts but these; their new places."""
        left = np.unique(places)
        moved = np.full(len(self.groups), -1)
        moved[left] = np.arange(len(left))
        self.place = {k: int(moved[v]) for k, v in self.place.items() if moved[v] >= 0}
        self.groups = [self.groups[i] for i in left]
        self.pairs = self.pairs[_ranges(self.first[left], self.first[left + 1])]
        self.first = np.r_[0, np.cumsum(np.diff(self.first)[left])]
        self.counts = self.counts[left]
        return moved[places]

    def learn(self, parts: list[str]) -> None:
        """Align new parts, all at once: each part's bytes follow those of the one before, so their intervals never meet."""
        a_ids, b_ids = self.of.encode(parts)
        a_bytes, b_bytes = self.of.a_bytes, self.of.b_bytes
        same = []
        for k, part in enumerate(parts):
            body = part.encode()
            same.append(b"".join([a_bytes[i] for i in a_ids[k]]) == body == b"".join([b_bytes[i] for i in b_ids[k]]))
        for k, ok in enumerate(same):
            if not ok:
                a_ids[k], b_ids[k] = [], []
        a, b = (np.fromiter((i for ids in x for i in ids), dtype=np.int64) for x in (a_ids, b_ids))
        a_first, b_first = (np.r_[0, np.cumsum([len(ids) for ids in x])].astype(np.int64) for x in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        low = np.searchsorted(b_end, a_end - self.a_sizes[a], side="right")
        high = np.searchsorted(b_end - self.b_sizes[b], a_end, side="left")
        links = high - low
        pairs = np.repeat(a, links) * self.of.size_b + b[_ranges(low, high)]
        a_cut, b_cut = np.isin(a_end, b_end), np.isin(b_end, a_end)
        groups = _group_texts(a, a_cut, a_first, b, b_cut, b_first)
        total = np.r_[0, np.cumsum(links)]
        n_links = total[a_first[1:]] - total[a_first[:-1]]
        cuts = np.r_[0, np.cumsum(a_cut)]
        new = np.stack([np.diff(a_first), np.diff(b_first), cuts[a_first[1:]] - cuts[a_first[:-1]], n_links], axis=1)
        base = len(self.groups)
        self.place.update((p, base + k) for k, p in enumerate(parts))
        self.groups += [g if ok else None for g, ok in zip(groups, same)]
        self.counts = np.concatenate([self.counts, new])
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(n_links)]
        self.pairs = np.r_[self.pairs, pairs]

    def places(self, parts: list[str]) -> np.ndarray:
        found = list(map(self.place.get, parts))
        if None in found:
            self.learn(list(dict.fromkeys(p for p, at in zip(parts, found) if at is None)))
            found = list(map(self.place.get, parts))
        return np.array(found, dtype=np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places of the ranges [low, high), one range after another."""
    sizes = high - low
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - sizes), sizes)


def _group_texts(a, a_cut, a_first, b, b_cut, b_first) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every part."""

    def sides(ids: np.ndarray, cut: np.ndarray) -> list[str]:
        out, held = [], []
        for i, ends in zip(ids.tolist(), cut.tolist()):
            held.append(str(i))
            if ends:
                out.append(",".join(held))
                held = []
        return out

    both = [f"{x}|{y}" for x, y in zip(sides(a, a_cut), sides(b, b_cut))]
    borders = np.r_[0, np.cumsum(a_cut)][a_first].tolist()
    return [";".join(both[i:j]) for i, j in zip(borders, borders[1:])]


ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, documents array<long>"


def _aligned(ids, rows, counts, digests, links) -> pa.RecordBatch:
    n = len(rows)
    none = pa.nulls(n, pa.list_(pa.int64()))
    columns = [ids, rows, *[pa.array(counts[:, k]) for k in range(4)], pa.array(digests, pa.string()), pa.array(links, pa.binary()), none, none]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])


def _counted(pairs: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
    """Counted pairs in rows of bounded size."""
    step = 1 << 16
    sizes = np.diff(np.r_[np.arange(0, len(pairs), step), len(pairs)])
    n = len(sizes)
    columns = [pa.nulls(n, pa.int64())] * 6 + [pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), _kernel.lists(pairs, sizes, pa.int64()), _kernel.lists(documents, sizes, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])


def _sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's values."""
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    return key[heads], np.add.reduceat(value, heads) if len(heads) else value


def _aligner(a_path: str, b_path: str):
    """Rows of documents (``row`` given) with packed distinct links, and rows of counted pairs (``pairs`` given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(Tokenizers(a_path, b_path))
        counted, numbers = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", BATCH_BYTES):
                texts = batch.column("text").to_pylist()
                split = [memory.of.parts(t) if t else [] for t in texts]
                sizes = np.array([len(x) for x in split])
                at = memory.places([p for x in split for p in x])
                member = np.repeat(np.arange(len(texts)), sizes)
                groups = memory.groups
                bounds = np.r_[0, np.cumsum(sizes)].tolist()
                listed, digests, good = at.tolist(), [], np.zeros(len(texts), dtype=bool)
                for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
                    own = [groups[k] for k in listed[low:high]]
                    good[i] = high > low and None not in own
                    digests.append(hashlib.sha256(";".join(own).encode()).hexdigest() if good[i] else "")
                use = good[member]
                at, member = at[use], member[use]
                counts = np.zeros((len(texts), 4), dtype=np.int64)
                for k in range(4):
                    counts[:, k] = np.bincount(member, weights=memory.counts[at, k], minlength=len(texts)).astype(np.int64)
                base = len(groups)
                held, times = np.unique(member * base + at, return_counts=True)
                low, high = memory.first[held % base], memory.first[held % base + 1]
                # Pairs of all documents of the batch: the document above, the pair's rank among the batch's pairs below.
                names, rank = np.unique(memory.pairs[_ranges(low, high)], return_inverse=True)
                doc = np.repeat(held // base, high - low)
                key, number = _sums([doc * max(1, len(names)) + rank], [np.repeat(times, high - low)])
                owner, rank = key // max(1, len(names)), key % max(1, len(names))
                cut = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
                pair = names[rank]
                links = [_kernel.pack(np.diff(pair[i:j], prepend=0), number[i:j]) if j > i else None for i, j in zip(cut, cut[1:])]
                yield _aligned(batch.column("doc_id"), batch.column("row"), counts, digests, links)
                counted, numbers = _sums([counted, names], [numbers, np.bincount(rank, minlength=len(names))])
                if len(counted) > MOST_COUNTED:
                    yield _counted(counted, numbers)
                    counted = numbers = counted[:0]
                if len(memory) > MOST_REMEMBERED:
                    memory.keep(at)
        if len(counted):
            yield _counted(counted, numbers)

    return run


SCORED = "row long, n_best long, count_sum long, pairs array<long>, times array<long>"


def _scorer(hot):
    """Sums over links whose pair is hot; the other pairs of each document with their numbers of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, documents, best = hot.value
        for batch in batches:
            sums, rare, times = np.zeros((batch.num_rows, 2), dtype=np.int64), [], []
            for i, blob in enumerate(batch.column("links").to_pylist()):
                steps, number = _kernel.unpack(blob, np.int64, np.int64)
                pair = np.cumsum(steps)
                spot = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                known = pairs[spot] == pair
                spot = spot[known]
                sums[i] = (number[known] * best[spot]).sum(), (number[known] * documents[spot]).sum()
                rare.append(pair[~known])
                times.append(number[~known])
            sizes = np.array([len(x) for x in rare])
            flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rare, times)]
            columns = [batch.column("row"), pa.array(sums[:, 0]), pa.array(sums[:, 1]), *[_kernel.lists(x, sizes, pa.int64()) for x in flat]]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])

    return run


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, documents, best): in how many documents each pair is linked, and whether no pair of its A id is in more."""
    each = aligned.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "documents")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.documents").alias("documents"))
    of_a = Window.partitionBy(F.expr(f"pair div {size_b}"))
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(of_a))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_hot: int = MOST_HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads space + text, B the text and puts the space there itself. Null and empty texts, and
    texts that either side's tokens do not give back byte by byte, have no tokens: zeros,
    and an empty digest; they count for no pair. Rows that repeat an id or a text are documents of their own.
    A very long text without white space is one part. Other columns are not read.
    """
    spark = docs.sparkSession
    size_b = Tokenizers(a_path, b_path).size_b
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    aligned = _shared.materialize(own.mapInArrow(_aligner(a_path, b_path), ALIGNED), "aligned")
    counts = _shared.materialize(pair_counts(aligned, size_b), "pair-counts")
    top = counts.orderBy(F.desc("documents"), "pair").limit(most_hot).toArrow().sort_by("pair")
    columns = [top[c].to_numpy() for c in ("pair", "documents", "best")]
    hot = spark.sparkContext.broadcast(columns if len(columns[0]) else [np.array([-1]), np.array([0]), np.array([False])])
    linked = aligned.filter("row IS NOT NULL")
    scored = _shared.materialize(linked.filter("links IS NOT NULL").select("row", "links").mapInArrow(_scorer(hot), SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = rare.join(counts.hint("merge"), "pair").select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("documents")).alias("count_sum"))
    sums = scored.select("row", "n_best", "count_sum").unionByName(met).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return linked.join(sums.hint("merge"), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
