"""Near copies by Jaccard similarity of word shingles: SimHash links, then MinHash buckets, exact confirmation.

Texts with one set of shingles are one node. Nodes whose SimHash fingerprints link
within ``RADIUS`` bits, by the search of ``simhash``, are compared by the exact sets
first, and those that are similar start as one component. At 0.8 most pairs differ in
more bits than any such search can afford, so what it leaves apart is met in buckets.

Every node is dealt to ``BANDS``
buckets, each named by ``ROWS`` minima of its shingles under random orders; two
nodes of similarity s share no bucket with probability (1 - s^5)^32, three in a
million at 0.8. What shares a bucket is compared by the exact sets.

Before sets meet, short facts say what can't be similar. A partner of similarity
s shares s / (1 + s) of both sizes added up, and no node shares more shingles
than it has in common with any other node of a bucket; and two sets differ in at
least as many shingles as their parity sketches differ in bits, counted without
carry by exclusive or. Nodes and pairs that fall short are left out, which loses none.

A bucket's members stand at random places between 0 and its size. Each round
takes the next stretch of them, eight times as long as all before, as centres and
compares each with all members behind it, but only across components found so
far. After the last round every pair of a bucket has been compared, ruled out or
was already connected, so the components are exact, and a large group of near
copies costs about its size: most of it is connected after the first centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import _kernel, _shared
from lexforge.llm.components import connected_components
from lexforge.llm.simhash import link_fingerprints, majority_bits, shingle_hashes

U64 = np.uint64
ROWS, BANDS = 5, 32
#: Bits in which linked fingerprints may differ.
RADIUS = 2
SEED = 42
#: Text that a task works on at once; what it needs for that is some thirty times as much.
SLICE_BYTES = 1 << 19
#: Centres of the first round, and the growth of the stretch by rounds.
CENTRES, GROWTH = 1, 8
ROW_KEY = ["doc_id", "t1", "t2"]
#: Words of the parity sketch, a power of two.
SKETCH = [f"p{k}" for k in range(8)]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list:
    """The id and a 128-bit hash of the text: rows that share both are copies of one another."""
    text = F.col(text_col).cast("string")
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")]


def only_keyed(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose row key is (left_semi) or isn't (left_anti) in ``keys``; null ids are equal."""
    own = docs.select("*", *[k.alias(f"_{c}") for k, c in zip(row_key(id_col, text_col), ROW_KEY)])
    other = keys.select(*[F.col(c).alias(f"_k{c}") for c in ROW_KEY]).hint("merge")
    same = [F.col(f"_{c}").eqNullSafe(F.col(f"_k{c}")) for c in ROW_KEY]
    return own.join(other, same[0] & same[1] & same[2], how)


def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def distinct_shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct hashes of every row and their numbers."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(counts))


def band_keys(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows x BANDS bucket names; every row has a shingle."""
    starts = np.cumsum(counts) - counts
    out = np.zeros((len(counts), BANDS), dtype=U64)
    for k, m in enumerate(_multipliers()):
        band = k // ROWS
        low = np.minimum.reduceat(_kernel.mix(sets * m), starts)
        out[:, band] = _kernel.mix(out[:, band] * U64(31) + low + U64(band + 1))
    return out


def _hashes(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    body, rows = _kernel.text_bytes(batch.column("text"))
    body = body + ((body >= 65) & (body <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends, first = _kernel.word_bounds(body, rows)
    return shingle_hashes(body, starts, ends, first, shingle)


def _printer(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", SLICE_BYTES):
                own = _hashes(batch, shingle)
                fps = majority_bits(*own)
                sets, counts = distinct_shingles(*own)
                bounds = np.r_[0, np.cumsum(counts)]
                names = np.fromiter((xxhash.xxh3_64_intdigest(sets[s:e].tobytes()) for s, e in zip(bounds[:-1], bounds[1:])), dtype=U64, count=len(counts))
                full = np.flatnonzero(counts)
                keys = band_keys(sets, counts[full]).view(np.int64).reshape(-1) if len(full) else np.zeros(0, dtype=np.int64)
                columns = [*(batch.column(c) for c in ROW_KEY), pa.array(names.view(np.int64)), pa.array(fps.view(np.int64)), _kernel.lists(keys, np.where(counts > 0, BANDS, 0), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*ROW_KEY, "c", "fp", "bands"])

    return run


def _teller(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", SLICE_BYTES):
                sets, counts = distinct_shingles(*_hashes(batch, shingle))
                yield pa.RecordBatch.from_arrays([batch.column("c"), _kernel.lists(sets.view(np.int64), counts, pa.int64())], ["c", "shingles"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))


def prints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row key, the name ``c`` of the set of shingles, the SimHash fingerprint and the buckets; a wordless text has the empty set and no bucket."""
    return _keyed(docs, id_col, text_col).mapInArrow(_printer(shingle), "doc_id long, t1 long, t2 long, c long, fp long, bands array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of which the sets are as similar as asked."""
    one = sets.select(F.col("c").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("c").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.filter(both >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - both) - 1e-9).select("a", "b")


def _crowded(dealt: DataFrame) -> DataFrame:
    """The rows of buckets ``k`` that hold two or more, with that ``size``."""
    # A merge of plain exchanges, so adaptive execution can split a bucket that many rows are in.
    shared = _shared.materialize(dealt.groupBy("k").agg(F.count("*").alias("size")).filter("size > 1"), "crowds")
    return dealt.join(shared.hint("merge"), "k")


def _supported(sets: DataFrame, similarity: float) -> DataFrame:
    """(c, n, held, sketch): the size of each set, how many of its shingles another set has too, where that is enough for a partner, and its parity sketch."""
    each = sets.select("c", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count("*").alias("sets"), F.min("c").alias("c"))
    alone = alone.filter("sets = 1").groupBy("c").agg(F.count("*").alias("alone"))
    word = F.call_function("shiftright", F.col("s"), F.lit(6)).bitwiseAND(F.lit(len(SKETCH) - 1).cast("long"))
    spot = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    sketch = [F.bit_xor(F.when(word == k, spot).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(SKETCH)]
    counted = each.groupBy("c").agg(F.count("*").alias("n"), *sketch).join(alone.hint("merge"), "c", "left")
    return counted.select("c", "n", *SKETCH, (F.col("n") - F.coalesce("alone", F.lit(0))).alias("held")).filter(F.col("held") >= F.lit(similarity) * F.col("n") - 1e-9)


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that connect all whose fingerprints link; classes: (c, fp, bands), one row per node."""
    own = classes.filter(F.size("bands") > 0).select("c", "fp")
    heads = _shared.materialize(own.groupBy("fp").agg(F.min("c").alias("head")), "heads")
    equal = own.join(heads.hint("merge"), "fp").select(F.col("head").alias("a"), F.col("c").alias("b"))
    ends = [heads.select(F.col("fp").alias(x), F.col("head").alias(f"of_{x}")).hint("merge") for x in "ab"]
    apart = link_fingerprints(heads.select("fp"), RADIUS).join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    pairs = equal.unionByName(apart).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    made = _shared.materialize(pairs.distinct(), "simhash")
    _shared.drop(heads)
    return made


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components ``roots`` after these links; None while there is no link at all."""
    made = connected_components(links if roots is None else links.unionByName(roots))
    if made.head(1):
        _shared.drop(roots)
        return made
    _shared.drop(made)
    return None


def components(classes: DataFrame, sets_of, similarity: float, found: DataFrame | None = None) -> DataFrame | None:
    """(a, b): each node with the smallest of its component, where that is another one; None if there is none.

    classes: (c, bands), one row per node; sets_of gives (c, shingles) for the nodes asked for; ``found``
    has pairs (a, b) of nodes to compare before any bucket is.
    """
    dealt = _shared.materialize(classes.select("c", F.explode("bands").alias("k")), "buckets")
    met = _shared.materialize(_crowded(dealt), "crowded")
    _shared.drop(dealt)
    asked = met.select("c")
    if found is not None:
        asked = asked.union(found.select("a")).union(found.select("b"))
    sets = _shared.materialize(sets_of(asked.distinct()), "sets")
    roots = None if found is None else _joined(None, _confirmed(found, sets, similarity))
    facts = _shared.materialize(_supported(sets, similarity), "facts")
    placed = _shared.materialize(met.select("k", "c").join(facts.hint("merge"), "c"), "placed")
    _shared.drop(met)
    unit = F.xxhash64("k", "c").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    members = _shared.materialize(_crowded(placed).withColumn("place", unit * F.col("size")), "members")
    _shared.drop(placed)
    largest = members.agg(F.max("size")).first()[0]
    if largest is None:
        return roots
    overlap = F.lit(similarity / (1 + similarity))
    begin, end = 0, CENTRES
    while begin < largest:
        behind = members.filter(F.col("size") > begin)
        if roots is None:
            behind = behind.withColumn("root", F.col("c"))
        else:
            named = roots.select(F.col("a").alias("c"), F.col("b").alias("root")).hint("merge")
            behind = behind.join(named, "c", "left").withColumn("root", F.coalesce("root", "c"))
            # Buckets of one component have nothing left to compare.
            mixed = behind.groupBy("k").agg((F.min("root") < F.max("root")).alias("mixed")).filter("mixed").select("k").hint("merge")
            behind = _shared.materialize(behind.join(mixed, "k", "left_semi"), "behind")
        centres = behind.filter((F.col("place") >= begin) & (F.col("place") < end))
        centres = centres.select("k", *[F.col(c).alias(f"its_{c}") for c in ("c", "n", "held", "place", "root", *SKETCH)]).hint("merge")
        after = (F.col("place") > F.col("its_place")) | ((F.col("place") == F.col("its_place")) & (F.col("c") > F.col("its_c")))
        both = F.col("n") + F.col("its_n")
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"its_{c}"))) for c in SKETCH), F.lit(0))
        can = (F.least("held", "its_held") >= overlap * both - 1e-9) & (apart <= (1 - 2 * overlap) * both + 1e-9)
        near = behind.join(centres, "k").filter(after & (F.col("root") != F.col("its_root")) & can)
        pairs = near.select(F.least("c", "its_c").alias("a"), F.greatest("c", "its_c").alias("b")).distinct()
        roots = _joined(roots, _confirmed(pairs, sets, similarity))
        _shared.drop(behind)
        begin, end = end, end * GROWTH
    _shared.drop(members)
    _shared.drop(sets)
    return roots


def survivors(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row key (doc_id, t1, t2) of one row for each group of near copies: that with the smallest id, null being the largest.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words
    than a shingle is one shingle of its own length, and all texts without a word
    are copies. Ids need be neither unique nor there: rows are told apart by
    their texts, and groups are the components over all pairs of the similarity.
    """
    found = _shared.materialize(prints(docs, shingle, id_col, text_col), "prints")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *ROW_KEY)).alias("low")
    classes = _shared.materialize(found.groupBy("c").agg(low, F.first("bands").alias("bands"), F.min("fp").alias("fp")), "classes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        # One row of each node tells its set again from its text; rows that share even the key are equal.
        heads = classes.join(nodes.hint("merge"), "c", "left_semi").select("c", *[F.col(f"low.{c}").alias(f"_{c}") for c in ROW_KEY]).hint("merge")
        own = _keyed(docs, id_col, text_col)
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW_KEY]
        told = own.join(heads, same[0] & same[1] & same[2]).dropDuplicates(["c"])
        return told.select("c", "text").mapInArrow(_teller(shingle), "c long, shingles array<long>")

    linked = simhash_pairs(classes)
    roots = components(classes.select("c", "bands"), sets_of, similarity, linked)
    lows = classes.select("c", "low")
    if roots is not None:
        named = roots.select(F.col("a").alias("c"), F.col("b").alias("root")).hint("merge")
        lows = lows.join(named, "c", "left").groupBy(F.coalesce("root", "c").alias("c")).agg(F.min("low").alias("low"))
    kept = _shared.materialize(lows.select("low.*").select(*ROW_KEY), "survivors")
    for done in (found, classes, linked, roots):
        _shared.drop(done)
    _shared.free_shuffles(docs.sparkSession)
    return kept


def keep_survivors(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of near copies."""
    own = only_keyed(docs, survivors(docs, shingle, similarity), "left_semi")
    return own.dropDuplicates([f"_{c}" for c in ROW_KEY]).select(docs.columns)
