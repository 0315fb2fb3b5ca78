"""Exact dedup by sorting contents.

1. Texts lose their white space. Sampled splitters range-partition the rows by a
   fixed-size image of the normalised bytes (their first bytes, then a hash), and by row
   within equal images, so that a group of copies of any size is cut over as many
   partitions as its rows deserve, and what is sampled and sent with the plan does
   not grow with the length of texts.
2. An external sort places equal texts next to each other, longest original first.
3. Neighbours are compared in full. A group that touches neither end of its
   partition is finished there. Pieces of groups at the ends, two a partition
   at most, are put together by the digest of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.llm import _shared

WHITE = " \t\n\x0b\x0c\r"
#: Leading bytes of a text that splitters see.
PREFIX_BYTES = 24


def _fresh(bodies: pa.Array) -> np.ndarray:
    """Whether a text differs from the one before it; the first counts as different."""
    fresh = np.ones(len(bodies), dtype=bool)
    if len(bodies) > 1:
        fresh[1:] = pc.not_equal(bodies.slice(1), bodies.slice(0, len(bodies) - 1)).to_numpy(zero_copy_only=False)
    return fresh


class _Piece:
    """The rows of one text in one partition, without the text once its digest is known."""

    def __init__(self, body: bytes):
        self.body, self.parts, self.size = body, [], 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)
        self.size += rows.num_rows


def _flush(pieces: list[_Piece], edges: list[bool], spark_partition: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches([b for p in pieces for b in p.parts]).combine_chunks()
    sizes = np.array([p.size for p in pieces])
    first = np.cumsum(sizes) - sizes
    member = np.repeat(np.arange(len(pieces)), sizes)
    digests = pa.array([hashlib.sha256(p.body).hexdigest() for p in pieces])
    kept = np.zeros(len(member), dtype=bool)
    kept[first] = True
    lead = pa.array(first[member])
    out = {
        "row": rows["row"], "doc_id": rows["doc_id"], "text_sha256": digests.take(pa.array(member)), "keep_id": rows["doc_id"].take(lead),
        "keep_chars": rows["chars"].take(lead), "group_size": pa.array(sizes[member]), "kept": pa.array(kept), "edge": pa.array(np.array(edges)[member]),
        "partition": pa.array(np.full(len(member), spark_partition, dtype=np.int32)),
    }
    yield from pa.table(out).to_batches()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal neighbours of a sorted partition; ``edge`` marks its first and its last one."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    held: _Piece | None = None
    start = True  # whether the held piece is the partition's first
    for batch in batches:
        if not batch.num_rows:
            continue
        bodies, rows = batch.column("body").cast(pa.large_binary()), batch.select(["row", "doc_id", "chars"])
        fresh = _fresh(bodies)
        fresh[0] = held is None or held.body != bodies[0].as_py()
        heads = np.flatnonzero(fresh)
        if not fresh[0]:
            held.add(rows.slice(0, int(heads[0]) if len(heads) else batch.num_rows))
        done: list[_Piece] = []
        marks: list[bool] = []
        for at, end in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows]):
            if held is not None:
                done.append(held)
                marks.append(start)
                start = False
            held = _Piece(bodies[at].as_py())
            held.add(rows.slice(at, end - at))
        if done:
            yield from _flush(done, marks, number)
    if held is not None:
        yield from _flush([held], [True], number)


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(None).cast("boolean").alias("row"),
        F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).alias("chars"), F.encode(F.translate(text, WHITE, ""), "utf-8").alias("body"),
    )
    image = [F.substring("body", 1, PREFIX_BYTES).alias("prefix"), F.xxhash64("body").alias("hash"), F.monotonically_increasing_id().alias("place")]
    dealt = own.select("*", *image).repartitionByRange("prefix", "hash", "place")
    return dealt.sortWithinPartitions("prefix", "hash", "body", F.desc("chars"), F.asc_nulls_first("doc_id"), "place")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``keep``'s columns in ``row``, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without ``[\\x20\\x09-\\x0D]``; null counts as empty, and
    all texts without other characters are one group. Of a group the row with the most code points stays,
    then the smallest id, a null id before all others; of rows that tie in both
    exactly one stays, any. Other columns are not read.
    """
    ordered = _sorted(docs, id_col, text_col, keep)
    made = StructType([ordered.schema["row"]])
    for name, kind in (("doc_id", "long"), ("text_sha256", "string"), ("keep_id", "long"), ("keep_chars", "integer"), ("group_size", "long"), ("kept", "boolean"), ("edge", "boolean"), ("partition", "integer")):
        made = made.add(name, kind)
    pieces = _shared.materialize(ordered.mapInArrow(_compare, made), "pieces")
    # The first row of a piece stands for it: two rows a partition at most.
    ends = pieces.filter("edge AND kept").groupBy("text_sha256").agg(
        F.sum("group_size").alias("whole"),
        F.min(F.struct(-F.col("keep_chars"), F.col("keep_id").isNotNull(), "keep_id", "partition")).alias("best"),
    )
    joined = pieces.join(F.broadcast(ends), "text_sha256", "left")
    best = F.col("best")
    cut = F.col("edge")
    return joined.select(
        "row", "doc_id", F.when(cut, best["keep_id"]).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(cut, F.col("whole")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("kept") & (~cut | (F.col("partition") == best["partition"]))).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay."""
    return groups(docs, id_col, text_col, tuple(docs.columns)).filter("kept").select("row.*")
