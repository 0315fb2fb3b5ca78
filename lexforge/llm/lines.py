"""Line dedup over hashed windows of line ids.

Documents are sequences of line ids (128-bit hashes of the lines that hold a
word). Doubling names, for every place, its first 1, 2, ... up to ``min_lines``
lines: a round pairs the name of a place with that of the place as many lines
further on. Names are hashes of what they name, so equal windows get equal names
on every machine without a global numbering pass. There is no suffix array: no
suffixes are sorted and no common prefix beyond ``min_lines`` is measured, as
the union of the windows covers the same lines. Places whose name nobody else
has are discarded before each round; most go in the first.

At ``min_lines`` the shared names hold exactly the starts of repeated runs at least
that long. The member with the smallest (doc_id, line) is the original; all
others are later copies, and the lines that their overlapping starts cover, the
maximal repeated runs, are deleted. Where ``min_words`` is given, shorter runs of
that many words count too; names then grow by one line a round, so that every
length below ``min_lines`` is looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm import _kernel, _shared

NULL_ID = -(1 << 63)
#: Text that a task takes apart at once.
SLICE_BYTES = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]")
#: A row, by its id and its text.
KEY = ["doc_id", "t1", "t2"]


def suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1, words: bool = False) -> DataFrame:
    """(doc_id, t1, t2, pos, a, b): every line with a word of rows with ``min_lines`` such lines, its place among them and its 128-bit name.

    Rows with one id and one text stand once: they have the same places and the same copies. With ``words`` also the number of words of the run that is named (``w``) and of its last line (``v``).
    """
    lines = F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda x: x.rlike(_WORD.pattern))
    count = lambda x: F.size(F.filter(F.split(F.regexp_replace(x, r"[\x09-\x0D]", " "), " "), lambda y: y != ""))
    name = lambda x: [F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), *([count(x).alias("w")] if words else [])]
    names = F.transform(lines, lambda x: F.struct(*name(x)))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), *_shared.text_marks(F.col(text_col).cast("string")), names.alias("names"))
    rows = own.filter(F.size("names") >= min_lines).select(*KEY, F.posexplode("names").alias("pos", "name"))
    more = [F.col("name.w"), F.col("name.w").alias("v")] if words else []
    return rows.select(*KEY, "pos", "name.a", "name.b", *more).distinct()


def intervals(named: DataFrame) -> DataFrame:
    """(a, b, first): names that two or more suffixes have, with the earliest of them."""
    grouped = named.groupBy("a", "b").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return grouped.filter("size > 1").drop("size")


def _paired(left: DataFrame, step: int) -> DataFrame:
    """Names of twice the length (or of ``step`` more lines): each suffix with the one ``step`` lines further on."""
    words = "w" in left.columns
    right = left.select(*KEY, (F.col("pos") - step).alias("pos"), F.col("a").alias("a2"), F.col("b").alias("b2"), *([F.col("v").alias("v2")] if words else []))

    def name(c: str) -> Column:
        return F.xxhash64(c, f"{c}2").alias(c)

    # Only names that grow by one line carry words, so the last line's are what is added.
    more = [(F.col("w") + F.col("v2")).alias("w"), F.col("v2").alias("v")] if words else []
    return left.join(right, [*KEY, "pos"]).select(*KEY, "pos", name("a"), name("b"), *more)


def repeated_starts(docs: DataFrame, min_lines: int, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """(doc_id, t1, t2, pos, len, first): starts of runs of ``min_lines`` lines that also start earlier, at ``first``.

    With ``min_words`` also of shorter runs that hold so many words.
    """
    words = min_words is not None
    named = _shared.materialize(suffixes(docs, id_col, text_col, 1 if words else min_lines, words), "suffixes")
    length, shorter = 1, None

    def later(some: DataFrame, shared: DataFrame) -> DataFrame:
        found = some.join(shared, ["a", "b"]).filter(F.struct("doc_id", "pos") > F.col("first"))
        return found.select(*KEY, "pos", F.lit(length).alias("len"), "first")

    while True:
        # Written, so that both sides of the joins are plain exchanges and adaptive execution can split a name that many suffixes have.
        shared = _shared.materialize(intervals(named), "intervals").hint("merge")
        if length == min_lines:
            found = later(named, shared)
            return _shared.materialize(found if shorter is None else found.unionByName(shorter), "repeats")
        if words:
            own = _shared.materialize(later(named.filter(F.col("w") >= min_words), shared), "repeats")
            shorter = own if shorter is None else shorter.unionByName(own)
        alive = _shared.materialize(named.join(shared.select("a", "b"), ["a", "b"], "left_semi"), "suffixes")
        _shared.drop(named)
        step = 1 if words else min(length, min_lines - length)
        named = _shared.materialize(_paired(alive, step), "suffixes")
        _shared.drop(alive)
        length += step


def _deleter():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _kernel.text_slices(whole, "text", SLICE_BYTES)):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist()):
                lines = (text or "").split("\n")
                content = [i for i, x in enumerate(lines) if _WORD.search(x)]
                edge = np.zeros(len(content) + 1, dtype=np.int32)
                if found:
                    at = np.array([(x["pos"], x["len"]) for x in found], dtype=np.int64)
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at.sum(axis=1), -1)
                gone = {content[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] > 0).tolist()}
                kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
                out.append((len(content), len(gone), kept))
            columns = [pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "n_lines", "n_removed", "kept"])

    return run


def dedup(
    docs: DataFrame, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int | None = None
) -> DataFrame:
    """The columns ``keep`` of every row, with n_lines, n_removed and kept (the text without later copies).

    Lines are cut at ``\\n`` and compared exactly; lines without a word are not
    part of runs and stay. Null text stays null and has no lines. A null id is the
    smallest. Rows that share an id stand at the same place: a run is a later copy of one that begins
    further up in another of them, and of runs at one place neither is. Deletions hold for the rows they were found in alone.
    A run is deleted from ``min_lines`` lines on or, if given, from ``min_words`` words on.
    """
    starts = repeated_starts(docs, min_lines, id_col, text_col, min_words)
    by_doc = starts.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "len")).alias("later"))
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    text = F.col(text_col).cast("string")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), *_shared.text_marks(text), row.alias("row"), text.alias("text"))
    kind = own.schema["row"].dataType.simpleString()
    # The deletions grow with the corpus, so they are never broadcast.
    joined = own.join(by_doc.hint("merge"), KEY, "left").select("row", "text", "later")
    done = joined.mapInArrow(_deleter(), f"row {kind}, n_lines long, n_removed long, kept string")
    return done.select("row.*", "n_lines", "n_removed", "kept")


def dedup_documents(docs: DataFrame, min_lines: int = 3, text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """``docs`` with later copies of line runs gone; documents that lose all their lines go with them."""
    names = docs.columns
    packed = docs.select(F.col("doc_id"), F.col(text_col), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    done = dedup(packed, min_lines, text_col=text_col, keep=("_row",), min_words=min_words)
    left = done.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    columns = [F.col("kept").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in names]
    if "n_chars" in names:
        columns[names.index("n_chars")] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return left.select(*columns)
