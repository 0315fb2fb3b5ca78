"""Best-fit packing of token pieces by a configuration linear program.

Only the histogram of piece lengths reaches the driver, at most ``capacity``
counts whatever the corpus. There a covering program over configurations
(multisets of lengths that fit one sequence) is solved by multiplicative weights:
each round a knapsack dynamic program prices configurations under the current
weights, and weights of lengths that they cover shrink. The fractional uses are
rounded and what rounding leaves is solved again; best fit places the last
percent. The plan says which ranks of each length go to which sequence and
offset; ranks are given to pieces without gathering a length anywhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import _kernel, _shared

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"
#: Words, and parts of words, whose ids a generation of a Python worker's memory holds. A worker keeps up to two generations of
#: both, some 200 bytes each, and is used again by later stages; where there are any, ``cache_words`` can be less.
CACHE_WORDS = 1 << 19
# The vocabulary's pattern, for lower-cased ASCII.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_TOKENIZERS: dict[str, tuple] = {}


# --- tokens ---------------------------------------------------------------


def _tokenizer(path: str) -> tuple:
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _TOKENIZERS[path] = made, _Generations(), _Generations()
    return _TOKENIZERS[path]


class _Generations(dict):
    """Remembered ids in two generations: what is asked for again outlives the next clearing, so frequent words stay."""

    def __init__(self) -> None:
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        self[key] = found = self.older[key]
        return found

    def unknown(self, keys: Iterable[str]) -> list[str]:
        older = self.older
        return [k for k in keys if k not in self and k not in older]

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.older = dict(self)
            self.clear()


def _parts(word: str) -> list[str]:
    """Pieces of a word that the pre-tokenizer separates anyway, so their ids follow one another.

    ASCII words are cut as the vocabulary's pattern cuts them, and folded as it folds
    them; of others only stops at the end are cut off.
    """
    if word.isascii() and word.isprintable():
        return _PIECES.findall(word.lower())
    core = word.rstrip(".,;:!?")
    return [core, word[len(core) :]] if core != word and core.lower().isalpha() else [word]


def _learn(parts: list[str], tokenizer, known: dict[str, bytes]) -> None:
    """Encode parts as one text; the tokens' places in it say whose they are."""
    code = tokenizer.encode(" ".join(parts), add_special_tokens=False)
    begins = np.zeros(len(parts), dtype=np.int64)
    np.cumsum([len(w) + 1 for w in parts[:-1]], out=begins[1:])
    places = np.fromiter((a for a, _ in code.offsets), dtype=np.int64, count=len(code.ids))
    cuts = (4 * np.searchsorted(places, np.r_[begins, begins[-1] + len(parts[-1]) + 1])).tolist()
    data = np.asarray(code.ids, dtype="<u4").tobytes()
    known.update(zip(parts, map(data.__getitem__, map(slice, cuts[:-1], cuts[1:]))))


def word_ids(texts: pa.Array, path: str, cache_words: int | None = None) -> Iterator[bytes]:
    """Token ids of each text (none null) as little-endian 32-bit words.

    This vocabulary's pre-tokenizer ends every token at a space or newline, and
    between letters, digits and other signs, so the ids of each distinct word
    are put together once from those of its distinct parts; the texts' ids are
    then gathered by word numbers.
    """
    tokenizer, words_known, parts_known = _tokenizer(path)
    words_known.turn(cache_words or CACHE_WORDS)
    parts_known.turn(cache_words or CACHE_WORDS)
    split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    fresh = words_known.unknown(words)
    cut = list(map(_parts, fresh))
    new = parts_known.unknown(set().union(*cut))
    for at in range(0, len(new), 512):
        _learn(new[at : at + 512], tokenizer, parts_known)
    words_known.update((w, parts_known[p[0]] if len(p) == 1 else b"".join(map(parts_known.__getitem__, p))) for w, p in zip(fresh, cut))
    ids = list(map(words_known.__getitem__, words))
    table = np.frombuffer(b"".join(ids), dtype="<u4")
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    code = coded.indices.to_numpy(zero_copy_only=False)
    n = sizes[code]
    ends = np.r_[0, np.cumsum(n)]
    begins = (np.cumsum(sizes) - sizes)[code] - ends[:-1]
    out = table[np.repeat(begins, n) + np.arange(ends[-1])].tobytes()
    rows = np.r_[0, np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]
    cuts = (4 * ends[rows]).tolist()
    yield from map(out.__getitem__, map(slice, cuts[:-1], cuts[1:]))


def _cutter(path: str, capacity: int, end_id: int, cache_words: int | None = None):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for whole in batches:
            for batch in _kernel.text_slices(whole, "text", 2 << 20):
                rows = []
                texts = batch.column("text").fill_null("")
                for doc, ids in zip(batch.column("doc_id").to_pylist(), word_ids(texts, path, cache_words)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        length = len(cut) // 4
                        rows.append((doc, k, at // 4, length, zlib.crc32(cut), part, seen[length]))
                        seen[length] += 1
                names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_words: int | None = None) -> DataFrame:
    """The pieces of all documents; ``rank`` counts a length's pieces within the task ``part``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_cutter(tokenizer_path, capacity, end_id, cache_words), PIECE_SCHEMA)


# --- the configuration program --------------------------------------------


class Prices:
    """A knapsack dynamic programme over the current prices: the best filling of every room up to ``capacity``."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int):
        #: (length's place, times) of the items; a multiplicity is split in powers of two.
        self.items: list[tuple[int, int]] = []
        for i in np.flatnonzero((values > 0) & (most > 0)).tolist():
            left, k = int(min(most[i], capacity // lengths[i])), 1
            while left > 0:
                self.items.append((i, min(k, left)))
                left -= k
                k *= 2
        self.lengths, self.values = lengths, values
        self.best = best = np.zeros(capacity + 1)
        took = np.zeros((len(self.items) + 1, capacity + 1), dtype=bool)
        for j, (i, times) in enumerate(self.items):
            size = int(lengths[i]) * times
            other = best[: capacity + 1 - size] + values[i] * times
            np.greater(other, best[size:], out=took[j + 1, size:])
            np.maximum(other, best[size:], out=best[size:])
        #: For each room and item, the last item up to it that its best filling takes; 0 for none.
        steps = np.arange(len(self.items) + 1, dtype=np.int16 if len(self.items) < 1 << 15 else np.int32)[:, None]
        self.last = took * steps
        np.maximum.accumulate(self.last, axis=0, out=self.last)

    def fill(self, room: int) -> dict[int, int]:
        """The best filling of a room as {length's place: times}."""
        found: dict[int, int] = {}
        j = len(self.items)
        while j and (j := int(self.last[j, room])):
            i, times = self.items[j - 1]
            found[i] = found.get(i, 0) + times
            room -= int(self.lengths[i]) * times
            j -= 1
        return found


Config = tuple[tuple[int, int], ...]


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, eta: float = 0.04, share: float = 0.5, slack: float = 0.002) -> dict[Config, float]:
    """Configurations ((length's place, times), ...) and their fractional uses, by multiplicative weights.

    The covering program asks for the least total use under which every length is
    covered as often as it occurs. A round prices fillings under the current
    weights; for each length it takes the best configuration that holds it, and
    those within ``slack`` of the best of all are used, each for a ``share`` of what
    its scarcest length still lacks. A length's weight falls with the part of
    it that has been covered, so configurations turn to what is left. The sum of
    the steps is the average of the rounds' answers, scaled to cover.
    """
    rest = counts.astype(np.float64)
    weights = np.ones(len(lengths))
    uses: dict[Config, float] = {}
    for _ in range(rounds):
        lacking = rest > 0.02 * counts
        if not lacking.any():
            break
        values = weights * lengths
        prices = Prices(np.where(lacking, values, 0.0), lengths, counts, capacity)
        columns = []
        for i in np.flatnonzero(lacking)[::-1].tolist():
            held = prices.fill(capacity - int(lengths[i]))
            held[i] = min(held.get(i, 0) + 1, int(counts[i]))
            columns.append((sum(k * values[j] for j, k in held.items()), held))
        least = (1 - slack) * max(value for value, _ in columns)
        before = rest.copy()
        for value, held in columns:
            step = share * min(rest[j] / k for j, k in held.items()) if value >= least else 0.0
            if step > 0:
                config = tuple(sorted(held.items()))
                uses[config] = uses.get(config, 0.0) + step
                for j, k in config:
                    rest[j] = max(0.0, rest[j] - k * step)
        weights *= np.exp(-eta * (before - rest) / counts)
    return uses


def rounded(uses: dict[Config, float], rest: np.ndarray) -> list[tuple[int, Config]]:
    """Whole uses of the configurations, taken off ``rest``: first the whole parts, then one more by the largest remainders while pieces last."""
    taken: dict[Config, int] = {}

    def take(config: Config, wanted: int) -> None:
        n = min(wanted, *(int(rest[j]) // k for j, k in config))
        if n > 0:
            taken[config] = taken.get(config, 0) + n
            for j, k in config:
                rest[j] -= n * k

    for config, x in sorted(uses.items(), key=lambda u: -u[1]):
        take(config, int(x))
    for config, x in sorted(uses.items(), key=lambda u: -(u[1] % 1)):
        take(config, 1)
    return [(n, config) for config, n in taken.items()]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram (counts[length]): (sequences, [(length, times)]) rows."""
    kinds: list[tuple[int, list[tuple[int, int]]]] = []
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fits = [r for r in room if r >= length]
            if fits:
                r = min(fits)
                n, held = room[r].pop()
                if not room[r]:
                    del room[r]
            else:
                r, held = capacity, []
                n = -(-left // (capacity // length))
            times = r // length
            full = min(n, left // times)
            if full:
                room.setdefault(r - full // full * times * length, []).append((full, held + [(length, times)]))
                left -= full * times
            if n - full and left and left < times:
                room.setdefault(r - left * length, []).append((1, held + [(length, left)]))
                full, left = full + 1, 0
            if n > full and held:
                room.setdefault(r, []).append((n - full, held))
    for some in room.values():
        kinds.extend(some)
    return kinds


def program(counts: np.ndarray, capacity: int, rounds: int = 12, passes: int = 20, enough: float = 0.01) -> tuple[list[tuple[int, list[tuple[int, int]]]], np.ndarray]:
    """Rows (sequences, [(length, times)]) from rounded configurations, and the counts that they leave over.

    What rounding leaves is a program of the same kind, which is solved and
    rounded again until less than ``enough`` of the tokens are left.
    """
    lengths = np.flatnonzero(counts)
    rest = counts[lengths].copy()
    out: list[tuple[int, list[tuple[int, int]]]] = []
    for _ in range(passes):
        some = np.flatnonzero(rest)
        if int(rest @ lengths) <= enough * int(counts[lengths] @ lengths) or not len(some):
            break
        left = rest[some]
        made = rounded(solve(lengths[some], left, capacity, rounds), left)
        rest[some] = left
        out += [(n, [(int(lengths[some[j]]), k) for j, k in config]) for n, config in made]
        if not made:
            break
    over = np.zeros_like(counts)
    over[lengths] = rest
    return out, over


def plan(histogram: dict[int, int], capacity: int, rounds: int = 12) -> list[tuple[int, list[tuple[int, int]]]]:
    """Rows (sequences, [(length, times)]) that hold every piece exactly once: full pieces, the program's configurations, and best fit for its few leftovers."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if counts[capacity]:
        out.append((int(counts[capacity]), [(capacity, 1)]))
        counts[capacity] = 0
    made, over = program(counts, capacity, rounds)
    return out + made + best_fit(over, capacity)


def place_table(rows: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Ranges of ranks of each length, sorted by (length, from): where their sequences and offsets start."""
    used: dict[int, int] = {}
    table = []
    sequence = 0
    for n, config in rows:
        offset = 0
        for length, times in config:
            begin = used.get(length, 0)
            table.append((length, begin, sequence, times, offset))
            used[length] = begin + n * times
            offset += length * times
        sequence += n
    table.sort()
    columns = np.array(table, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "begin", "sequence", "times", "offset"), columns))


def _placer(table: dict[str, np.ndarray]):
    exact = table["length"] * (1 << 40) + table["begin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(exact, length * (1 << 40) + rank, side="right") - 1
            nth = rank - table["begin"][at]
            sequence = table["sequence"][at] + nth // table["times"][at]
            offset = table["offset"][at] + nth % table["times"][at] * length
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text", cache_words: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with ``end_id``; null and empty texts are that id alone.
    Documents longer than ``capacity`` are cut into pieces of it, the last may be
    shorter. Repeated ids and rows are documents of their own, a null id stays null.
    Sequences are numbered without gaps and filled from offset 0. Pieces are
    written to the shared folder before they are ranked, so a lost executor can't
    renumber them.
    """
    made = _shared.materialize(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, cache_words), "pieces")
    counted = _shared.materialize(made.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = place_table(plan(histogram, capacity, rounds))
    before = counted.selectExpr("length", "part", "coalesce(sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    # The table of offsets grows with the number of tasks, so it is not broadcast.
    ranked = made.join(before.hint("merge"), ["length", "part"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placer(table), schema)
