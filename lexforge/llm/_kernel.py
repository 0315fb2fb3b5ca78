"""NumPy text kernels for Arrow batches: word bounds, word hashes, packed blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: Keys of the word hashes and odd multipliers of the window hashes; two, for 128 bits where equality must hold.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds at most ``max_bytes`` of text, or a single row."""
    text = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    row = 0
    while row < len(text):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + max_bytes, side="right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    text = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def word_bounds(body: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each row's first word."""
    if not len(body):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(rows), dtype=np.int64)
    inside = ~_WS[body]
    cut = np.zeros(len(body) + 1, dtype=bool)
    cut[rows] = True
    before = np.empty(len(body), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(body), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word's bytes under a key, eight bytes a round, each round through the finaliser.

    A round is a bijection of its eight bytes, so words of up to eight bytes never
    collide with others of their length; two keys give two independent halves.
    """
    sizes = ends - starts
    padded = np.zeros(len(body) + 8, dtype=np.uint8)
    padded[: len(body)] = body
    eights = np.ndarray((len(body) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix(sizes.astype(U64) * U64(0x9FB21C651E98DF25) + U64(seed))
    at, live = starts, np.arange(len(starts))
    left = sizes
    while len(live):
        eight = eights[at] & _TAIL[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ eight) * U64(seed | 1))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes (across rows too; the caller masks those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = np.zeros(n, dtype=U64)
    for k in range(size):
        h *= U64(base)
        h += words[k : k + n]
    return mix(h)


_SQUEEZE: list = []


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a zstd blob of byte planes."""
    if not _SQUEEZE:
        _SQUEEZE.extend([zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()])
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in map(np.ascontiguousarray, arrays)]
    return _SQUEEZE[0].compress(b"".join(planes))


def unpack(blob: bytes, *dtypes: type) -> list[np.ndarray]:
    if not _SQUEEZE:
        _SQUEEZE.extend([zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()])
    raw = np.frombuffer(_SQUEEZE[1].decompress(blob), dtype=np.uint8)
    sizes = [np.dtype(d).itemsize for d in dtypes]
    n, at, out = len(raw) // sum(sizes), 0, []
    for d, size in zip(dtypes, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(d).reshape(n))
        at += n * size
    return out


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def places(column: pa.Array, first: np.ndarray) -> np.ndarray:
    """Word places, over all rows, of a column of lists of starts."""
    per_row = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return starts + np.repeat(first[: len(per_row)], per_row)
