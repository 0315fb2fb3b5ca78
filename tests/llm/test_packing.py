import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexforge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


HARD = ["a b  c\td\r\n", "don't 's x", "é é ́x", "Σίσυφος ΟΔΟΣ", "<|endoftext|> a<|startoftext|>", "\x1c a\x1cb", " \n ", "a\x85b\xa0c", "𝄞ñ", "", "x" * 500, "İ. ÉTÉ., l'École; don'T ((' 's4s ''t"]


def test_word_ids_of_random_texts_and_small_memory(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    rng = random.Random(3)
    signs = ["a", "B", "s", "'", "t", "é", "\u0301", "İ", "0", "٣", ".", ",", "'ll", "\t", "\x1c", "\x85", "\u00a0", "\n", " ", " ", "한", "ᄒ", "ᅡ", "_", "ſ", "Σ", "ς", "\x00"]
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    for _ in range(40):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(100)]
        got = [np.frombuffer(b, dtype="<u4").tolist() for b in packing.word_ids(pa.array(texts), PATH)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_what_a_worker_remembers_is_small(monkeypatch):
    """Workers go on to other stages with it: of 600,000 distinct words fewer than 300,000 stay."""
    monkeypatch.setattr(packing, "_TOKENIZERS", {})
    for at in range(0, 600_000, 20_000):
        for _ in packing.word_ids(pa.array([" ".join(f"w{k}" for k in range(at, at + 20_000))]), PATH, corpus_pipeline.CACHE_WORDS):
            pass
    words = packing._TOKENIZERS[PATH][1]
    assert len(words) + len(words.older) < 300_000


def test_word_ids_are_the_texts_ids():
    got = [np.frombuffer(b, dtype="<u4").tolist() + [0] for b in packing.word_ids(pa.array(HARD), PATH)]
    assert got == [plain_ids(t) for t in HARD]


def test_pack_against_the_contract(spark):
    rng = random.Random(2)
    texts = HARD + [None] + [" ".join(rng.choices(["alpha", "beta7", "Gam,ma", "x"], k=rng.choice([1, 5, 40, 300]))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "nobody", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    capacity = 64
    got = packing.pack(docs, PATH, capacity=capacity).collect()
    want = []
    for i, t, _ in rows:
        ids = plain_ids(t)
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want.append((i, k, at, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= 1.05 * (-(-sum(r.length for r in got) // capacity)) + 2


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = dict(zip(range(1, 101), rng.integers(0, [1, 30, 3000, 3, 200][seed] + 1, 100).tolist()))
    rows = packing.plan(counts, 100)
    held = {}
    for n, config in rows:
        assert n > 0 and sum(length * k for length, k in config) <= 100
        for length, k in config:
            held[length] = held.get(length, 0) + n * k
    assert held == {length: n for length, n in counts.items() if n}


def shares(counts, capacity):
    """Sequences from rounded configurations, from best fit, and the lower bound."""
    made, over = packing.program(counts, capacity)
    return sum(n for n, _ in made), sum(n for n, _ in packing.best_fit(over, capacity)), -(-int(counts @ np.arange(len(counts))) // capacity)


def test_the_program_makes_nearly_all_sequences():
    lengths = []
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        n = len((text or "").split()) * 2 + 1
        lengths += [n % 2048] if n % 2048 else []
    program, rest, bound = shares(np.bincount(lengths, minlength=2049), 2048)
    assert program >= 0.95 * (program + rest)
    assert program + rest <= 1.01 * bound + 1


def test_the_program_has_no_way_past_pieces_over_half():
    counts = np.zeros(2049, dtype=np.int64)
    counts[1100:1500:7] = 5
    program, rest, _ = shares(counts, 2048)
    assert program + rest == counts.sum() and program >= 0.5 * counts.sum()


def test_exact_instance():
    counts = np.zeros(21, dtype=np.int64)
    counts[[6, 5, 3, 2]] = 20, 40, 60, 20
    program, rest, bound = shares(counts, 20)
    assert program + rest <= bound + 1 and program >= 0.9 * bound


def test_knapsack_against_brute_force():
    lengths, counts, values = np.array([3, 4, 7]), np.array([3, 2, 1]), np.array([3.0, 4.5, 7.2])
    prices = packing.Prices(values, lengths, counts, 13)
    for room in range(14):
        best = max(a * 3 + b * 4.5 + c * 7.2 for a in range(4) for b in range(3) for c in range(2) if 3 * a + 4 * b + 7 * c <= room)
        held = prices.fill(room)
        assert sum(k * values[j] for j, k in held.items()) == pytest.approx(best) == prices.best[room]
        assert sum(k * lengths[j] for j, k in held.items()) <= room and all(k <= counts[j] for j, k in held.items())


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
