import random
import re

import numpy as np
import pytest
import xxhash

from lexforge.llm import simhash

U64 = np.uint64


def plain_print(text, size=3):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = list(range(len(prints)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                ids[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_operator_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["Wort%d" % i for i in range(60)] + ["É", "x y"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 30, 900]))) for _ in range(40)]
    texts = base + [t.replace("Wort1 ", "wort1  ", 1) for t in base] + [t + " extra" for t in base[:10]]
    texts += [None, "", " \n\t", "a", "a", " ", base[0]]
    docs = spark.createDataFrame([(i, t, 1, "fp") for i, t in enumerate(texts)], "doc_id long, text string, fp int, component_id string")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_print(t) for t in texts]
    want = plain_components(prints)
    assert got == {i: (prints[i], want[i]) for i in range(len(texts))}


@pytest.mark.parametrize("n", [2, 64, 65, 300])
def test_bucket_links_span_the_groups(n):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 63, size=max(2, n // 6), dtype=np.int64).astype(U64)
    fps = np.unique(np.concatenate([fps] + [fps ^ (U64(1) << rng.integers(0, 64, len(fps)).astype(U64)) for _ in range(5)]))[:n]
    rng.shuffle(fps)
    a, b = simhash.bucket_links(np.zeros((len(fps), 2), dtype=np.int64), fps, 2)
    assert all((int(x) ^ int(y)) != 0 for x, y in zip(a, b))
    place = {int(f): i for i, f in enumerate(fps)}
    want = plain_components([int(f) for f in fps])
    ids = list(range(len(fps)))
    for x, y in zip(a, b):
        old, new = ids[place[int(y)]], ids[place[int(x)]]
        ids = [new if k == old else k for k in ids]
    assert len(set(ids)) == len(set(want))
    assert len({(i, w) for i, w in zip(ids, want)}) == len(set(want))


def test_empty_table_nulls_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "one two three four"), (5, "one two three four"), (5, "one two three four"), (7, None)]
    got = sorted(tuple(r)[::2] for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect() if r.doc_id)
    assert got == [(5, 5), (5, 5), (7, 7)]
