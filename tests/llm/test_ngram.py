import math
import random
import re
from collections import Counter

import pytest

from lexforge.llm import ngram


def plain(rows, alpha=0.4, least=2):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    words = Counter(w for _, x in docs for w in x)
    pairs = Counter(p for _, x in docs for p in zip([None, *x], x))
    n, full = sum(words.values()), sum(1 for _, x in docs if x)
    out = {}
    for i, x in docs:
        score = 0.0
        for v, w in zip([None, *x], x):
            base = full if v is None else words[v]
            score += math.log(pairs[v, w] / base) if pairs[v, w] >= least else math.log(alpha * words[w] / n)
        have = out.get(i, (0, 0.0))
        out[i] = (have[0] + len(x), have[1] + score)
    return out


@pytest.mark.parametrize("heavy,entries", [(1 << 15, 1 << 21), (4, 500), (40, 100)])
def test_scores_against_brute_force(spark, monkeypatch, heavy, entries):
    monkeypatch.setattr(ngram, "HEAVY", heavy)
    monkeypatch.setattr(ngram, "BUCKET_ENTRIES", entries)
    rng = random.Random(heavy)
    vocabulary = [f"v{int(rng.paretovariate(0.8))}" for _ in range(3000)] + ["the"] * 800
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "\t\n"), (303, "the " * 500), (None, rows[3][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = {r.doc_id: (r.n_tokens, r.score) for r in ngram.scores(df).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, (n, score) in want.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(score, abs=1e-6), i


def test_empty_table(spark):
    assert ngram.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
