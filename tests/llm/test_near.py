import random
import re

import numpy as np

import corpus_pipeline
from lexforge.llm import decontaminate, near

SCHEMA = "doc_id long, text string"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """One (doc_id, text) of each component of the pairs with Jaccard >= 0.8."""
    sets = [grams(t) for _, t in rows]
    ids = list(range(len(rows)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                a, b = root(i), root(j)
                ids[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    return groups.values()


def edited(rng, text, n):
    words = text.split(" ")
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


def test_near_copies_against_brute_force(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choices([f"w{k}" for k in range(400)], k=n))
    texts = [say(rng.choice([1, 4, 40, 120, 300])) for _ in range(60)]
    texts += [edited(rng, t, rng.randint(1, 4)) for t in texts if len(t.split(" ")) >= 120 for _ in range(3)]
    texts += [edited(rng, texts[-1], k % 9) for k in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n")]
    got = sorted(tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    want = sorted((min(g, key=lambda r: r[0]) for g in brute(rows)), key=lambda r: r[0])
    assert got == want and len(want) < len(rows) - 60


def test_rounds_connect_what_one_centre_does_not_reach(spark):
    # A chain: each node is near the next ones only, and all share one bucket.
    sets = [list(range(k, k + 20)) for k in range(0, 60)]
    classes = spark.createDataFrame([(i, [7]) for i in range(60)], "c long, bands array<long>")
    own = spark.createDataFrame(list(enumerate(sets)), "c long, shingles array<long>")
    roots = near.components(classes, lambda nodes: own.join(nodes, "c", "left_semi"), 0.8)
    assert sorted(tuple(r) for r in roots.collect()) == [(i, 0) for i in range(1, 60)]


def test_band_keys_follow_the_set_only():
    h = np.array([5, 3, 3, 9, 9, 5, 3], dtype=np.uint64)
    sets, counts = near.distinct_shingles(h, np.array([3, 0, 4]))
    assert counts.tolist() == [2, 0, 3] and sets.tolist() == [3, 5, 3, 5, 9]
    assert (near.band_keys(np.tile(sets[2:], 2), np.array([3, 3])) == near.band_keys(sets[2:], np.array([3]))).all()


def test_rows_without_an_id_or_with_a_shared_one_are_decided_by_their_texts(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choices([f"w{k}" for k in range(300)], k=n))
    alone, twin = [(None, say(30)) for _ in range(6)], say(40)
    rows = [*alone, alone[0], (1, twin), (2, twin), (2, say(50)), (None, twin), (3, say(20)), (3, say(20))]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    want = [*alone, rows[7], rows[9], rows[11], rows[12]]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_a_leak_takes_only_its_own_row(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choices([f"w{k}" for k in range(300)], k=n))
    items = spark.createDataFrame([(0, item := say(20) + ". " + say(8))], "item_id long, text string")
    rows = [(None, say(40)), (None, say(9) + " " + item), (None, None), (7, item), (7, say(30))]
    got = decontaminate.drop_leaked(spark.createDataFrame(rows, SCHEMA), items).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_simhash_links_are_compared_before_buckets(spark):
    # Fingerprints 0 and 1 bit apart link without a shared bucket; of linked nodes only similar ones are joined.
    rows = [(1, 0b1000, [10]), (2, 0b1000, [20]), (3, 0b1001, [30]), (4, 0b1010, [40]), (5, -1, [50]), (6, 0b1000, [])]
    sets = [(1, list(range(20))), (2, list(range(19))), (3, list(range(18))), (4, [77, 78]), (5, list(range(20)))]
    classes = spark.createDataFrame(rows, "c long, fp long, bands array<long>")
    own = spark.createDataFrame(sets, "c long, shingles array<long>")
    pairs = near.simhash_pairs(classes)
    roots = near.components(classes.select("c", "bands"), lambda nodes: own.join(nodes, "c", "left_semi"), 0.8, pairs)
    assert {x for r in pairs.collect() for x in r} == {1, 2, 3, 4}
    assert sorted(tuple(r) for r in roots.collect()) == [(2, 1), (3, 1)]
