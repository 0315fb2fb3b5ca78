import math
import random
import re

import pytest

from lexforge.llm import decontaminate as d


def exhaustive(index, terms, threshold):
    score = {}
    for t in terms:
        for i, x in zip(*index.postings[t]):
            score[i] = score.get(i, 0.0) + x
    return {i for i, s in score.items() if s >= threshold - 1e-9}


def built(items, threshold=0.6):
    """An index of all items in one block, with frequencies counted here."""
    texts = [(i, t, d.words_of(t)) for i, t in items if t and d.words_of(t)]
    df = {}
    for _, _, words in texts:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    lengths = [len(w) for *_, w in texts]
    statistics = d.Statistics(len(texts), sum(lengths) / max(1, len(texts)), max(lengths, default=0))
    return d.build_index([(i, t, {w: df[w] for w in words}) for i, t, words in texts], statistics, threshold)


def bm25(items, words):
    """Scores of the items against a bag of words, each as a share of its score against itself, from the formula."""
    bags = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in items if t}
    bags = {i: b for i, b in bags.items() if b}
    mean = sum(map(len, bags.values())) / len(bags)
    out = {}
    for i, bag in bags.items():
        impact = {}
        for w in set(bag):
            n = sum(w in other for other in bags.values())
            tf = bag.count(w)
            impact[w] = math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))
        out[i] = sum(x for w, x in impact.items() if w in words) / sum(impact.values())
    return out


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.6, 0.9])
def test_block_max_wand_finds_all(threshold):
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(2000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 25)))) for i in range(150)]
    index = built(items, threshold)
    for k in range(200):
        words = d.words_of(rng.choice(items)[1])[: rng.randint(1, 25)] + d.words_of(" ".join(rng.choices(vocabulary, k=10)))
        terms = sorted({index.vocabulary[w] for w in words if w in index.vocabulary})
        got = d.block_max_wand(index, terms, threshold)
        assert {i for i, _ in got} == exhaustive(index, terms, threshold) and len(got) == len({i for i, _ in got})


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=20)) + ".\n" + " ".join(rng.choices(words, k=8)) + ".") for k in range(30)] + [(90, None), (91, ""), (92, "solo")]
    docs = []
    for i in range(150):
        text = " ".join(rng.choices(words, k=rng.randint(0, 200)))
        if i % 5 == 0:
            leak = items[i % 30][1]
            text += " " + (leak.upper() if i % 2 else leak.replace(".\n", " - ")) + " " + " ".join(rng.choices(words, k=rng.randint(0, 90)))
        elif i % 7 == 0:
            text += " " + " ".join(items[i % 30][1].split()[:12])
        docs.append((i, text, 0.5))
    docs += [(500, None, 0.0), (501, "", 0.0), (None, items[3][1], 0.0), (0, docs[0][1], 0.0)]
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(items, "item_id long, text string")).collect()
    index = built(items)
    want = []
    for i, text, _ in docs:
        w = d.words_of(text)
        size = 2 * index.longest
        for k, item in enumerate(index.ids):
            for s in range(0, max(1, len(w) - size // 2), size // 2):
                part = w[s : s + size]
                terms = {index.vocabulary[x] for x in part if x in index.vocabulary}
                if k in exhaustive(index, terms, 0.6) and all(d.overlap(p, part) >= 0.7 for p in index.parts[k]):
                    want.append((i, item))
                    break
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(want, key=str) and len(want) > 30
    left = d.drop_leaked(spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {i for i, _, _ in docs} - {i for i, _ in want}


def test_scores_do_not_depend_on_blocks_or_order(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(8, 25))) + ". " + " ".join(rng.choices(words, k=6))) for k in range(25)]
    docs = [(i, " ".join(rng.choices(words, k=10)) + " " + items[i % 25][1]) for i in range(50)] + [(60, " ".join(f"x{k}" for k in range(60000)) + " " + items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one = {(r.doc_id, r.item_id): r.score for r in d.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    monkeypatch.setattr(d, "INDEX_BYTES", 300)
    many = {(r.doc_id, r.item_id): r.score for r in d.leaks(frame, spark.createDataFrame(items[::-1], "item_id long, text string")).collect()}
    assert one == pytest.approx(many) and {(i, i % 25) for i in range(50)} | {(60, 3)} <= set(one)
    longest = max(len(d.words_of(t)) for _, t in items)
    for (i, k), score in one.items():
        text = d.words_of(docs[min(i, 50)][1])
        parts = [text[s : s + 2 * longest] for s in range(0, max(1, len(text) - longest), longest)]
        passing = [p for p in parts if all(d.overlap(x, p) >= 0.7 for x in d.question_and_answer(items[k][1]))]
        assert score == pytest.approx(max(bm25(items, {w.decode() for w in p})[k] for p in passing))


def test_one_changed_word_does_not_hide_an_item(spark):
    rng = random.Random(6)
    words = [f"term{k}" for k in range(900)]
    items = [(k, " ".join(rng.choices(words, k=20)) + ". " + " ".join(rng.choices(words, k=rng.randint(6, 12)))) for k in range(20)]
    docs = []
    for k, text in items:
        bare = text.split()
        bare[rng.randrange(5, 15)] = "changed"
        docs.append((k, " ".join(rng.choices(words, k=40) + bare + rng.choices(words, k=40))))
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(20)]


def test_overlap_by_hand():
    part = b"a b c d e f g h i j".split()
    assert d.overlap(part, part) == 1.0 and d.overlap(part, b"a b c x e f g".split()) == 0.6 and d.overlap(part, []) == 0.0
    assert d.overlap(b"p q".split(), b"q p".split()) == 0.0 and d.overlap(b"p".split(), b"x p".split()) == 1.0 and d.overlap([], part) == 0.0


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(docs, items).count() == 0 and d.leaks(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
