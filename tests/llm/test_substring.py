import random
import re

from lexforge.llm import substring


def plain(rows, size):
    docs = [(-1 if i is None else i, i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for rank, _, words in docs:
        for s in range(len(words) - size + 1):
            key = tuple(words[s : s + size])
            first[key] = min(first.get(key, (rank, s)), (rank, s))
    out = []
    for rank, i, words in docs:
        gone = set()
        for s in range(len(words) - size + 1):
            if first[tuple(words[s : s + size])] != (rank, s):
                gone |= set(range(s, s + size))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def check(spark, rows, size):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hits string")
    assert sorted((tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in substring.dedup(df, size).collect()), key=str) == plain(rows, size)


def test_against_brute_force(spark):
    rng = random.Random(7)
    passages = [" ".join(f"p{k}w{j}" for j in range(rng.randint(15, 60))) for k in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 30)))]
        parts += [rng.choice(passages) for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        rows.append((i, "  ".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, None), (301, ""), (302, " \n"), (303, "of " * 200), (304, "x y " * 50)]
    rows += [(None, passages[0]), (1, rows[1][1]), (305, passages[1] + "\n" + passages[1])]
    rng.shuffle(rows)
    check(spark, rows, 20)


def test_rows_that_share_an_id_lose_only_their_own_copies(spark):
    """Null and repeated ids, equal numbers of words, whole rows repeated."""
    w = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    check(spark, [(1, w("a", 25)), (2, w("a", 25) + " " + w("b", 15)), (2, w("c", 40))], 20)
    rng = random.Random(6)
    parts = [w(f"p{k}x", 25) for k in range(6)]
    many = [(rng.choice([None, None, 1, 2]), " ".join(rng.sample(parts, 2) if rng.random() < 0.5 else [w(f"own{k}x", 50)])) for k in range(80)]
    check(spark, many + many[:20] + [(None, parts[0])] * 30, 20)


def test_many_buckets_and_batches(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_ENTRIES", 200)
    monkeypatch.setattr(substring, "BATCH_BYTES", 2000)
    rng = random.Random(9)
    passages = [" ".join(f"q{k}w{j}" for j in range(30)) for k in range(4)]
    rows = [(i, " ".join(rng.choices("abcdefghij", k=30)) + " " + rng.choice(passages) + " tail" * (i % 3)) for i in range(80)]
    rows += [(90, " ".join(f"n{k}" for k in range(30000)) + " " + passages[0]), (91, " ".join(f"n{k}" for k in range(15000, 30000)))]
    check(spark, rows, 20)


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rest = " ".join(f"w{k}" for k in range(19))
    check(spark, [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], 20)


def test_small_alphabet(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(1, 40)))) for i in range(60)]
    check(spark, rows, 4)
    check(spark, rows, 8)


def test_empty_table(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
