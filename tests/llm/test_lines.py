import random
import re

import corpus_pipeline
from lexforge.llm import lines


def plain(rows, size):
    docs = []
    for i, t, _ in rows:
        all_lines = (t or "").split("\n")
        docs.append((-1 if i is None else i, i, t, all_lines, [k for k, x in enumerate(all_lines) if re.search(r"[^\x20\x09-\x0D]", x)]))
    first = {}
    for rank, _, _, x, c in docs:
        for s in range(len(c) - size + 1):
            key = tuple(x[k] for k in c[s : s + size])
            first[key] = min(first.get(key, (rank, s)), (rank, s))
    out = []
    for rank, i, t, x, c in docs:
        gone = set()
        for s in range(len(c) - size + 1):
            if first[tuple(x[k] for k in c[s : s + size])] != (rank, s):
                gone |= set(c[s : s + size])
        out.append((i, len(c), len(gone), "\n".join(v for k, v in enumerate(x) if k not in gone) if gone else t))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        rows.append((i, "\n".join(rng.choices(["a", "b", "c", "", " ", f"own {i}", "d e"], k=rng.randint(0, 12))), "x"))
    rows += [(100 + i, rows[i][1], "x") for i in range(10)] + [(200, None, "x"), (201, "", "x"), (202, "a\n" * 300, "x"), (None, rows[3][1], "x"), (5, rows[5][1], "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, later string")
    for size in (1, 2, 3, 5):
        got = sorted((tuple(r) for r in lines.dedup(df, size).collect()), key=str)
        assert got == plain(rows, size), size


def test_rows_that_share_an_id_lose_only_their_own_copies(spark):
    """Null and repeated ids, equal numbers of lines, whole rows repeated."""
    three = [(1, "a\nb\nc", "x"), (2, "a\nb\nc\nx\ny", "x"), (2, "p\nq\nr\ns\nt", "x")]
    rng = random.Random(8)
    many = [(rng.choice([None, None, 1, 2]), "\n".join(rng.choices("abcdefgh", k=rng.choice([4, 4, 5]))), "x") for _ in range(120)]
    for rows in (three, many + many[:30], [(None, "u\nv\nw\nz", "x")] * 50 + [(None, "k\nl\nm\nn", "x"), (3, "u\nv\nw", "x")]):
        df = spark.createDataFrame(rows, "doc_id long, text string, later string")
        assert sorted((tuple(r) for r in lines.dedup(df, 3).collect()), key=str) == plain(rows, 3)
    df = spark.createDataFrame([(None, "u\nv\nw\nz", "x")] * 50, "doc_id long, text string, later string")
    assert lines.suffixes(df).count() == 4


def test_documents_keep_their_columns(spark):
    rows = [(1, "a\nb\nc\nmine", "en", 10), (2, "a\nb\nc", "en", 5), (3, "a\nb\nc\n\nother", "fr", 12), (4, None, "fr", None), (5, "", "fr", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, n_chars int")
    got = lines.dedup_documents(df, 3)
    assert got.schema == df.schema
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], (3, "\nother", "fr", 6), rows[3], rows[4]]


def test_empty_table(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_words(rows, size, words):
    """The text of every row without later copies of runs of ``size`` lines or of ``words`` words."""
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    content = [[k for k, x in enumerate(ls) if x.split()] for _, ls in docs]
    gone = [set() for _ in docs]
    for length in range(1, size + 1):
        first = {}
        runs = []
        for d, (i, ls) in enumerate(docs):
            for s in range(len(content[d]) - length + 1):
                run = tuple(ls[k] for k in content[d][s : s + length])
                if length == size or sum(len(x.split()) for x in run) >= words:
                    first[run] = min(first.get(run, (i, s)), (i, s))
                    runs.append((d, (i, s), run))
        for d, at, run in runs:
            if at > first[run]:
                gone[d] |= set(content[d][at[1] : at[1] + length])
    return sorted((i, len(g), "\n".join(x for k, x in enumerate(ls) if k not in g) if g else t) for (i, t), (_, ls), g in zip(rows, docs, gone))


def test_short_runs_of_many_words(spark):
    rng = random.Random(6)
    say = lambda n: (" " if n % 2 else " \t").join(rng.choices(["a", "bc", "d"], k=n))
    pool = [say(n) for n in (60, 50, 49, 30, 25, 24, 20, 3, 1)] + ["", " "]
    rows = [(i, "\n".join([f"own {i}", *rng.choices(pool, k=rng.randint(0, 4)), f"end {i}"])) for i in range(60)]
    rows += [(100, pool[0]), (101, pool[2]), (102, pool[3] + "\n\n" + pool[4]), (103, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (3, 4):
        got = sorted((r.doc_id, r.n_removed, r.kept) for r in lines.dedup(df, size, min_words=50).collect())
        assert got == plain_words(rows, size, 50), size


def test_the_pipeline_deletes_a_long_passage_of_one_or_two_lines(spark):
    one, two = " ".join(f"w{k}" for k in range(64)), "\n".join(" ".join(f"{c}{k}" for k in range(30)) for c in "xy")
    rows = [(1, one + "\nmine"), (2, "here\n" + one), (3, two), (4, two + "\nthere"), (5, "short one\nfive"), (6, "short one\nsix")]
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(tuple(r) for r in got) == [rows[0], (2, "here"), rows[2], (4, "there"), *rows[4:]]


def test_the_halves_of_a_line_name_do_not_follow_from_each_other(spark):
    df = spark.createDataFrame([(1, "one line\nanother"), (2, "third")], "doc_id long, text string")
    rows = lines.suffixes(df).selectExpr("b", "xxhash64('one line') = a AS one", "xxhash64('one line', 1) AS chained").filter("one").collect()
    assert len(rows) == 1 and rows[0].b != rows[0].chained
