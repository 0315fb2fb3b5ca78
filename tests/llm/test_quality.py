import random
import re

from lexforge.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measurements_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "a b c", "#$%&|<>", "x\ny\nx\n\n \nx"]
    texts += [" ".join(rng.choices(["a", "bb", "é", "D%"], k=rng.randint(4, 40))) for _ in range(40)]
    texts += ["\n".join(rng.choices(["l one", "l two", "", "\t"], k=9)) for _ in range(10)] + [" ".join(map(str, range(30000))) + " 0 1 2 3 4 5"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(df).collect()}
    long = len(texts) - 1
    assert got.pop(long)[4] == 10 + 2
    assert got == {i: plain(t) for i, t in enumerate(texts[:long])}


def test_policies_and_ablation(spark):
    good = "Plain words make a fine sentence that nobody would ever want to drop here."
    rows = [(1, good), (2, good + " You idiot."), (3, "short"), (4, None), (5, "short idiot ##"), (None, good), (1, good)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = quality.ledger(df)
    kept = [r.doc_id for r in quality.filter_documents(df).collect()]
    assert sorted(kept, key=str) == [1, 1, None] and quality.filter_documents(df).columns == df.columns
    both = quality.apply_policies(made, quality.DEFAULT, quality.BASE)
    assert {r.doc_id for r in both.filter("base_v1 AND NOT default_v1").collect()} == {2}
    table = {r.rule: (r.n_failed, r.n_only_this) for r in quality.ablation(made).collect()}
    assert table == {"blocked_words": (2, 1), "too_few_words": (3, 2), "symbols": (1, 0)}


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fail_bits string, _m int")
    assert quality.ledger(df).count() == 0
    one = spark.createDataFrame([(1, "word " * 3 + "some other words that stand here for length", "x", 2)], df.schema)
    assert [tuple(r) for r in quality.filter_documents(one).collect()] == [tuple(one.first())]
