import random

import corpus_pipeline
from lexforge.llm import decontaminate, quality
from tests.llm import test_decontaminate, test_lines, test_packing, test_simhash


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, say(25) + ". " + say(10)) for k in range(5)]
    texts = ["\n".join(say(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += texts[:6] + [texts[7] + "\n" + say(12), None, "", "too short", "spam " * 40, say(40) + " idiot", say(30) + " " + items[2][1]]
    texts += ["\n".join(texts[9].split("\n")[:1]) + " " + say(30) for _ in range(2)]
    docs = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s0", len(texts[3]))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = quality.filter_documents(spark.createDataFrame([(i, t) for i, t, *_ in docs], "doc_id long, text string")).collect()
    rows = [(r.doc_id, r.text, None) for r in kept]
    left = [(i, kept_text) for i, n, removed, kept_text in test_lines.plain(rows, 3) if removed == 0 or removed < n]
    left.sort(key=lambda x: x[0])
    prints = [test_simhash.plain_print(t, 5) for _, t in left]
    component = test_simhash.plain_components(prints)
    seen, single = set(), []
    for k, (i, t) in enumerate(left):
        if left[component[k]][0] == i and i not in seen:
            seen.add(i)
            single.append((i, t))
    index = test_decontaminate.built(items)
    clean = []
    for i, t in single:
        w = decontaminate.words_of(t)
        if not any(all(decontaminate.overlap(p, w) >= 0.7 for p in parts) for parts in index.parts):
            clean.append((i, t))
    want = sorted((i, len(test_packing.plain_ids(t))) for i, t in clean)
    assert sorted((r.doc_id, r.length) for r in got) == want and 40 < len(want) < 70
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 for p in places.values())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, later int"


def stages(spark, docs, folder):
    """Rows after each stage, by (doc_id, text)."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")], name
            docs = spark.createDataFrame(rows, SCHEMA)
        out.append(rows)
    return out


def test_odd_rows_keep_their_documents(spark, tmp_path):
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item = say(25) + ". " + say(10)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {k: say(60) for k in "abcdefg"} | {"long": say(40000), "leak": say(30) + " " + item + " " + say(30)}
    near = texts["e"].split()
    near[30] = "changed"
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["leak"]), (5, texts["c"]), (5, texts["d"]), (6, texts["e"]), (None, " ".join(near)), (7, texts["f"]), (7, texts["f"]), (8, None), (9, ""), (10, texts["long"]), (11, texts["leak"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 3) for i, t in rows], SCHEMA)
    quality_left, lines_left, near_left, clean_left, packed = stages(spark, docs, str(tmp_path))
    # The leak's second copy is a repeated line of over 50 words; rows with one id stand at one place and keep theirs.
    assert len(quality_left) == 11 and len(lines_left) == 10 and 11 not in {r.doc_id for r in lines_left}
    kept = sorted(((r.doc_id, r.text) for r in near_left), key=str)
    assert kept == sorted([(None, texts["a"]), (None, texts["b"]), (5, texts["c"]), (5, texts["d"]), (6, texts["e"]), (7, texts["f"]), (10, texts["long"]), (None, texts["leak"])], key=str)
    assert sorted(((r.doc_id, r.text) for r in clean_left), key=str) == [x for x in kept if x[1] != texts["leak"]]
    assert sorted({r.doc_id for r in packed}, key=str) == [10, 5, 6, 7, None]
    assert sum(r.length for r in packed) == sum(len(test_packing.plain_ids(r.text)) for r in clean_left)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [len(x) for x in stages(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))] == [0] * 5
