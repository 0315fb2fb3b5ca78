"""Files per trace, validation splits, freshness of derived columns and real token ids."""

import os

import pytest
from pyspark.sql import functions as F

from lexforge.functions import render, tokens
from lexforge.operators import checks, splits, traces


def tree(path):
    out = {}
    for at, _, names in os.walk(path):
        for n in names:
            if not n.startswith((".", "_")):
                with open(f"{at}/{n}") as f:
                    out[os.path.relpath(f"{at}/{n}", path)] = f.read()
    return out


def test_one_file_for_each_trace(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"id {k}", "Text: Cipher" if k % 2 else None, "m", f"line {k}\nnext, with a\ttab  ", "") for k in range(12)] + [("é=%/x", "B", "m", " only one line\n\n", "")]
    made = traces.records(spark.createDataFrame(rows, "id string, category string, source_mode string, generated_cot string, assistant_content string")).withColumn("path", F.replace("path", F.lit("/x.txt"), F.lit("-x.txt")))
    n, left = traces.write_files(made, out)
    want = {r.path: r.text for r in made.collect()}
    assert n == 13 and tree(out) == want and left.count() == 0
    assert {"text_cipher/id 1.txt", "unknown/id 0.txt"} <= set(want) and want["b/é=%-x.txt"] == "only one line\n"
    stamps = {p: os.stat(f"{out}/{p}").st_mtime_ns for p in want}
    assert traces.write_files(made, out)[0] == 0 and {p: os.stat(f"{out}/{p}").st_mtime_ns for p in want} == stamps

    os.remove(f"{out}/unknown/id 0.txt")
    os.remove(f"{out}/text_cipher/.id 1.txt.crc")
    with open(f"{out}/text_cipher/id 1.txt", "w") as f:
        f.write("another\n")
    os.makedirs(f"{out}/_staging-old/files/_name=half")
    n, left = traces.write_files(made, out)
    assert n == 1 and [r.path for r in left.collect()] == ["text_cipher/id 1.txt"] and tree(out)["text_cipher/id 1.txt"] == "another\n"
    assert traces.write_files(made, out, overwrite=True)[0] == 1 and tree(out) == want
    assert [x for x in os.listdir(out) if x.startswith("_")] == []


def test_a_failed_task_leaves_no_half_file(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([("a/1.txt", "one\n"), ("a/2.txt", "two\n")], "path string, text string").repartition(2)
    broken = good.withColumn("text", F.when(F.col("path") == "a/2.txt", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        traces.write_files(broken, out)
    assert tree(out) == {}
    assert traces.write_files(good, out)[0] == 2 and tree(out) == {"a/1.txt": "one\n", "a/2.txt": "two\n"}


def test_validation_split_has_two_sides(spark):
    rows = spark.createDataFrame([(str(k), "ab"[k % 2]) for k in range(20)], "id string, kind string")
    train, val = splits.train_and_val(rows, "kind", 0.2)
    assert (train.count(), val.count()) == (16, 4) and train.columns == rows.columns
    assert splits.train_and_val(rows, "kind", 0)[1].count() == 0
    for bad in (1.0, -0.1):
        with pytest.raises(ValueError, match="fraction"):
            splits.train_and_val(rows, "kind", bad)
    with pytest.raises(ValueError, match="empty"):
        splits.train_and_val(rows.limit(1), "kind", 0.2)


def test_a_stale_derived_column_is_told_besides_the_first_difference(spark):
    kind = "id string, a string, b string, subtype string"
    source = spark.createDataFrame([("1", "x", "y", "s"), ("2", "x", "y", "s"), ("3", "x", None, "s"), ("4", "x", "y", "s")], kind)
    stored = spark.createDataFrame([("1", "z", "q", "t"), ("2", "x", "y", "t"), ("3", "x", "", "s"), ("5", "x", "y", "s")], kind)
    got = sorted(tuple(r) for r in checks.differences(source, stored, "id", ["a", "b"], derived=("subtype",)).collect())
    assert got == [("1", "differs: a"), ("1", "differs: subtype"), ("2", "differs: subtype"), ("4", "missing"), ("5", "extra")]


def test_masks_over_real_token_ids(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    read = Tokenizer.from_file(path)
    enc = lambda t: read.encode(t or "", add_special_tokens=False).ids
    rows = [("Solve this: 1 + 1", " The answer is \\boxed{2}"), ("", "é\n\n x"), (None, "y"), ("p", None), ("long " * 500, "text " * 800)]
    df = spark.createDataFrame(rows, "p string, c string")
    got = df.select("*", render.masked_example(F.col("p"), F.col("c"), tokens.tokenizer(path)).alias("m")).collect()
    for r in got:
        head, tail = enc(r.p), enc(r.c)
        assert r.m.input_ids == head + tail and r.m.labels == [-100] * len(head) + tail and (r.m.n_prompt, r.m.n_completion) == (len(head), len(tail))
