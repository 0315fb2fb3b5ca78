import json

import pytest
from pyspark.sql import functions as F

from lexforge.functions import classify, render
from lexforge.operators import evaluate, prepare, splits, training, traces
from lexforge.solve import bit, numeric
from lexforge.sources import ingest, sinks


def test_evaluation_by_key_and_failure_files(spark, tmp_path):
    examples = spark.createDataFrame(
        [("b", "p1", "5", "Gravity", 1), ("a", "p2", "7", "Transformation Rules", 2), ("c", "p3", "x", "", 3), ("d", "p4", "1", "Gravity", 4)], "id string, prompt string, answer string, category string, line_no long"
    )
    predictions = spark.createDataFrame([("a", "\\boxed{8}"), ("b", "\\boxed{5}"), ("d", "\\boxed{2}")], "id string, raw_prediction string")
    metadata = spark.createDataFrame([("a", "", "q/numeric_equation_transformation_rules/z", 1), ("a", "Later", "", 2), ("", "blank", "", 3)], "id string, category string, source string, line_no long")
    out = evaluate.evaluate(examples, predictions, metadata)
    rows = {r.id: r for r in out["records"].collect()}
    assert (rows["b"].correct, rows["b"].question_type, rows["b"].diagnostic_subtype) == (True, "gravity", "standard")
    assert (rows["a"].correct, rows["a"].category, rows["a"].question_type, rows["a"].question_type_display) == (False, "Later", "transformation_rules_unknown", "Later")
    assert (rows["c"].correct, rows["c"].extracted_prediction, rows["c"].category) == (False, "NOT_FOUND", "unknown")
    assert [r.id for r in evaluate.evaluate(examples, predictions, metadata, limit=2)["records"].orderBy("line_no").collect()] == ["b", "a"]
    assert {r.id for r in evaluate.evaluate(examples, predictions, metadata, kind="gravity")["records"].collect()} == {"b", "d"}
    target = str(tmp_path / "failed")
    sinks.write_text(spark, f"{target}/old.txt", "gone")
    assert sinks.write_failures(out["failures"], target) == 3
    names = sorted(str(p.relative_to(target)) for p in (tmp_path / "failed").rglob("*") if p.suffix in (".json", ".txt"))
    assert names == sorted(f"{d}.{x}" for d in ("gravity/standard/01_d", "transformation_rules_unknown/unknown/01_a", "unknown/unknown/01_c") for x in ("json", "txt"))
    held = json.loads((tmp_path / "failed/gravity/standard/01_d.json").read_text())
    assert tuple(held) == evaluate.RECORD and held["gold_answer"] == "1"


def test_preparation(spark):
    rows = [(f"r{i}", "Gravity" if i % 2 else "Bit Manipulation", "huikang_real_bit" if i % 3 else "synthetic", "no" if i == 4 else "") for i in range(60)] + [("z", "Nothing listed", "m", "")]
    df = spark.createDataFrame(rows, "id string, category string, source_mode string, eval_eligible string")
    out = prepare.prepare(df)
    made = {r.id: r for r in out["splits"].collect()}
    assert set(made) == {f"r{i}" for i in range(60)} and made["r4"].split == "sft_train" and made["r4"].split_policy == "train_only" and made["r4"].eval_eligible == "false"
    assert all(made[f"r{i}"].split == "sft_train" for i in range(0, 60, 3))
    assert [r.id for r in out["global_split"].collect()] == sorted(made)
    assert {(r.diagnostic_type, r.n) for r in out["summary"].filter("column = 'all'").collect()} == {("gravity", 30), ("bit_manipulation", 30)}
    assert "global_split" not in prepare.prepare(df, kinds=("gravity",))
    with pytest.raises(ValueError):
        prepare.prepare(df, kinds=("nope",))
    text = prepare.updated_manifest('{"kept": 1, "total_rows": 0}', prepare.manifest_counts(df, out["splits"]), output_csv="x.csv")
    told = json.loads(text)
    assert told["kept"] == 1 and told["total_rows"] == 61 and told["output_csv"] == "x.csv" and sum(told["single_phase_split_counts"].values()) == 60


def test_training_rows_and_checks(spark):
    rows = spark.createDataFrame([(i, f"q{i}", str(i), "because" if i == 1 else "", "", True, i) for i in (1, 2, 3)], "id int, prompt string, answer string, generated_cot string, assistant_content string, eval_eligible boolean, line_no int")
    given = spark.createDataFrame([(1, "sft_train"), (2, "eval_holdout"), (3, "sft_train")], "id int, split string")
    words = lambda text: F.transform(F.split(text, " "), lambda w: F.length(w))
    got = training.sft_rows(rows, given, ["sft_train"], words, 1000).collect()
    assert {r.id for r in got} == {1, 3} and all(r.total_tokens == len(r.input_ids) == len(r.labels) == r.prompt_tokens + r.completion_tokens for r in got)
    with pytest.raises(Exception, match="over 3 tokens"):
        training.sft_rows(rows, given, ["sft_train"], words, 3).collect()
    train, held = training.phase_split(rows, given)
    assert {r.id for r in train.collect()} == {1, 3} and {r.id for r in held.collect()} == {2}
    with pytest.raises(ValueError):
        training.phase_split(rows, given.filter("id < 3"))
    with pytest.raises(ValueError):
        training.phase_split(rows, given, "nothing")
    assert training.supervision(rows) == "cot" and training.supervision(rows.filter("id > 1")) == "answer_only"
    assert training.run_limits(9000, 0, 1, 1, 1, 64, 32).__len__() == 3 and training.run_limits(512, 8, 2, 4, 1) == []
    texts = {r.id: r.text for r in training.text_rows(rows, "cot").collect()}
    assert "because" in texts[1] and texts[2].startswith(render.START)
    assert [r.id for r in training.head(rows, 2).collect()] == [1, 2]


def test_assignment_and_trace_problems(spark, tmp_path):
    odd = spark.createDataFrame([("a", "x"), ("a", "y"), (" ", "x"), ("b", "")], "id string, split string")
    assert {tuple(r) for r in splits.assignment_problems(odd).collect()} == {("duplicate", "a"), ("blank id", " "), ("blank split", "b")}
    (tmp_path / "s.csv").write_text("id,split\na,x\na,y\n")
    with pytest.raises(ValueError):
        ingest.assignments_csv(spark, str(tmp_path / "s.csv"))
    rows = spark.createDataFrame([("a", "t", ""), ("a", "", "u"), ("", "t", ""), ("c", " ", None)], "id string, generated_cot string, assistant_content string")
    assert {tuple(r) for r in traces.problems(rows).collect()} == {("duplicate id", "a"), ("blank id", ""), ("no trace", "c")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "q"\ny', None)], "id string, text string, more string")
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "out"), ["text", "id", "more"])
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv"]
    assert part.read_bytes() == b'text,id,more\n"x ""q""\ny",a,\n'
    sinks.write_json(spark, str(tmp_path / "s.json"), {"é": [1]})
    assert sinks.read_text(spark, str(tmp_path / "s.json")) == '{\n  "é": [\n    1\n  ]\n}\n' and sinks.read_text(spark, str(tmp_path / "none")) is None


def test_widths_hold_where_signs_turn_into_operators(spark):
    cases = [("op_prefix_if_neg", -5, "+005"), ("op_suffix_rev_if_neg", -5, "500+"), ("op_prefix_if_neg", 5, "5"), ("op_suffix_rev_if_neg", 5, "5")]
    df = spark.createDataFrame(cases, "m string, v long, want string")
    assert all(r.got == r.want for r in df.withColumn("got", numeric.written(F.col("v"), F.col("m"), F.lit("+"), F.lit(3))).collect())


def test_fragments_are_whole_parts(spark):
    df = spark.createDataFrame([("x/work_on#a/b.txt", "work_on"), ("x#a/synthetic/y", "a/synthetic/y"), ("p/synthetic#t#u.v", "t"), ("a\\synthetic\\k/z.txt", "k"), ("", "unknown"), (None, "unknown")], "s string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", classify.source_key(F.col("s"))).collect())


def test_bit_puzzles_of_more_examples_than_a_word_holds(spark):
    pairs = [(f"{v:08b}", f"{(~v) & 255:08b}") for v in range(130)]
    prompt = "rules\n" + "\n".join(f"{a} -> {b}" for a, b in pairs) + "\nNow, determine the output for: 10000001"
    df = spark.createDataFrame([(1, prompt), (2, prompt.replace("00000011 -> 11111100", "00000011 -> 11111101"))], "id int, prompt string").withColumn("p", bit.parse(F.col("prompt"))).select("id", "p.examples", "p.query")
    found = bit.candidates(df, 1)
    assert {(r.output_bit, r.gate) for r in found.filter("id = 1 AND output_bit < 7").collect()} >= {(b, "NOT") for b in range(1, 7)}
    assert found.filter("id = 2 AND output_bit = 7").count() == 0
    assert {r.id: r.prediction for r in bit.solve(df.filter("id = 1"), 1).collect()} == {1: "01111110"}
