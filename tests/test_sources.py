import json

from lexforge.sources import ingest


def test_csv_with_long_cells(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,prompt,answer,category,label,source_mode,source\n001,"In Alice\'s Wonderland, the gravitational constant has been secretly changed. Say ""k""\nnow",5,,,,\n002,other,,Gravity,,synthetic,\n002,x,3,,Text Cipher,,\n,y, ,,,,\n')
    rows = ingest.read_csv(spark, str(path), ["id", "prompt", "answer", "category", "label", "source_mode", "source"])
    got = ingest.sft_examples(rows).orderBy("line_no").collect()
    assert [r.category for r in got] == ["Gravity", "Gravity", "Text Cipher", None]
    assert [r.source_mode for r in got] == ["unknown", "synthetic", "unknown", "unknown"] and [r.eval_eligible for r in got] == [True, False, True, True]
    assert {r.column for r in ingest.problems(rows).collect()} == {"id", "answer", "duplicate id"}
    assert ingest.examples(rows, strict=False).orderBy("line_no").first().category == "Gravity"
    assert ingest.of_type(ingest.sft_examples(rows), "gravity").count() == 2
    made = ingest.prepared(ingest.sft_examples(rows)).orderBy("line_no").collect()
    assert [(r.diagnostic_type, r.diagnostic_subtype, r.split_policy) for r in made[:2]] == [("gravity", "standard", "holdout_ok"), ("gravity", "standard", "train_only")]


def test_assignments(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,split\n a ,sft_train\nb,eval_holdout\n")
    assert {tuple(r) for r in ingest.assignments_csv(spark, str(tmp_path / "s.csv")).collect()} == {("a", "sft_train"), ("b", "eval_holdout")}
    (tmp_path / "s.json").write_text(json.dumps({"splits": {"sft_train": ["a"], "eval_holdout": ["b", "c"]}}, indent=1))
    assert {tuple(r) for r in ingest.assignments_json(spark, str(tmp_path / "s.json")).collect()} == {("a", "sft_train"), ("b", "eval_holdout"), ("c", "eval_holdout")}
