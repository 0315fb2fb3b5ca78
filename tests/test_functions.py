import pytest
from pyspark.sql import functions as F

from lexforge.functions import classify, render, scoring, text
from lexforge.operators import checks, reports, splits, traces


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    assert one(spark, [" \t\n a b\u2003", "", None], text.strip) == ["a b", "", None]
    assert one(spark, ["a\r\nb\u2028c\n", "", "\n", "x"], text.lines) == [["a", "b", "c"], [], [""], ["x"]]
    got = one(spark, ["1d", "0x1p3", "1_000", " 2.5e1 ", "nan", ".5", "5.", "1f", "inf"], text.to_number)
    assert [str(x) for x in got] == ["None", "None", "1000.0", "25.0", "nan", "0.5", "5.0", "None", "inf"]
    assert one(spark, ["12345", "-7", "7"], lambda v: text.fill_zeros(v, F.lit(3))) == ["12345", "-07", "007"]


@pytest.mark.parametrize(
    "said,want",
    [
        (r"a \boxed{1} b \boxed{f{2}} c", "f{2}"), (r"\boxed{x}} \boxed{}", "x}"), (r"\boxed{}", ""), (r"\boxed{open", "open"),
        ("The final answer is: 7 \nrest 9", "7"), ("Final answer： yes\nfinal answer: no", "no"), ("so 3 then -4.5", "-4.5"), ("only\n words \n\n", "words"), ("", "NOT_FOUND"), (None, "NOT_FOUND"),
    ],
)
def test_answers(spark, said, want):
    assert one(spark, [said], scoring.answer) == [want]


def test_matching(spark):
    pairs = [("10.0", "10", False), ("1.01", "1.0", False), ("2.02", "2.0", True), ("2.03", "2.0", False), ("nan", "nan", False), ("inf", "inf", True), ("-inf", "inf", False), (" Yes", "yEs ", True), ("1d", "1D", True), ("0.000005", "0.0", True), ("0101", "0101", True), ("1e2", "100.5", True)]
    pairs[1] = ("1.02", "1.00", False)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, g string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", scoring.matches(F.col("p"), F.col("g"))).collect())


def test_matching_reads_each_number_once(spark):
    """The pattern of numbers stands twice in the plan, once for each side."""
    made = spark.createDataFrame([("1.0", "1")], "p string, g string").select(scoring.matches(F.col("p"), F.col("g")).alias("x"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("infinity") == 2
    odd = [(None, "1", None), ("1", None, None), (" 1_0 ", "10.05", True), ("", "", True), ("١", "1", False), ("1\n", "1", True)]
    rows = spark.createDataFrame(odd, "p string, g string, want boolean").withColumn("got", scoring.matches(F.col("p"), F.col("g")))
    assert [r.got for r in rows.collect()] == [w for _, _, w in odd]


def test_rewards_and_completions(spark):
    df = spark.createDataFrame([("\\boxed{5}", "5"), ("x \\boxed{5} y", "6"), ("5", "5")], "t string, g string")
    parts = scoring.rewards(F.col("t"), F.col("g"))
    assert [round(r.total, 2) for r in df.select(parts["total_reward"].alias("total")).collect()] == [1.1, 0.08, 1.0]
    got = one(spark, ['[{"content": "a"}, {"content": " b "}]', '{"content": "c"}', "plain", None], scoring.completion_text)
    assert got == ["a\n b", "c", "plain", ""]
    deep = one(spark, ['[[{"content": [{"content": "x"}, ["y", {"content": null}]]}], 3]', "[broken", "{}"], scoring.completion_text)
    assert deep == ["x\ny\n3", "[broken", ""]


def test_classification(spark):
    prompts = [s + " More text." for s in classify.CATEGORY_OF_SENTENCE] + ["unknown"]
    assert one(spark, prompts, lambda v: classify.category(v, strict=False)) == [*classify.BASE_CATEGORIES, None]
    assert one(spark, ["Bit", "text-cipher", "Numeric Equation Transformation Rules", "nope"], classify.question_type) == ["bit_manipulation", "text_cipher", "numeric_equation", None]
    assert one(spark, [" A|b+c-d!! ", "", "--"], classify.safe_label) == ["a_bpluscminusd", "unknown", "minusminus"]
    paths = ["a/work_on/ba_dc_addition/len2/x.txt", "a#b/c", "synthetic", "x\\synthetic\\modular", "plain/path.txt", None]
    assert one(spark, paths, classify.source_key) == ["ba_dc_addition/len2", "b/c", "synthetic", "modular", "plain/path.txt", "unknown"]
    traces_ = ["Try template 0134\nPass", "try template3401\ntry other\npass", "template 0134 passes all examples", "pass", None]
    assert one(spark, traces_, classify.template_pass) == ["template0134", None, "template0134", None, None]


def test_reasoning(spark):
    said = ["step\n\nFinal answer: 3\n\\boxed{3}\n", "a <think> b </think> c", "answer", None, "keep\nthe answers here"]
    assert one(spark, said, render.reasoning) == ["step", "<think>\nb\n</think>", "", "", "keep\nthe answers here"]
    target = one(spark, ["x\n\\boxed{9}"], lambda v: render.trace_content(F.lit("1"), v, F.lit(None).cast("string")))
    assert target == ["<think>\nx\n\nAnswer: \\boxed{9}\n</think>\n\\boxed{9}"]


@pytest.mark.parametrize("n,want", [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 1, 0)), (3, (2, 1, 0)), (4, (2, 1, 1)), (9, (7, 1, 1)), (15, (11, 2, 2)), (25, (21, 2, 2)), (59, (47, 6, 6)), (1364, (1092, 136, 136)), (1576, (1260, 158, 158)), (1594, (1276, 159, 159)), (1597, (1277, 160, 160))])
def test_quotas(spark, n, want):
    row = spark.range(1).select(F.lit(n).cast("long").alias("n")).select(*splits.quotas(F.col("n"))).first()
    assert tuple(row) == want


def test_splits_and_checks(spark):
    rows = spark.createDataFrame([(f"r{i}", "a" if i % 3 else "b", i % 10 == 0) for i in range(200)], "id string, s string, fixed boolean")
    made = splits.stratified(rows, ["s"], "id", train_only=F.col("fixed"))
    assert made.count() == 200 and made.filter("fixed AND split <> 'sft_train'").count() == 0
    assert splits.violations(rows, made.select("id", "split")).count() == 0
    broken = made.select("id", "split").filter("id <> 'r1'").unionByName(spark.createDataFrame([("zz", "odd"), ("r2", "sft_train")], "id string, split string"))
    found = {(r.problem, r.id) for r in splits.violations(rows, broken).collect()}
    assert found == {("missing", "r1"), ("extra", "zz"), ("unknown split", "zz"), ("duplicate", "r2")}
    with pytest.raises(Exception, match="duplicate id"):
        splits.union([made.select("id", "split"), made.select("id", "split")]).collect()
    lined = spark.createDataFrame([(1, "x", " "), (2, None, "y")], "line_no int, a string, b string")
    assert {tuple(r) for r in checks.required(lined, ["a", "b"]).collect()} == {(2, "b"), (3, "a")}
    with pytest.raises(ValueError):
        checks.assert_none(checks.required(lined, ["a"]), "blank")


def test_reports(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "category string, correct boolean")
    got = {(r.category, r.total, r.correct, r.accuracy) for r in reports.by_category(rows).collect()}
    assert got == {("a", 2, 1, 0.5), ("b", 1, 1, 1.0), (None, 3, 2, 2 / 3)}


def test_trace_export(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Bit X", "m", "a", " t ", ""), ("2", "B", "m", "b", "", "given"), ("3", "B", "m", "c", "", " ")], "id string, category string, source_mode string, answer string, generated_cot string, assistant_content string")
    made = traces.records(rows)
    assert {(r.path, r.text) for r in made.collect()} == {("bit_x/1.txt", "t\n"), ("b/2.txt", "given\n")}
    assert traces.export(made, str(tmp_path / "t")).count() == 2 and traces.export(made, str(tmp_path / "t")).count() == 0
    with pytest.raises(ValueError):
        traces.export(made.withColumn("text", F.lit("new")), str(tmp_path / "t"))
    (tmp_path / "d" / "b").mkdir(parents=True)
    (tmp_path / "d" / "b" / "x.txt").write_text("two\nlines")
    assert [tuple(r) for r in traces.directory(spark, str(tmp_path / "d")).collect()] == [("b/x.txt", "two\nlines")]
