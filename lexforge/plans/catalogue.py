"""Registered queries over the driver's tables, each with its oracle SQL where SQL can say it.

The tables hold no puzzles, so puzzle and prediction texts are put together from
their columns, by the same expressions in the query and in its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import classify, render, scoring
from lexforge.functions.text import capitals
from lexforge.operators import checks, reports, splits, traces
from lexforge.plans import runs, solving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = solving.QUERIES | runs.QUERIES
ORACLES: dict[str, str] = solving.ORACLES | runs.ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# --- predictions out of conversations -----------------------------------------

PREDICTIONS = r"""
SELECT conv_id, turn, role, CASE conv_id % 4 WHEN 0 THEN 'Gravity' WHEN 1 THEN 'Text Cipher' WHEN 2 THEN 'Bit Manipulation' ELSE 'Numeral System' END AS category,
       CASE turn % 6
         WHEN 0 THEN concat('First \boxed{', conv_id, '} then \boxed{ ', conv_id * 10 + turn, '} end')
         WHEN 1 THEN concat(text, ' Final answer: ', conv_id * 10 + turn)
         WHEN 2 THEN concat('so x is ', conv_id * 10 + turn, ' or ', (conv_id * 10 + turn) * 1.001)
         WHEN 3 THEN concat('\boxed{', text, '}}\boxed{}')
         WHEN 4 THEN concat('  ', upper(text), '  ')
         ELSE concat('<think>because</think>', chr(10), '\boxed{', conv_id * 10 + turn + (conv_id % 3), '}') END AS raw_prediction,
       CASE turn % 6 WHEN 3 THEN text WHEN 4 THEN lower(text) ELSE cast(conv_id * 10 + turn AS VARCHAR(20)) END AS answer
FROM conversations WHERE role = 'assistant'
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = PREDICTIONS.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}").replace("chr(10)", "char(10)").replace("FROM conversations", "FROM {conversations}")
    # The capitals of the SQL keep a text's length (ß).
    rows = table(spark, sf_dir, "conversations").withColumn("capitals", capitals(F.col("text")))
    return spark.sql(text.replace("upper(text)", "capitals"), conversations=rows)


_TRIM = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _trim(x: str) -> str:
    return _TRIM.format(x=x)


_BOXES = r"list_transform(string_split({t}, '\boxed{{')[2:], lambda x: " + _trim(r"regexp_replace(x, '\}}[^}}]*$', '')") + ")"


def _answer_sql(t: str) -> str:
    boxes = _BOXES.format(t=t)
    last = f"list_filter({boxes}, lambda b: b <> '')[-1]"
    phrases = ", ".join(_trim(f"regexp_extract_all({t}, '(?i){p}', 1)[-1]") for p in (r"The final answer is:\s*([^\n]+)", r"Final answer is:\s*([^\n]+)", r"Final answer\s*[:：]\s*([^\n]+)"))
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: {_trim('l')}), lambda l: l <> '')[-1]"
    return rf"coalesce({last}, {boxes}[-1], {phrases}, regexp_extract_all({t}, '-?\d+(?:\.\d+)?')[-1], {lines}, 'NOT_FOUND')"


def _match_sql(p: str, g: str) -> str:
    a, b = f"try_cast({g} AS DOUBLE)", f"try_cast({p} AS DOUBLE)"
    return rf"""CASE WHEN regexp_full_match({g}, '[01]+') THEN lower({p}) = lower({g})
      WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN abs({a} - {b}) <= greatest(greatest(abs({a}), abs({b})) * 0.01, 0.00001)
      ELSE lower({p}) = lower({g}) END"""


_SCORED = f"""scored AS (
  SELECT *, {_match_sql('extracted', _trim('answer'))} AS correct
  FROM (SELECT *, {_answer_sql('raw_prediction')} AS extracted FROM ({PREDICTIONS})))"""


@query(f"WITH {_SCORED} SELECT conv_id, turn, extracted, correct FROM scored")
def extract_answer_cascade(spark, sf_dir):
    return reports.score(predictions(spark, sf_dir)).select("conv_id", "turn", "extracted", "correct")


@query(rf"SELECT conv_id, turn, coalesce(list_filter(b, lambda x: x <> '')[-1], b[-1]) AS boxed FROM (SELECT *, {_BOXES.format(t='raw_prediction')} AS b FROM ({PREDICTIONS}))")
def extract_boxed(spark, sf_dir):
    return predictions(spark, sf_dir).select("conv_id", "turn", scoring.boxed(F.col("raw_prediction")).alias("boxed"))


@query(f"""WITH {_SCORED} SELECT category, count(*) AS total, count(*) FILTER (correct) AS correct,
  round(count(*) FILTER (correct) / count(*), 9) AS accuracy, grouping(category) AS is_total FROM scored GROUP BY ROLLUP (category)""")
def score_by_category(spark, sf_dir):
    made = reports.by_category(reports.score(predictions(spark, sf_dir)))
    return made.select("category", "total", "correct", F.round("accuracy", 9).alias("accuracy"), F.col("is_total").cast("int").alias("is_total"))


@query(rf"""WITH {_SCORED}, parts AS (
  SELECT conv_id, turn, CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy_reward,
         CASE WHEN regexp_matches(raw_prediction, '(?im)^\s*\\boxed\{{.*\}}\s*$') THEN 0.02 ELSE 0.0 END::DOUBLE AS final_line_reward,
         CASE WHEN len(string_split(raw_prediction, '\boxed{{')) = 2 THEN 0.08 ELSE 0.0 END::DOUBLE AS single_box_reward FROM scored)
  SELECT *, round(accuracy_reward + final_line_reward + single_box_reward, 6) AS total_reward FROM parts""")
def rewards_components(spark, sf_dir):
    parts = scoring.rewards(F.col("raw_prediction"), F.col("answer"))
    parts["total_reward"] = F.round(parts["total_reward"], 6)
    return predictions(spark, sf_dir).select("conv_id", "turn", *[c.alias(n) for n, c in parts.items()])


@query(f"SELECT l_orderkey, l_linenumber, {_match_sql('predicted', 'gold')} AS correct FROM (SELECT l_orderkey, l_linenumber, l_quantity::VARCHAR AS gold, (l_quantity * (1 + (l_linenumber - 3) * 0.0041))::VARCHAR AS predicted FROM lineitem)")
def answers_match_numeric(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS STRING) AS gold", "CAST(l_quantity * (1 + (l_linenumber - 3) * 0.0041D) AS STRING) AS predicted")
    return rows.select("l_orderkey", "l_linenumber", scoring.matches(F.col("predicted"), F.col("gold")).alias("correct"))


@query(f"""SELECT o_orderkey, {_match_sql('predicted', 'gold')} AS correct FROM (
  SELECT o_orderkey, bin(o_orderkey % 8) AS gold, bin(o_custkey % 8) || CASE WHEN o_orderkey % 5 = 0 THEN '.0' ELSE '' END AS predicted FROM orders)""")
def answers_match_binary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "bin(o_orderkey % 8) AS gold", "concat(bin(o_custkey % 8), if(o_orderkey % 5 = 0, '.0', '')) AS predicted")
    return rows.select("o_orderkey", scoring.matches(F.col("predicted"), F.col("gold")).alias("correct"))


@query(f"""SELECT o_orderkey, {_match_sql(_trim('predicted'), _trim('gold'))} AS correct FROM (
  SELECT o_orderkey, ' ' || o_orderpriority || chr(9) AS gold, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE lower(o_orderpriority) END AS predicted FROM orders)""")
def answers_match_text(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(' ', o_orderpriority, char(9)) AS gold", "if(o_orderkey % 3 = 0, o_orderstatus, lower(o_orderpriority)) AS predicted")
    return rows.select("o_orderkey", scoring.matches(F.col("predicted"), F.col("gold")).alias("correct"))


# --- labelled documents ---------------------------------------------------------

_LABELLED = "SELECT d.doc_id, lang, source, l.quality = 1 AND l.toxic = 0 AS correct FROM documents d JOIN labels l USING (doc_id)"


def labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr("quality = 1 AND toxic = 0").alias("correct"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labels, "doc_id")


@query(f"""WITH r AS ({_LABELLED}), m AS (SELECT lang, correct AS sub, source, count(*) AS n, count(*) FILTER (correct) AS k FROM r GROUP BY ALL),
  pair AS (SELECT lang, sub, source, n, k FROM m), one AS (SELECT lang, NULL AS sub, source, sum(n) AS n, sum(k) AS k FROM m GROUP BY ALL)
  SELECT lang, sub::VARCHAR AS sub, sum(n)::BIGINT AS total, sum(k)::BIGINT AS correct, string_agg(source || '=' || n, ',' ORDER BY source) AS modes,
         (sub IS NOT NULL)::INT AS level, round(sum(k) / sum(n), 9) AS accuracy FROM (SELECT * FROM pair UNION ALL SELECT * FROM one) GROUP BY lang, sub""")
def report_rollup_type_subtype(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("sub", F.col("correct").cast("string"))
    return reports.by_type(rows, "lang", "sub", "source").withColumn("accuracy", F.round("accuracy", 9))


@query(f"SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS place FROM ({_LABELLED}) WHERE NOT correct QUALIFY place <= 3")
def failed_topk_per_subtype(spark, sf_dir):
    return reports.failures(labelled(spark, sf_dir), ["lang", "source"], "doc_id").select("lang", "source", "doc_id", "place")


@query(r"""SELECT doc_id, CASE WHEN regexp_extract(t, '^(.+?[.!?])(?:\s|$)', 1) <> '' THEN regexp_extract(t, '^(.+?[.!?])(?:\s|$)', 1) ELSE t END AS sentence
  FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.first_sentence(F.col("text")).alias("sentence"))


_SENTENCES = list(classify.CATEGORY_OF_SENTENCE)


@query("SELECT doc_id, CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(classify.BASE_CATEGORIES)) + " END AS category FROM documents")
def infer_category_map(spark, sf_dir):
    heads = F.array(*map(F.lit, [*_SENTENCES, "No such template."]))
    prompt = F.concat(F.lit("\n "), F.get(heads, (F.col("doc_id") % 7).cast("int")), F.lit("\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", classify.category(prompt, strict=False).alias("category"))


_SAFE = "coalesce(nullif(trim(regexp_replace(replace(replace(replace(lower(trim({x})), '|', '_'), '+', 'plus'), '-', 'minus'), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"


@query(f"SELECT p_partkey, {_SAFE.format(x='s')} AS label, coalesce(nullif(trim(regexp_replace(lower(s), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '--' ELSE p_brand || ' +|' || p_type || '-x ' END AS s FROM part)")
def safe_label(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 9 = 0 THEN '--' ELSE concat(p_brand, ' +|', p_type, '-x ') END AS s")
    return rows.select("p_partkey", classify.safe_label(F.col("s")).alias("label"), classify.slugify(F.col("s")).alias("slug"))


_PATHS = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'a/work_on/ba_dc_addition/len' || lang || '/x.txt' WHEN 1 THEN 'a#b/' || source WHEN 2 THEN 'synthetic' || chr(92) || 'modular/x.y'
  WHEN 3 THEN '' WHEN 4 THEN 'symbol_transform/' || source WHEN 5 THEN 'z/synthetic/direct_template/' || lang WHEN 6 THEN 'x/synthetic/work_on/low_confidence/q' ELSE CASE doc_id % 3 WHEN 0 THEN 'x/work_on#a/b.txt' WHEN 1 THEN 'x#a/synthetic/y' ELSE source END END AS source FROM documents"""


@query(f"""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'ba_dc_addition/len' || lang WHEN 1 THEN 'b/' || source WHEN 2 THEN 'modular' WHEN 3 THEN 'unknown' WHEN 4 THEN source
  WHEN 5 THEN 'direct_template/' || lang WHEN 6 THEN 'low_confidence/q' ELSE CASE doc_id % 3 WHEN 0 THEN 'work_on' WHEN 1 THEN 'a/synthetic/y' ELSE source END END AS source_key FROM documents""")
def source_key(spark, sf_dir):
    rows = spark.sql(_PATHS.replace("chr(92)", "char(92)").replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return rows.select("doc_id", classify.source_key(F.col("source")).alias("source_key"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'ba_dc_addition_len' || lang WHEN 1 THEN 'b_' || source WHEN 2 THEN 'modular' WHEN 3 THEN 'unknown' WHEN 4 THEN source
  WHEN 5 THEN CASE doc_id % 3 WHEN 0 THEN 'direct_template_template0134' WHEN 1 THEN 'direct_template_unknown' ELSE 'direct_template_template3401' END
  WHEN 6 THEN 'low_confidence_q' ELSE CASE doc_id % 3 WHEN 0 THEN 'work_on' WHEN 1 THEN 'a_synthetic_y' ELSE source END END AS subtype FROM documents""")
def classify_subtype(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = spark.sql(_PATHS.replace("chr(92)", "char(92)").replace("FROM documents", "FROM {documents}"), documents=docs)
    trace = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Try template 0134\\n pass\\nTry template 3401' WHEN 1 THEN 'try template 3401\\ntry other\\npass' ELSE 'x\\ntemplate 3401 passes all examples\\ntry template0134\\npass' END")
    return rows.select("doc_id", classify.subtype(F.lit("Numeric Equation Transformation Rules"), F.col("source"), F.lit(""), trace).alias("subtype"))


@query("""SELECT doc_id, m NOT IN ('synthetic', 'huikang_synthetic_matching') AND f NOT IN ('0', 'no', 'false') AS eligible,
  NOT (m NOT IN ('synthetic', 'huikang_synthetic_matching') AND f NOT IN ('0', 'no', 'false')) OR doc_id % 11 = 0 AS train_only FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'huikang_synthetic_matching' ELSE 'real' END AS m,
         CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN '0' ELSE 'no' END WHEN doc_id % 5 = 0 THEN '' ELSE 'yes' END AS f FROM labels)""")
def eligibility_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "CASE doc_id % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'huikang_synthetic_matching' ELSE 'real' END AS m",
        "CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN '0' ELSE ' NO ' END WHEN doc_id % 5 = 0 THEN '' ELSE 'yes' END AS f", "if(doc_id % 11 = 0, 'train_only', '') AS p",
    )
    return rows.select("doc_id", classify.eval_eligible(F.col("m"), F.col("f")).alias("eligible"), classify.train_only(F.col("m"), F.col("f"), F.col("p")).alias("train_only"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'numeric_equation' WHEN 1 THEN 'symbol_transform' WHEN 2 THEN 'numeric_equation' ELSE 'unknown' END AS kind FROM lineitem""")
def equation_vs_symbol(spark, sf_dir):
    prompt = F.expr("""CASE l_linenumber % 4 WHEN 0 THEN concat('rules\\nNow, determine the result for: ', CAST(l_quantity AS INT), ' + ', l_linenumber)
      WHEN 1 THEN 'Now, determine the result for: #$*@%' WHEN 2 THEN concat('12 = ', l_linenumber, '\\ndetermine the result for: abc') ELSE 'plain words' END""")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", classify.equation_or_symbol(prompt).alias("kind"))


# --- splits ---------------------------------------------------------------------

_QUOTA = """CASE WHEN n >= 10 THEN greatest(1, round_even(n * 0.1, 0)) WHEN n >= 4 THEN 1 ELSE 0 END::BIGINT"""
_EVAL = f"CASE WHEN n IN (2, 3) THEN 1 ELSE {_QUOTA} END"


@query(f"SELECT lang, source, n AS size, n - ({_EVAL}) - ({_QUOTA}) AS sft_train, {_EVAL} AS eval_holdout, {_QUOTA} AS grpo_holdout FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def split_quota(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("size"))
    return sizes.select("lang", "source", "size", *[q.alias(n) for q, n in zip(splits.quotas(F.col("size")), classify.SPLITS)])


_SPLIT = f"""split AS (SELECT doc_id, lang, source, CASE WHEN r <= n - ({_EVAL}) - ({_QUOTA}) THEN 'sft_train' WHEN r <= n - ({_QUOTA}) THEN 'eval_holdout' ELSE 'grpo_holdout' END AS split
  FROM (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang, source) AS n,
        row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents))"""


def split_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return splits.stratified(rows, ["lang", "source"], "doc_id")


@query(f"WITH {_SPLIT} SELECT doc_id, split FROM split")
def stratified_split(spark, sf_dir):
    return split_documents(spark, sf_dir).select("doc_id", "split")


@query(f"WITH {_SPLIT} SELECT split, count(*) AS n FROM split GROUP BY split")
def split_counts(spark, sf_dir):
    return split_documents(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query(f"""WITH {_SPLIT} SELECT 'lang' AS "column", lang AS value, NULL AS value2, count(*) AS n FROM split GROUP BY lang UNION ALL SELECT 'split', split, NULL, count(*) FROM split GROUP BY split
  UNION ALL SELECT 'split*source', split, source, count(*) FROM split GROUP BY split, source UNION ALL SELECT 'all', NULL, NULL, count(*) FROM split""")
def split_subtype_crosstab(spark, sf_dir):
    return reports.histograms(split_documents(spark, sf_dir), ["lang", "split"], ("split", "source"))


@query("""WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT *, floor(n * 0.7)::BIGINT AS a, floor(n * 0.2)::BIGINT AS v, floor(n * 0.1)::BIGINT AS t FROM c),
  s AS (SELECT *, list_reverse_sort([{'p': n * 0.7::DOUBLE - a, 'i': 0}, {'p': n * 0.2::DOUBLE - v, 'i': 1}, {'p': n * 0.1::DOUBLE - t, 'i': 2}]) AS o, n - a - v - t AS spare FROM b),
  q AS (SELECT o_orderpriority, n, a + list_contains(list_transform(o[1:spare], lambda x: x.i), 0)::BIGINT AS a, v + list_contains(list_transform(o[1:spare], lambda x: x.i), 1)::BIGINT AS v FROM s),
  r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM orders)
  SELECT o_orderkey, CASE WHEN r <= a THEN 'train' WHEN r <= a + v THEN 'val' ELSE 'test' END AS split FROM r JOIN q USING (o_orderpriority)""")
def largest_remainder_partition(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return splits.partition(rows, "o_orderpriority", {"train": 0.7, "val": 0.2, "test": 0.1}, "o_orderkey").select("o_orderkey", "split")


@query("""SELECT event_type, sum(n)::BIGINT AS n FROM (SELECT event_type, 1 AS n FROM events UNION ALL SELECT unnest(['click', 'none', 'view']), 0) GROUP BY event_type""")
def category_counts_zero_filled(spark, sf_dir):
    return reports.zero_filled(table(spark, sf_dir, "events"), "event_type", ["click", "none", "view"])


_ASSIGNED = "SELECT doc_id + (doc_id % 7 = 0)::INT * 1000000 AS doc_id, CASE WHEN quality = 1 THEN 'sft_train' ELSE 'eval_holdout' END AS split FROM labels"


def assigned(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr("doc_id + if(doc_id % 7 = 0, 1000000, 0) AS doc_id", "if(quality = 1, 'sft_train', 'eval_holdout') AS split")


@query(f"SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_ASSIGNED}) WHERE split = 'eval_holdout')")
def semi_join_select(spark, sf_dir):
    return splits.select(table(spark, sf_dir, "documents").select("doc_id", "lang"), assigned(spark, sf_dir), ["eval_holdout"], "doc_id")


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_ASSIGNED}))")
def anti_missing(spark, sf_dir):
    return splits.missing(table(spark, sf_dir, "documents"), assigned(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id FROM ({_ASSIGNED}) WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def anti_extra(spark, sf_dir):
    return splits.extra(table(spark, sf_dir, "documents"), assigned(spark, sf_dir), "doc_id")


@query(f"""WITH a AS ({_ASSIGNED} UNION ALL SELECT doc_id, 'odd' FROM labels WHERE doc_id % 50 = 1)
  SELECT 'missing' AS problem, doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)
  UNION ALL SELECT DISTINCT 'extra', doc_id::VARCHAR FROM a WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'duplicate', doc_id::VARCHAR FROM a GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'unknown split', doc_id::VARCHAR FROM a WHERE split = 'odd'""")
def split_violations(spark, sf_dir):
    odd = table(spark, sf_dir, "labels").filter("doc_id % 50 = 1").selectExpr("doc_id", "'odd' AS split")
    return splits.violations(table(spark, sf_dir, "documents"), assigned(spark, sf_dir).unionByName(odd), "doc_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return checks.duplicates(table(spark, sf_dir, "events"), "user_id")


@query("SELECT count(*) - count(DISTINCT user_id) AS n_duplicates FROM events")
def duplicate_count(spark, sf_dir):
    return checks.duplicate_count(table(spark, sf_dir, "events"), "user_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 5 = 0 AND lang <> 'xx' THEN 'differs: lang' ELSE 'differs: source' END AS issue FROM documents WHERE doc_id % 13 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0
  UNION ALL SELECT -doc_id - 1, 'extra' FROM documents WHERE doc_id % 17 = 0""")
def freshness_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    stored = docs.filter("doc_id % 13 <> 0").selectExpr("doc_id", "if(doc_id % 5 = 0, 'xx', lang) AS lang", "if(doc_id % 7 = 0, concat(source, '?'), source) AS source")
    stored = stored.unionByName(docs.filter("doc_id % 17 = 0").selectExpr("-doc_id - 1 AS doc_id", "lang", "source"))
    return checks.differences(docs, stored, "doc_id", ["lang", "source"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def metadata_left_join_last_wins(spark, sf_dir):
    return checks.last_per_id(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), "user_id", "event_id").select("user_id", "event_type", "value")


@query("SELECT event_id::VARCHAR || 'a' AS id, 'sft_train' AS split FROM events UNION ALL SELECT event_id::VARCHAR || 'b', 'eval_holdout' FROM events")
def json_split_explode(spark, sf_dir):
    made = """concat('{"', if(event_id % 2 = 0, 'split_ids', 'splits'), '": {"sft_train": ["', event_id, 'a"], "eval_holdout": ["', event_id, 'b"]}}') AS value"""
    return splits.from_json(table(spark, sf_dir, "events").selectExpr(made))


@query(f"WITH {_SPLIT} SELECT doc_id, lang, split FROM split")
def global_split_union(spark, sf_dir):
    own = split_documents(spark, sf_dir).select("doc_id", "lang", "split")
    parts = [own.filter(F.col("lang") == x) for x in ("en", "fr", "de")] + [own.filter(~F.col("lang").isin("en", "fr", "de"))]
    return splits.union(parts, "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


# --- rendering --------------------------------------------------------------------

_INSTRUCTION = render.INSTRUCTION.replace("'", "''")


@query(f"""SELECT conv_id, turn, '<|im_start|>user' || chr(10) || {_trim('text')} || chr(10) || '{_INSTRUCTION}' || chr(10) || '<|im_end|>' || chr(10) ||
  '<|im_start|>assistant' || chr(10) || 'Answer: \\boxed{{' || conv_id || '}}' || chr(10) || '<|im_end|>' AS chat FROM conversations""".replace("\\\\", "\\"))
def chat_template_text(spark, sf_dir):
    said = render.messages(F.col("text"), render.answer_line(F.col("conv_id").cast("string")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", render.chat_text(said).alias("chat"))


@query(f"""SELECT conv_id, turn, {_trim('text')} AS trimmed, '<think>' || chr(10) || {_trim('text')} || chr(10) || chr(10) || 'Answer: \\boxed{{' || turn || '}}' || chr(10) || '</think>' || chr(10) || '\\boxed{{' || turn || '}}' AS target
  FROM conversations""".replace("\\\\", "\\"))
def assistant_target(spark, sf_dir):
    trace = F.concat("text", F.lit("\n\nFinal answer: "), F.lit("\\boxed{"), F.col("turn").cast("string"), F.lit("}\n \n"))
    made = render.trace_content(F.lit("unused"), trace, F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", render.reasoning(trace).alias("trimmed"), made.alias("target"))


def _ids(text):
    """Stand-in tokens: the lengths of the words."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.length(w))


_TOKENS = r"list_transform(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''), lambda w: length(w))"


@query(f"""SELECT conv_id, turn, len(h) AS n_prompt, len(t) AS n_completion, array_to_string(list_concat(h, t), ',') AS input_ids,
  array_to_string(list_concat(list_transform(h, lambda x: -100), t), ',') AS labels FROM (SELECT conv_id, turn, {_TOKENS.format(x='role')} AS h, {_TOKENS.format(x='text')} AS t FROM conversations)""")
def label_mask(spark, sf_dir):
    m = render.masked_example(F.col("role"), F.col("text"), _ids)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", m.alias("m")).select(
        "conv_id", "turn", "m.n_prompt", "m.n_completion", F.array_join(F.transform("m.input_ids", lambda x: x.cast("string")), ",").alias("input_ids"), F.array_join(F.transform("m.labels", lambda x: x.cast("string")), ",").alias("labels")
    )


@query(f"""SELECT conv_id, turn, array_to_string(list_concat(t, list_transform(range(max(len(t)) OVER (PARTITION BY conv_id) - len(t)), lambda x: 0)), ',') AS padded
  FROM (SELECT conv_id, turn, {_TOKENS.format(x='text')} AS t FROM conversations)""")
def pad_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _ids(F.col("text")).alias("ids"))
    widths = rows.groupBy("conv_id").agg(F.max(F.size("ids")).alias("width"))
    return rows.join(widths, "conv_id").select("conv_id", "turn", F.array_join(F.transform(render.padded(F.col("ids"), F.col("width"), 0), lambda x: x.cast("string")), ",").alias("padded"))


@query(f"""SELECT doc_id AS problem_id, {_SAFE.format(x='lang').replace("'minus'", "'_'").replace("'plus'", "'_'")} || '/' || doc_id || '.txt' AS path, {_trim('text')} || chr(10) AS text FROM documents WHERE {_trim('text')} <> ''""")
def trace_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("generated_cot"), F.col("text").alias("assistant_content"), F.col("lang").alias("category"), F.col("source").alias("source_mode"))
    return traces.records(rows).select("problem_id", "path", "text")


@query("""SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'differs' END AS issue FROM (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents) WHERE doc_id % 9 = 0 OR doc_id % 4 = 0
  UNION ALL SELECT 'stray/' || doc_id || '.txt', 'extra' FROM documents WHERE doc_id % 21 = 0""")
def trace_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = docs.select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text", "doc_id")
    disk = want.filter("doc_id % 9 <> 0").withColumn("text", F.expr("if(doc_id % 4 = 0, concat(text, '!'), text)"))
    disk = disk.select("path", "text").unionByName(docs.filter("doc_id % 21 = 0").selectExpr("concat('stray/', doc_id, '.txt') AS path", "text"))
    return traces.check(want.select("path", "text"), disk)
