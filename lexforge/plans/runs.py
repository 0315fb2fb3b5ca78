"""Queries of whole runs: evaluation, preparation and training rows, over stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import evaluate, prepare, training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- evaluation -------------------------------------------------------------------


def _examples(spark, sf_dir):
    """An example for each assistant turn; its answer is the turn's number or its text in capitals, of which those of ß don't come back."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return rows.selectExpr(
        "concat(conv_id, '-', turn) AS id", "'a prompt' AS prompt", "if(turn % 4 = 1, CAST(conv_id AS STRING), upper(text)) AS answer",
        "CASE conv_id % 4 WHEN 0 THEN 'Gravity' WHEN 1 THEN 'Transformation Rules' WHEN 2 THEN 'Text Cipher' ELSE '' END AS category", "conv_id * 1000 + turn AS line_no", "conv_id", "turn", "text",
    )


def _predictions(examples):
    return examples.filter("conv_id % 11 <> 0").selectExpr("id", "CASE WHEN turn % 4 = 1 THEN concat('so \\\\boxed{', conv_id + if(conv_id % 3 = 0, 0, 5), '.0}') ELSE concat('\\\\boxed{', text, '}') END AS raw_prediction")


def _metadata(examples):
    """Two rows for an id, of which the later counts; some ids have none."""
    some = examples.filter("conv_id % 5 <> 0")
    stale = some.selectExpr("id", "'Old Category' AS category", "'' AS label", "'' AS source", "'' AS source_mode", "'gravity' AS diagnostic_type", "'stale' AS diagnostic_subtype", "0 AS line_no")
    told = some.selectExpr(
        "id", "if(conv_id % 3 = 0, 'Numeric Equation Transformation Rules', '') AS category", "if(conv_id % 7 = 0, 'Symbol Transform, hard', '') AS label",
        "CASE turn % 3 WHEN 0 THEN 'a/work_on/modular/x.txt' WHEN 1 THEN 'x/work_on#a/b.txt' ELSE 'symbol_transform/q' END AS source", "if(turn % 2 = 0, 'real', '') AS source_mode",
        "if(conv_id % 13 = 0, ' unit_conversion ', '') AS diagnostic_type", "if(conv_id % 6 = 0, ' given ', '') AS diagnostic_subtype", "1 AS line_no",
    )
    return stale.unionByName(told)


_RECORDS = r"""e AS (
  SELECT conv_id || '-' || turn AS id, conv_id, turn, conv_id % 5 <> 0 AS known,
         CASE conv_id % 4 WHEN 0 THEN 'Gravity' WHEN 1 THEN 'Transformation Rules' WHEN 2 THEN 'Text Cipher' ELSE '' END AS own,
         CASE WHEN conv_id % 11 = 0 THEN NULL WHEN turn % 4 = 1 THEN conv_id % 3 = 0 OR (regexp_full_match(conv_id::VARCHAR, '[01]+') AND false)
              OR abs(5.0) <= 0.01 * (conv_id + 5) ELSE NOT contains(text, 'ß') END AS close, regexp_full_match(conv_id::VARCHAR, '[01]+') AS bits, text
  FROM conversations WHERE role = 'assistant'),
m AS (
  SELECT *, CASE WHEN known AND conv_id % 3 = 0 THEN 'Numeric Equation Transformation Rules' ELSE '' END AS mc, CASE WHEN known AND conv_id % 7 = 0 THEN 'Symbol Transform, hard' ELSE '' END AS ml,
         CASE WHEN NOT known THEN '' WHEN turn % 3 = 0 THEN 'a/work_on/modular/x.txt' WHEN turn % 3 = 1 THEN 'x/work_on#a/b.txt' ELSE 'symbol_transform/q' END AS source,
         CASE WHEN known AND turn % 2 = 0 THEN 'real' ELSE 'unknown' END AS source_mode, known AND conv_id % 13 = 0 AS unit, known AND conv_id % 6 = 0 AS given FROM e),
c AS (SELECT *, coalesce(nullif(mc, ''), nullif(ml, ''), nullif(own, ''), 'unknown') AS category FROM m),
t AS (
  SELECT *, CASE WHEN unit THEN 'unit_conversion' WHEN category = 'Gravity' THEN 'gravity' WHEN category = 'Text Cipher' THEN 'text_cipher' WHEN category = 'Numeric Equation Transformation Rules' THEN 'numeric_equation'
         WHEN contains(source, 'symbol_transform') OR contains(lower(coalesce(nullif(ml, ''), mc)), 'symbol transform') THEN 'symbol_transform' WHEN own = 'Transformation Rules' THEN 'transformation_rules_unknown'
         ELSE regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g') END AS question_type FROM c),
r AS (
  SELECT *, CASE question_type WHEN 'unit_conversion' THEN 'Unit Conversion' WHEN 'gravity' THEN 'Gravity' WHEN 'text_cipher' THEN 'Text Cipher' WHEN 'numeric_equation' THEN 'Numeric Equation Transformation Rules'
         WHEN 'symbol_transform' THEN 'Symbol Transform' ELSE category END AS question_type_display,
         CASE WHEN given THEN 'given'
              WHEN mc = 'Numeric Equation Transformation Rules' OR (mc = '' AND question_type = 'numeric_equation') THEN CASE WHEN question_type IN ('unit_conversion', 'numeric_equation') THEN CASE turn % 3 WHEN 0 THEN 'modular' WHEN 1 THEN 'work_on' ELSE 'q' END ELSE 'unknown' END
              WHEN question_type = 'symbol_transform' THEN CASE turn % 3 WHEN 0 THEN 'modular' WHEN 1 THEN 'work_on' ELSE 'q' END
              WHEN question_type IN ('unit_conversion', 'gravity', 'text_cipher') THEN 'standard' ELSE 'unknown' END AS diagnostic_subtype,
         CASE WHEN conv_id % 11 = 0 THEN false WHEN turn % 4 = 1 AND bits THEN false ELSE close END AS correct FROM t)"""


def _records(spark, sf_dir):
    own = _examples(spark, sf_dir)
    return evaluate.records(own, _predictions(own), _metadata(own))


@query(f"WITH {_RECORDS} SELECT id, category, question_type, question_type_display, diagnostic_subtype, source_mode, source, correct FROM r")
def eval_records(spark, sf_dir):
    """Examples joined to predictions and metadata by id."""
    return _records(spark, sf_dir).select("id", "category", "question_type", "question_type_display", "diagnostic_subtype", "source_mode", "source", "correct")


@query(f"""WITH {_RECORDS}, k AS (SELECT * FROM r)
  SELECT question_type, diagnostic_subtype, count(*) AS total, count(*) FILTER (correct) AS correct, (diagnostic_subtype IS NOT NULL)::INT AS level FROM k GROUP BY GROUPING SETS ((question_type, diagnostic_subtype), (question_type))""")
def eval_by_type(spark, sf_dir):
    own = _examples(spark, sf_dir)
    made = evaluate.evaluate(own, _predictions(own), _metadata(own))["by_type"]
    return made.select("question_type", "diagnostic_subtype", F.col("total").cast("long").alias("total"), F.col("correct").cast("long").alias("correct"), "level")


@query(f"""WITH {_RECORDS}, f AS (SELECT *, row_number() OVER (PARTITION BY question_type, diagnostic_subtype ORDER BY conv_id * 1000 + turn) AS place FROM r WHERE NOT correct)
  SELECT id, question_type || '/' || diagnostic_subtype AS folder, '0' || place || '_' || id AS stem FROM f WHERE place <= 3""")
def eval_failure_samples(spark, sf_dir):
    own = _examples(spark, sf_dir)
    return evaluate.evaluate(own, _predictions(own), _metadata(own))["failures"].select("id", "folder", "stem")


# --- preparation ------------------------------------------------------------------


def _type_rows(spark, sf_dir):
    """Documents as puzzle rows: the language stands for the category, the source for the source mode."""
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS id", "CASE lang WHEN 'en' THEN 'Gravity' WHEN 'fr' THEN 'Bit Manipulation' WHEN 'de' THEN 'Symbol Transform' ELSE 'Unlisted' END AS category",
        "if(source = 'src0', 'huikang_real_bit', source) AS source_mode", "concat('x/symbol_transform/', if(doc_id % 2 = 0, 'ba_dc_a', source)) AS source",
        "if(doc_id % 9 = 0, 'no', '') AS eval_eligible", "if(doc_id % 10 = 0, 'train_only', '') AS split_policy",
    )


_PREPARED = """b AS (
  SELECT doc_id::VARCHAR AS id, CASE lang WHEN 'en' THEN 'gravity' WHEN 'fr' THEN 'bit_manipulation' ELSE 'symbol_transform' END AS diagnostic_type,
         CASE WHEN source = 'src0' THEN 'huikang_real_bit' ELSE source END AS source_mode,
         CASE lang WHEN 'en' THEN 'standard' WHEN 'fr' THEN CASE WHEN source = 'src0' THEN 'huikang_real_rule_found' ELSE source END ELSE CASE WHEN doc_id % 2 = 0 THEN 'ba_dc' ELSE source END END AS diagnostic_subtype,
         doc_id % 9 = 0 AS barred, doc_id % 9 = 0 OR doc_id % 10 = 0 AS fixed FROM documents WHERE lang IN ('en', 'fr', 'de')),
q AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY fixed, diagnostic_type, diagnostic_subtype, source_mode ORDER BY md5('42:' || id), id) AS r FROM b WINDOW w AS (PARTITION BY fixed, diagnostic_type, diagnostic_subtype, source_mode)),
h AS (SELECT *, CASE WHEN n >= 10 THEN greatest(1, round_even(n * 0.1, 0)) WHEN n >= 4 THEN 1 ELSE 0 END::BIGINT AS g, CASE WHEN n IN (2, 3) THEN 1 WHEN n >= 10 THEN greatest(1, round_even(n * 0.1, 0)) WHEN n >= 4 THEN 1 ELSE 0 END::BIGINT AS e FROM q),
p AS (SELECT *, CASE WHEN fixed OR r <= n - e - g THEN 'sft_train' WHEN r <= n - g THEN 'eval_holdout' ELSE 'grpo_holdout' END AS split FROM h)"""


@query(f"WITH {_PREPARED} SELECT id, split, diagnostic_type, diagnostic_subtype, source_mode, CASE WHEN barred THEN 'false' ELSE 'true' END AS eval_eligible, CASE WHEN fixed THEN 'train_only' ELSE 'auto' END AS split_policy FROM p")
def prepare_splits(spark, sf_dir):
    return prepare.prepare(_type_rows(spark, sf_dir))["splits"]


@query(f"""WITH {_PREPARED}, x AS (
  SELECT diagnostic_type, 'split' AS "column", split AS value, NULL AS value2 FROM p UNION ALL SELECT diagnostic_type, 'source_mode', source_mode, NULL FROM p UNION ALL SELECT diagnostic_type, 'diagnostic_subtype', diagnostic_subtype, NULL FROM p
  UNION ALL SELECT diagnostic_type, 'eval_eligible', CASE WHEN barred THEN 'false' ELSE 'true' END, NULL FROM p UNION ALL SELECT diagnostic_type, 'split_policy', CASE WHEN fixed THEN 'train_only' ELSE 'auto' END, NULL FROM p
  UNION ALL SELECT diagnostic_type, 'split*diagnostic_subtype', split, diagnostic_subtype FROM p UNION ALL SELECT diagnostic_type, 'all', NULL, NULL FROM p)
  SELECT diagnostic_type, "column", value, value2, count(*) AS n FROM x GROUP BY ALL""")
def prepare_summary(spark, sf_dir):
    return prepare.prepare(_type_rows(spark, sf_dir))["summary"]


@query(f"WITH {_PREPARED} SELECT id, split FROM p")
def prepare_global_split(spark, sf_dir):
    return prepare.prepare(_type_rows(spark, sf_dir))["global_split"]


@query(f"""WITH {_PREPARED} SELECT 'all' AS counter, NULL AS value, count(*) AS n FROM documents UNION ALL SELECT 'source_mode', CASE WHEN source = 'src0' THEN 'huikang_real_bit' ELSE source END, count(*) FROM documents GROUP BY 2
  UNION ALL SELECT 'category', CASE lang WHEN 'en' THEN 'Gravity' WHEN 'fr' THEN 'Bit Manipulation' WHEN 'de' THEN 'Symbol Transform' ELSE 'Unlisted' END, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'split', split, count(*) FROM p GROUP BY 2""")
def manifest_counts(spark, sf_dir):
    rows = _type_rows(spark, sf_dir)
    return prepare.manifest_counts(rows, prepare.split_rows(prepare.typed(rows)))


# --- training rows ----------------------------------------------------------------


def _assigned(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr("CAST(doc_id + if(doc_id % 7 = 0, 1000000, 0) AS STRING) AS id", "if(quality = 1, 'sft_train', 'eval_holdout') AS split")


_ASSIGNED = "SELECT (doc_id + (doc_id % 7 = 0)::INT * 1000000)::VARCHAR AS id, CASE WHEN quality = 1 THEN 'sft_train' ELSE 'eval_holdout' END AS split FROM labels"


@query(f"""WITH a AS ({_ASSIGNED}), d AS (SELECT doc_id::VARCHAR AS id, doc_id % 9 <> 0 AS ok FROM documents UNION ALL SELECT doc_id::VARCHAR, true FROM documents WHERE doc_id % 50 = 3)
  SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) FILTER (ok) AS n_eligible, count(*) - count(DISTINCT id) AS n_duplicates,
    (SELECT count(DISTINCT id) FROM a WHERE split = 'sft_train' AND id NOT IN (SELECT id FROM d)) AS selected_missing,
    count(*) FILTER (ok AND id IN (SELECT id FROM a WHERE split = 'sft_train')) AS train_rows, count(*) FILTER (NOT ok AND id IN (SELECT id FROM a WHERE split = 'sft_train')) AS skipped_ineligible, 2 AS n_warnings FROM d""")
def train_preflight(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.selectExpr("CAST(doc_id AS STRING) AS id", "doc_id % 9 <> 0 AS eval_eligible").unionByName(docs.filter("doc_id % 50 = 3").selectExpr("CAST(doc_id AS STRING) AS id", "true AS eval_eligible"))
    made = training.preflight(rows, _assigned(spark, sf_dir), ["sft_train"], 32, 8)
    return made.select("n_rows", "n_ids", "n_eligible", "n_duplicates", "selected_missing", "train_rows", "skipped_ineligible", F.size("warnings").alias("n_warnings"))


@query(f"""SELECT doc_id::VARCHAR AS id, '<|im_start|>user' AS opens, lang AS label FROM documents WHERE doc_id % 9 <> 0 AND doc_id::VARCHAR IN (SELECT id FROM ({_ASSIGNED}) WHERE split = 'sft_train')""")
def grpo_prompts(spark, sf_dir):
    from lexforge.functions import render

    rows = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS id", "text AS prompt", "'1' AS answer", "lang AS category", "lang AS label", "doc_id % 9 <> 0 AS eval_eligible", "doc_id AS line_no")
    made = training.grpo_rows(rows, _assigned(spark, sf_dir), ["sft_train"])
    return made.select("id", F.substring_index(render.chat_text(F.col("prompt")), "\n", 1).alias("opens"), "label")


@query("SELECT event_id, user_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4)::BIGINT AS batch FROM events")
def batched_rows(spark, sf_dir):
    return training.batched(table(spark, sf_dir, "events").select("event_id", "user_id"), 4, ["user_id"], "event_id")


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 25")
def head_in_order(spark, sf_dir):
    return training.head(table(spark, sf_dir, "events").select("event_id"), 25, "event_id")


@query("SELECT p_partkey AS id, 1 AS phase, p_brand AS a, NULL AS b FROM part UNION ALL SELECT s_suppkey, 2, NULL, s_name FROM supplier")
def phase_concat(spark, sf_dir):
    first = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS a")
    return training.phases(first, table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS b")).select("id", "phase", "a", "b")


@query("SELECT user_id, len(list_filter(list_distinct(list(event_type)), lambda x: x NOT IN ('click', 'view'))) = 0 AS only_listed FROM events GROUP BY user_id")
def subset_test(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return own.select("user_id", training.subset(F.col("kinds"), F.array(F.lit("click"), F.lit("view"))).alias("only_listed"))
