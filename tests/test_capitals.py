"""Capitals of letters whose capital Spark writes with several: stand-in predictions against their SQL."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.plans import catalogue
from tests import oracle


def test_capitals_keep_the_length(spark):
    said = ["Straße", "Über é", "ﬁn ᾳ", "", None]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, v string").select("i", text.capitals(F.col("v")).alias("x"))
    assert [r.x for r in rows.orderBy("i").collect()] == ["STRAẞE", "ÜBER É", "ﬁN ᾼ", "", None]


@pytest.mark.parametrize("name", ["extract_answer_cascade", "rewards_components", "score_by_category"])
def test_queries_on_such_texts(spark, tmp_path, name):
    said = ["groß", "Straße über", "plain"]
    rows = [(i, turn, "assistant", said[i % 3]) for i in range(6) for turn in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    oracle.compare(catalogue.QUERIES[name](spark, str(tmp_path)), oracle.connect(str(tmp_path)), catalogue.ORACLES[name])
