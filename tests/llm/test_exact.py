import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexforge.llm import exact, queries
from tests import oracle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(rows):
    sets = {}
    for place, (i, text) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        sets.setdefault(body, []).append((-len(text or ""), i is not None, i or 0, place))
    out = []
    for body, members in sets.items():
        best = min(members)
        for m in members:
            keep = rows[best[3]][0]
            out.append((rows[m[3]][0], keep, len(members), m == best, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_white_space_ties_and_odd_rows(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a b"), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r"), (None, "ab "), (None, "a b"), (9, "é"), (10, "é")]
    rows += [(11, "same"), (11, "same"), (11, "same"), (12, "x" * 300_000), (13, "x" * 299_999 + " x"), (14, "x" * 299_999 + "y")]
    found = got(exact.groups(spark.createDataFrame(rows, SCHEMA)))
    assert found == brute(rows)
    assert sum(r[3] for r in found if r[0] == 11) == 1


def test_query_matches_its_sql(spark):
    oracle.compare(queries.op12_exact(spark, SF), oracle.connect(SF), queries.ORACLES["op12_exact"])


def test_empty_table(spark):
    assert exact.groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("partitions", ["2", "13"])
def test_hot_groups_are_cut_over_partitions(spark, partitions):
    """A third of all rows are copies of one text, and a third share a long beginning."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        head = "the same beginning of very many texts "
        text = rng.choice(["one text", "one  text", "onetext"]) if i % 3 == 0 else head + str(rng.randint(0, 150)) if i % 3 == 1 else str(rng.randint(0, 400))
        rows.append((i if rng.random() > 0.05 else None, text))
    rows += [(5000, "again")] * 200
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
        sizes = [r["count"] for r in exact._sorted(docs, "doc_id", "text", ()).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == int(partitions) and max(sizes) < 2.5 * len(rows) / int(partitions)
        assert got(exact.groups(docs)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_batches_compare_across_their_ends(spark):
    rows = [(i, "ab"[i % 2] * (1 + i % 5)) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(exact.groups(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_stay_whole_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x y", "p", 1), (2, "xy", "q", 2), (3, "z", None, 3)], "doc_id long, text string, row string, `edge.kept` int")
    stays = exact.drop_copies(docs)
    assert stays.columns == docs.columns
    assert sorted(tuple(r) for r in stays.collect()) == [(1, "x y", "p", 1), (3, "z", None, 3)]
