"""Connected components of a distributed edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import _shared


#: Edges of a file while there are few.
FILE_EDGES = 1 << 20


def _edges_and_open(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes keep them from being stars: with two smaller neighbours, or one and a larger one."""
    up, down = F.sum("up").alias("up"), F.sum("down").alias("down")
    ends = edges.selectExpr("a AS n", "1L AS up", "0L AS down").union(edges.selectExpr("b", "0L", "1L"))
    each = ends.groupBy("n").agg(up, down)
    row = each.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return row[0] or 0, row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Each node ``a`` of the edges (a, b) with the smallest node ``b`` it can reach.

    The smallest node of a component has no row of its own. Every round hangs a
    node's larger neighbours, then its smaller ones, on the smallest neighbour;
    the rounds grow with the logarithm of the longest path and end when only stars are left. A round's edges go to
    the shared folder, in a few files if they are few, and the round before is deleted. Hubs are reduced by a
    partial minimum, which is dealt once more, so that both sides of the joins are
    plain exchanges and adaptive execution can split one where a hub holds most rows.
    Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    now = _shared.materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    count, unsettled = _edges_and_open(now)
    while unsettled:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).repartition("a")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low")).repartition("a")
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        new = small.union(low.select("a", F.col("low").alias("b"))).distinct()
        files = max(spark.sparkContext.defaultParallelism, count // FILE_EDGES)
        new = _shared.materialize(new.repartition(files) if files < _shared.partitions(spark) else new, "edges")
        _shared.drop(now)
        now = new
        count, unsettled = _edges_and_open(now)
    _shared.free_shuffles(spark)
    return now
