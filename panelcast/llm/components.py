"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node among itself and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")  # a table, so that the join can split a hot node
    return both.join(least, "a").where("b > a").select("b", "m").toDF("a", "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them. ``edges`` run from the larger node (a) to the smaller (b)."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    back = edges.join(least, "a").where("b <> m").select("b", "m").union(least.select("a", "m"))
    return back.toDF("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge; label is the least node of its component.

    Each round is two groupings and two joins, written into the shared folder; rounds number about the logarithm of the nodes.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    sign = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == sign:
            break
        sign = (row[0], row[1])
        now = written(_small_star(written(_large_star(now), "large-star")), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
