"""Connected components of an edge table, by alternating large and small stars.

Every round replaces the edges by at most as many, so a component of any size
becomes a star around its least node in logarithmically many rounds.  No node's
neighbours are ever gathered: a round is two grouped minima and two joins, and
the edges of a node with a large share of them all are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .skew import dealt_join

def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node that occurs in ``edges`` (a, b).

    ``a`` and ``b`` are of one orderable type.  Loops and repeated edges are
    harmless, edges with a null end are ignored, an empty table gives none.
    """
    spark = edges.sparkSession
    current = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(_least_around(both, 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        small = _least_around(large, seen[0])
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.*").where("a != b").distinct(), "edges")
        now = _state(after)
        discard(spark, current, large)
        current = after
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _least_around(edges: DataFrame, total: int) -> DataFrame:
    """The edges with ``m``, the least of ``a`` and all its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    return dealt_join(edges, least, ["a"], "n", ["b"], total).drop("n")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
