"""Connected components by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    to = down.join(least, "a")
    return to.where("b != m").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its least node) of every node of edges (a, b).

    Each round is a table in the shared folder; the rounds end when a round changes nothing, after about
    the logarithm of the longest path.  Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = written(edges.select("a", "b").where("a != b").distinct(), name)

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()

    before = state(edges)
    while True:
        edges = written(_large(edges).select(F.col("x").alias("a"), F.col("y").alias("b")).where("a != b").distinct(), name)
        edges = written(_small(edges).select(F.col("x").alias("a"), F.col("y").alias("b")).where("a != b").distinct(), name)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
