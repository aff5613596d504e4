"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("m").alias("a"), "v").union(least.select(F.col("m").alias("a"), "u")).where("a <> v").toDF("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each linked node's component.

    `edges` has two bigint columns a and b without nulls; loops and repeats are
    allowed.  Each round is written to the shared folder, so lineage stays
    short; the number of rounds grows with the logarithm of the longest path.
    """
    edges = written(edges.toDF("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        star = written(_small_star(_large_star(edges).distinct()).distinct())
        now = star.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        drop_written(edges)
        edges = star
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select("a", "a").distinct())
        seen = now
