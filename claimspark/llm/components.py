"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import dropped, passing_shuffles, written


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _directed(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node that links reach) of every node of links (a, b).

    Nulls link nothing. Each round is written to the shared folder and replaces the one before it; rounds end when every node points at a root, which
    takes about as many as the logarithm of the number of nodes. Only a count reaches the driver.
    """
    edges = written(_directed(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    for _ in range(most_rounds):
        # done when edges are stars around local minima: no node is both a child and a parent, none has two parents
        with passing_shuffles(edges.sparkSession):
            parents = edges.select("b").distinct()
            chained = edges.join(parents.withColumnRenamed("b", "a"), "a", "left_semi").limit(1).count()
            twice = edges.groupBy("a").count().where("count > 1").limit(1).count()
        if not chained and not twice:
            break
        before, edges = edges, written(_small_star(_large_star(edges)), "edges")
        dropped(before)
    else:
        raise RuntimeError("components haven't settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
