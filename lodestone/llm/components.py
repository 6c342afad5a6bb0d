"""Connected components over link tables by alternating large-star and small-star rounds; every round is a few hash shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, new_path, remove, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return join_hot(both, least, "a", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return join_hot(down, least, "a", n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link table (a long, b long).

    Links may repeat, point either way or be loops (a loop alone makes no row); an empty table gives an empty result.
    Both halves of a round are written to the shared folder, so lineage stays short, and go when the next one stands.  A hub's links meet their smallest
    neighbour by broadcast (join_hot).  The rounds grow with the logarithm of a component's diameter.
    """
    spark = edges.sparkSession
    path = new_path(spark, "links")
    now = written(_tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), path)
    mark = None
    for _ in range(most_rounds):
        sums = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (sums["n"], sums["h"]) == mark or sums["n"] == 0:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.union(now.select("b", "b").distinct().toDF("node", "component"))
        mark = (sums["n"], sums["h"])
        for star in (_large_star, _small_star):
            before, path = path, new_path(spark, "links")
            now = written(_tidy(star(now, sums["n"])), path)
            remove(spark, before)
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
