"""Connected components of an edge table, by alternating stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnclean.llm.shared import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(least.select("a", F.col("m").alias("b"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the edges (a, b); the component is its smallest node.

    Nodes without an edge are not listed. No edges: no rows.
    """
    e = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = None
    while True:
        e = written(_small_star(_large_star(e)), "edges")
        now = e.agg(F.count("*").alias("n"), mark.alias("h")).first()
        if (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
