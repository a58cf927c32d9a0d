"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches.

    A round is two hash aggregates (combined on the map side, so a node with
    very many edges costs one row per task) and two equi-joins.  The aggregates
    are written before they are joined, so AQE can split a node with very many
    edges.  Every round is written to the shared folder; nodes and edges never
    reach the driver, only a count and a checksum do.  Components that are not
    whole after ``most_rounds`` are an error, not a result.
    """
    now, seen = edges.select("u", "v").filter("u <> v"), None  # a frame of its own: the caller's table is not discarded
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "lowest")
        large = materialize(both.join(low, F.col("u") == F.col("n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), "lowest")
        hung = large.join(low, F.col("u") == F.col("n"))
        small = (
            hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        before, now = now, materialize(small, "components")
        for used in (before, large, low):
            discard(used)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not whole after {most_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
