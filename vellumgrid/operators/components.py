"""Connected components of an edge table by alternating large-star and small-star contraction.

Each round is two grouped minima and two joins, so no neighbourhood is ever gathered in one task;
rounds grow with the logarithm of the longest shortest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.storage import dealt, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(dealt(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Map every node that has an edge to the smallest node of its component.

    edges: columns u and v of one ordered type; loops, repeats, both directions and rows with a null are allowed
    (a null end is no edge). Returns (node, component), one row per node of a non-loop edge;
    nodes without one are their own component and are not listed.
    """
    now = write_table(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), name)
    before = None
    while True:
        now = write_table(_small_star(_large_star(now)), name)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
