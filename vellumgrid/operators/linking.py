"""Lists and rings of linked rows, ranked by pointer doubling.

Every row knows the one after it at most. In each round a row learns what lies twice as far ahead from the row it has reached, so a
list of any length takes rounds by its logarithm, each one join on the key, and no list is ever gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.storage import dealt, write_table


def _doubled(now: DataFrame) -> DataFrame:
    """Every row with what the row it has reached knows."""
    there = now.select(*(F.col(c).alias(f"_{c}") for c in ("node", "ahead", "far", "least", "at", "last", "rest")))
    walks = F.col("last").isNull()
    less = walks & (F.col("_least") < F.col("least"))
    return now.join(dealt(there), walks & (F.col("ahead") == F.col("_node")), "left").select(
        "node",
        F.when(walks, F.col("_ahead")).alias("ahead"),
        F.when(walks, F.col("far") + F.col("_far")).otherwise(F.col("far")).alias("far"),
        F.when(less, F.col("_least")).otherwise(F.col("least")).alias("least"),
        F.when(less, F.col("far") + F.col("_at")).otherwise(F.col("at")).alias("at"),
        F.coalesce(less, F.lit(False)).alias("changed"),
        F.coalesce("last", "_last").alias("last"),
        F.coalesce("rest", F.col("far") + F.col("_rest")).alias("rest"),
    )


def rank_lists(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, head, steps, ring) of rows (node, next), one row per node.

    node: any ordered type, each node once; next: null at the end of a list, or a node. In a list, head is its last node; in a
    ring, its smallest one. steps: links from the node to its head. No node may be the next one of two; a next one that is no node of
    its own ends the list at its predecessor.
    """
    known = links.select(F.col("node").alias("_n"))
    first = links.select("node", "next").join(dealt(known), F.col("next") == F.col("_n"), "left")
    # ahead: reached so far, null past the end; far: links walked; least: the smallest node walked over, at `at` links from here
    now = write_table(first.select("node", F.col("_n").alias("ahead"), F.lit(1).cast("long").alias("far"), F.col("node").alias("least"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("changed")), name)
    # a list's last node, and links to it, once the end is in sight
    now = now.select("*", F.when(F.col("ahead").isNull(), F.col("node")).alias("last"), F.when(F.col("ahead").isNull(), F.lit(0).cast("long")).alias("rest"))
    while True:
        now = write_table(_doubled(_doubled(now)), name)
        # Rings are done when no window twice as long held a smaller node in the last step, for then windows cover them. Of a list that isn't done, there
        # is always a node that has reached one whose last node is known.
        if not now.where("last is null and changed").limit(1).count():
            ahead = now.where("last is not null").select(F.col("node").alias("_node"))
            if not now.where("last is null").join(dealt(ahead), F.col("ahead") == F.col("_node")).limit(1).count():
                break
    ring = F.col("last").isNull()
    return now.select("node", F.when(ring, F.col("least")).otherwise(F.col("last")).alias("head"), F.when(ring, F.col("at")).otherwise(F.col("rest")).alias("steps"), ring.alias("ring"))
