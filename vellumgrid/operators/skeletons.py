"""Skeletons as graphs of chains between vertices, pruned until nothing changes.

vertices: vertex, x, y, d2 (squared distance to the border of the figure). chains: chain_id, u, v (vertices at its ends), n (cells).
Ids are unique over all images. Chains that meet two at a vertex are contracted to one by pointer doubling over the ends, so
chains of any number become one in rounds by its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.operators.linking import rank_lists
from vellumgrid.storage import dealt, write_table

#: Fixed values of twins: greatest difference of their lengths, and factor of the radius.
TWIN_DIFFERENCE, TWIN_FACTOR = 7, 1.4


def chain_ends(chains: DataFrame) -> DataFrame:
    """(e, other, chain_id, n, vertex): two rows for each chain; e is twice the chain's id, and one more at v."""
    e = lambda k, c: F.struct((F.col("chain_id") * 2 + k).alias("e"), (F.col("chain_id") * 2 + 1 - k).alias("other"), "chain_id", "n", F.col(c).alias("vertex"))
    return chains.select(F.inline(F.array(e(0, "u"), e(1, "v"))))


def degrees(chains: DataFrame) -> DataFrame:
    """(vertex, degree): ends of chains at each vertex; a chain that ends where it begins counts twice."""
    return chain_ends(chains).groupBy("vertex").agg(F.count("*").alias("degree"))


def free_chains(chains: DataFrame, vertices: DataFrame) -> DataFrame:
    """(chain_id, branch, span, radius, degree): chains from an end point to a branch point, their straight length and the radius there."""
    degree = degrees(chains)
    side = lambda c: vertices.join(dealt(degree), "vertex").select(F.col("vertex").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("x", "y", "d2", "degree")))
    both = chains.join(dealt(side("u")), "u").join(dealt(side("v")), "v")
    at_u = F.col("u_degree") >= 3
    pick = lambda x: F.when(at_u, F.col(f"u_{x}")).otherwise(F.col(f"v_{x}"))
    span = F.hypot(F.col("u_x") - F.col("v_x"), F.col("u_y") - F.col("v_y"))
    ends_free = (F.least("u_degree", "v_degree") == 1) & (F.greatest("u_degree", "v_degree") >= 3)
    return both.where(ends_free).select("chain_id", F.when(at_u, F.col("u")).otherwise(F.col("v")).alias("branch"), span.alias("span"), F.sqrt(pick("d2")).alias("radius"), pick("degree").alias("degree"))


def _inside(factor: float) -> Column:
    """A free chain hardly leaves the disk around its branch point."""
    return F.floor("span") <= F.ceil(F.col("radius") * factor)


def merged(chains: DataFrame) -> DataFrame:
    """Chains with those that meet two at a vertex joined; the joined one has the smallest id, all cells, and the outer vertices.

    A ring of such chains becomes one chain from its smallest vertex to itself. u is never over v.
    """
    ends = write_table(chain_ends(chains), "chain-ends")
    pairs = ends.groupBy("vertex").agg(F.count("*").alias("degree"), F.min("e").alias("a"), F.max("e").alias("b")).where((F.col("degree") == 2) & (F.floor(F.col("a") / 2) != F.floor(F.col("b") / 2)))
    partner = write_table(pairs.select(F.inline(F.array(F.struct(F.col("a").alias("_e"), F.col("b").alias("partner")), F.struct(F.col("b").alias("_e"), F.col("a").alias("partner"))))), "chain-pairs")
    walk = rank_lists(ends.join(dealt(partner), F.col("other") == F.col("_e"), "left").select(F.col("e").alias("node"), F.col("partner").alias("next")), "chains")
    nodes = walk.join(dealt(ends), F.col("node") == F.col("e"))
    lists = nodes.groupBy("head", "ring").agg(F.min("chain_id").alias("chain_id"), F.sum("n").alias("n"), F.min("vertex").alias("least"))
    # a path is walked both ways; each way ends at one of its outer vertices
    last = ends.select((F.col("other")).alias("_h"), F.col("vertex").alias("outer"))
    outer = lists.join(dealt(last), F.col("head") == F.col("_h")).withColumn("outer", F.when(F.col("ring"), F.col("least")).otherwise(F.col("outer")))
    return outer.groupBy("chain_id").agg(F.min("outer").alias("u"), F.max("outer").alias("v"), F.max("n").alias("n"))


def prune(chains: DataFrame, vertices: DataFrame, factor: float = 1.0) -> DataFrame:
    """(chain_id, u, v, n, rounds): chains left when no free one lies in the disk of its branch point any more.

    factor: of the radius, in the first round only. A round cuts, at every branch point, the shortest of its short free chains, ties by
    chain_id, as long as two chains are left there; then chains that meet two at a vertex are one, and their new ends are looked
    at in the next round. rounds: that cut something. Rows with a null are left out. An empty table gives none.
    """
    now = write_table(merged(chains.select("chain_id", "u", "v", "n").na.drop()), "chains")
    rounds = 0
    while True:
        short = free_chains(now, vertices).where(_inside(factor if rounds == 0 else 1.0))
        place = F.row_number().over(Window.partitionBy("branch").orderBy("span", "chain_id"))  # ways out of one point
        cut = write_table(short.withColumn("place", place).where(F.col("place") <= F.col("degree") - 2).select("chain_id"), "cut")
        if not cut.limit(1).count():
            return now.withColumn("rounds", F.lit(rounds))
        now = write_table(merged(now.join(dealt(cut), "chain_id", "left_anti")), "chains")
        rounds += 1


def prune_twins(chains: DataFrame, vertices: DataFrame, factor: float = TWIN_FACTOR, difference: int = TWIN_DIFFERENCE) -> DataFrame:
    """(chain_id, u, v, n) without twins: of each branch point the first two free chains by id, where both are about as long (raised to whole
    numbers) and one of them lies in the disk of the point widened by factor. Both go, and the point is an end from then on."""
    free = free_chains(chains, vertices).withColumn("inside", _inside(factor))
    place = F.row_number().over(Window.partitionBy("branch").orderBy("chain_id"))
    first = free.withColumn("place", place).where("place <= 2").groupBy("branch").agg(
        F.count("*").alias("n"), (F.max(F.ceil("span")) - F.min(F.ceil("span"))).alias("apart"), F.bool_or("inside").alias("inside"), F.collect_list("chain_id").alias("ids")
    )
    cut = first.where((F.col("n") == 2) & (F.col("apart") <= difference) & F.col("inside")).select(F.explode("ids").alias("chain_id"))
    return merged(chains.select("chain_id", "u", "v", "n").join(dealt(cut), "chain_id", "left_anti"))
