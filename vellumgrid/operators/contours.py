"""Contours of figures as ordered boundaries.

A set cell has an edge to each neighbour across a side that isn't set. Directed so that the cell is on the right, each edge has one
successor, which the two cells ahead of it tell. So contours are rings of a relation and are ordered by pointer doubling: outer ones
turn right around the figure, those of holes turn left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.operators.linking import rank_lists
from vellumgrid.storage import write_table

#: Sides of a cell, 0 to 3: its upper, right, lower and left edge. (row, column) of the neighbour across it; the way along it with the
#: cell on the right; the corner it begins at.
ACROSS = ((-1, 0), (0, 1), (1, 0), (0, -1))
ALONG = ((0, 1), (1, 0), (0, -1), (-1, 0))
BEGIN = ((0, 0), (0, 1), (1, 1), (1, 0))


def _by_side(table: tuple[tuple[int, int], ...], axis: int, side: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x[axis]) for x in table)), side + 1)


def boundary(cells: DataFrame, key: str = "img") -> DataFrame:
    """(key, r, c, s): edges between a set cell and one that isn't. Repeated cells count once, rows with a null not at all."""
    own = cells.select(key, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).na.drop().distinct()
    sides = F.array(*(F.struct(F.lit(s).alias("s"), (F.col("r") + dr).alias("nr"), (F.col("c") + dc).alias("nc")) for s, (dr, dc) in enumerate(ACROSS)))
    other = own.select(*(F.col(c).alias(f"_{c}") for c in (key, "r", "c")))
    edges = own.select(key, "r", "c", F.inline(sides))
    return edges.join(other, (F.col(key) == F.col(f"_{key}")) & (F.col("nr") == F.col("_r")) & (F.col("nc") == F.col("_c")), "left_anti").select(key, "r", "c", "s")


def successors(edges: DataFrame, cells: DataFrame, diagonal: bool = True, key: str = "img") -> DataFrame:
    """(node, next) for edges: what follows is on the cell ahead on the left if that is set (and, unless `diagonal`, the one on the right too),
    else on the one ahead on the right if that is set, else on the next side of the same cell."""
    s = F.col("s")
    dr, dc, ar, ac = _by_side(ALONG, 0, s), _by_side(ALONG, 1, s), _by_side(ACROSS, 0, s), _by_side(ACROSS, 1, s)
    placed = edges.withColumns({"right_r": F.col("r") + dr, "right_c": F.col("c") + dc, "left_r": F.col("r") + dr + ar, "left_c": F.col("c") + dc + ac})
    own = cells.select(key, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).na.drop().distinct()
    for side in ("left", "right"):
        seen = own.select(*(F.col(c).alias(f"{side}_{n}_") for c, n in ((key, "k"), ("r", "r"), ("c", "c"))))
        placed = placed.join(seen, (F.col(key) == F.col(f"{side}_k_")) & (F.col(f"{side}_r") == F.col(f"{side}_r_")) & (F.col(f"{side}_c") == F.col(f"{side}_c_")), "left")
    left, right = F.col("left_k_").isNotNull(), F.col("right_k_").isNotNull()
    left = left if diagonal else left & right
    edge = lambda r, c, s: F.struct(F.col(key).alias("k"), r.cast("int").alias("r"), c.cast("int").alias("c"), s.cast("int").alias("s"))
    turned = lambda by: F.pmod(s + by, F.lit(4))
    follows = F.when(left, edge(F.col("left_r"), F.col("left_c"), turned(3))).when(right, edge(F.col("right_r"), F.col("right_c"), s)).otherwise(edge(F.col("r"), F.col("c"), turned(1)))
    return placed.select(edge(F.col("r"), F.col("c"), s).alias("node"), follows.alias("next"))


def trace_contours(cells: DataFrame, diagonal: bool = True, key: str = "img") -> DataFrame:
    """(key, contour_id, pos, r, c, x, y): every contour's cells in order with the corner (x, y) = (column, row) that each edge begins at.

    A contour begins at its first edge by (r, c, side), whose cell names it in reading order: contour_id is the rank of that edge among the
    image's contours. diagonal: cells that touch at a corner are of one figure. pos counts from 0 in the direction that has the figure on
    the right. A cell with several edges on a contour comes once for each. An image without a set cell has no row.
    """
    edges = write_table(boundary(cells, key), "edges")
    rings = write_table(rank_lists(successors(edges, cells, diagonal, key), "contours"), "contours")
    size = rings.groupBy("head").agg(F.count("*").alias("size"))
    named = size.withColumn("contour_id", F.row_number().over(Window.partitionBy("head.k").orderBy("head")) - 1)  # contours, not cells
    n = F.col("node")
    placed = rings.join(named, "head").withColumn("pos", F.pmod(F.col("size") - F.col("steps"), F.col("size")))
    return placed.select(
        n["k"].alias(key), F.col("contour_id").cast("long").alias("contour_id"), F.col("pos").cast("long").alias("pos"), n["r"].alias("r"), n["c"].alias("c"),
        (n["c"] + _by_side(BEGIN, 1, n["s"])).alias("x"), (n["r"] + _by_side(BEGIN, 0, n["s"])).alias("y"),
    )


def contour_areas(contours: DataFrame, key: str = "img") -> DataFrame:
    """(key, contour_id, n, area, hole): edges and enclosed area of each contour by the shoelace sum; the area of a hole is negative, so that
    the areas of an image sum to its set cells."""
    w = Window.partitionBy(key, "contour_id").orderBy("pos")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in "xy")
    doubled = contours.withColumn("cross", (F.col("x") * ny - nx * F.col("y")).cast("long"))
    found = doubled.groupBy(key, "contour_id").agg(F.count("*").alias("n"), F.expr("sum(cross) div 2").alias("area"))
    return found.withColumn("hole", F.col("area") < 0)
