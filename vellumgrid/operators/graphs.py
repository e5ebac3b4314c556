"""Lines as graphs, ways around a vertex, and rules on skeleton graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as g
from vellumgrid.operators.gridjoin import grid_join
from vellumgrid.operators.raster import NEIGHBOURS, neighbour_mask


def graph_of_lines(lines: DataFrame) -> DataFrame:
    """(line_id, v1, v2): the vertices of lines (line_id, x1..y2), which ends with equal whole coordinates share.

    A vertex is numbered by the smallest of its ends: twice the line's id, and one more at its second end.
    """
    ends = lines.select("line_id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), g.truncated(F.col(f"x{k + 1}")).alias("x"), g.truncated(F.col(f"y{k + 1}")).alias("y")) for k in (0, 1)))).alias("e")).select("line_id", "e.*")
    named = ends.groupBy("x", "y").agg(F.min(2 * F.col("line_id") + F.col("k")).alias("vertex"))
    return ends.join(named, ["x", "y"]).groupBy("line_id").agg(F.max(F.when(F.col("k") == 0, F.col("vertex"))).alias("v1"), F.max(F.when(F.col("k") == 1, F.col("vertex"))).alias("v2"))


def alone(lines: DataFrame) -> DataFrame:
    """Adds group_id and vertex, with which matching begins: each line is a group of its own and meets a vertex that no other has."""
    return lines.withColumns({"group_id": F.col("line_id"), "vertex": -F.col("line_id") - 1})


def in_order(lines: DataFrame, starts: DataFrame, key: str = "group_id") -> DataFrame:
    """Adds pos to the lines of a polyline: by the distance of their nearer end to where it begins (key, x, y), ties by line_id."""
    s, x, y = g.Segment.named(), F.col("_x"), F.col("_y")
    near = F.least(*((a - x) * (a - x) + (b - y) * (b - y) for a, b in s.ends))
    joined = lines.join(starts.select(key, F.col("x").alias("_x"), F.col("y").alias("_y")), key).withColumn("_near", near)
    return joined.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("_near", "line_id"))).drop("_x", "_y", "_near")


def around(ways: DataFrame, key: str = "branch") -> DataFrame:
    """Adds turn, the place of each way (key, way, dx, dy) around its branch by angle, ties by way."""
    return ways.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(F.atan2("dy", "dx"), "way")))


def farthest_pair(ways: DataFrame, key: str = "branch") -> DataFrame:
    """(key, a, b): the two ways out of a branch whose directions are farthest apart, ties to smaller (a, b). A branch has few ways."""
    n = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    unit = ways.where(n > 0).select(key, F.col("way"), (F.col("dx") / n).alias("u"), (F.col("dy") / n).alias("v"))
    a, b = (unit.select(key, *(F.col(c).alias(f"{k}_{c}") for c in ("way", "u", "v"))) for k in "ab")
    c = F.col
    apart = F.round((c("a_u") - c("b_u")) * (c("a_u") - c("b_u")) + (c("a_v") - c("b_v")) * (c("a_v") - c("b_v")), 9)
    pairs = a.join(b, key).where("a_way < b_way").select(key, F.struct(-apart, "a_way", "b_way").alias("p"))
    return pairs.groupBy(key).agg(F.min("p").alias("p")).select(key, F.col("p.a_way").alias("a"), F.col("p.b_way").alias("b"))


def within_disks(points: DataFrame, most_radius: float, key: str = "img") -> DataFrame:
    """(key, a, b): branch points b in the maximal disk of a, itself included. points: key, point_id, x, y, d2 (squared distance to the border).

    Distances are cut to whole numbers, radii raised to them; most_radius bounds all radii.
    """
    c = F.col
    a = points.select(key, c("point_id").alias("a"), c("x").alias("ax"), c("y").alias("ay"), F.ceil(F.sqrt("d2")).alias("radius"))
    b = points.select(c(key).alias("_key"), c("point_id").alias("b"), c("x").alias("bx"), c("y").alias("by"))
    near = grid_join(a, b, ("ax", "ay", "ax", "ay"), ("bx", "by", "bx", "by"), most_radius + 1, 2 * (most_radius + 1)).where(c(key) == c("_key"))
    return near.where(F.floor(F.sqrt((c("ax") - c("bx")) * (c("ax") - c("bx")) + (c("ay") - c("by")) * (c("ay") - c("by")))) <= c("radius")).select(key, "a", "b")


def ends_of_branches(ends: DataFrame, least: int = 2) -> DataFrame:
    """(branch, ends): the sorted end points that reach a branch point, where there are enough. ends: end, branch."""
    return ends.groupBy("branch").agg(F.sort_array(F.collect_list("end")).alias("ends")).where(F.size("ends") >= least)


def open_circle(cells: DataFrame, least: int = 6, key: str = "img") -> DataFrame:
    """Adds is_end: whether at least so many neighbours in a row around a cell are unset."""
    bits = "".join
    mask = neighbour_mask(cells, key)
    circle = F.concat(*(F.when(F.shiftright("mask", k).bitwiseAND(F.lit(1)) == 1, "1").otherwise("0") for k in [*range(8), *range(least - 1)]))
    return mask.withColumn("is_end", F.contains(circle, F.lit(bits("0" for _ in range(least))))).drop("mask")


def contour_axis(labels: DataFrame, key: str = "img") -> DataFrame:
    """Cells (key, r, c) whose right or lower neighbour is nearest to another contour. labels: key, r, c, label of the nearest contour."""
    here = labels.select(key, "r", "c", "label")
    right, below = (here.select(key, (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("label").alias(n)) for dr, dc, n in ((0, 1, "right"), (1, 0, "below")))
    other = lambda n: F.coalesce(F.col(n) != F.col("label"), F.lit(False))
    return here.join(right, [key, "r", "c"], "left").join(below, [key, "r", "c"], "left").where(other("right") | other("below")).select(key, "r", "c")


def cut_branches(chains: DataFrame, factor: float = 1.0) -> DataFrame:
    """Chains (chain_id, length, radius at the branch point, has_end) without those that end freely and hardly leave the disk of their
    branch point: one round of pruning."""
    return chains.where(~(F.col("has_end") & (F.floor("length") <= F.ceil(F.col("radius") * factor))))


def by_length(chains: DataFrame, key: str = "img") -> DataFrame:
    """Adds importance: chains of an image from the shortest, ties by chain_id."""
    return chains.withColumn("importance", F.row_number().over(Window.partitionBy(key).orderBy("length", "chain_id")))


def owners(strips: DataFrame) -> DataFrame:
    """(r, c, street_id, distance): of streets whose strips (street_id, width, r, c, distance) hold a cell, the longest one, ties to the
    smaller id; the distance is the least of all."""
    best = F.min(F.struct(-F.col("width"), "street_id"))
    return strips.groupBy("r", "c").agg(best.alias("b"), F.min("distance").alias("distance")).select("r", "c", F.col("b.street_id").alias("street_id"), "distance")
