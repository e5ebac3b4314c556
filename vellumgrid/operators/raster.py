"""Raster steps on rasters as relations: one row (img, r, c) for each set cell, or (img, r, c, v) for values.

Neighbourhood steps are equi-joins on shifted cells, filters along rows or columns are windows partitioned by image and row, so an
image is spread over its rows. `img` columns may be any keys, named in `key`.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.operators.components import connected_components
from vellumgrid.storage import dealt, write_table

#: Fixed order of the eight neighbours, clockwise from above: bit k of a neighbourhood mask is neighbour k.
NEIGHBOURS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(dealt(b), a.columns, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(dealt(b), a.columns, "left_anti")


def full_grid(images: DataFrame, height: int, width: int) -> DataFrame:
    """All cells of each image, made in place by explode."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    return images.withColumn("r", rows).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def complement(cells: DataFrame, images: DataFrame, height: int, width: int) -> DataFrame:
    return difference(full_grid(images, height, width).select(*cells.columns), cells)


def marking_in_street(mark: DataFrame, line: DataFrame, edge: DataFrame, middle: DataFrame, seam: DataFrame) -> DataFrame:
    """(mark and (edge or middle)) or (line and edge and not seam)."""
    return union(intersection(mark, union(edge, middle)), difference(intersection(line, edge), seam))


def components(cells: DataFrame, key: str = "img", diagonal: bool = True) -> DataFrame:
    """Adds component, the smallest (r, c) of an 8-connected (or 4-connected) component as text r:c."""
    node = F.struct(F.col(key).alias("img"), F.col("r"), F.col("c"))
    steps = [(0, 1), (1, 0), *(((1, 1), (1, -1)) if diagonal else ())]
    shifted = cells.select(node.alias("u"), F.explode(F.array(*(F.struct(F.col(key).alias("img"), (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in steps))).alias("v"))
    edges = shifted.join(cells.select(node.alias("v")), "v", "left_semi").select("u", "v")
    found = connected_components(edges, "cells").select(F.col("node.img").alias(key), F.col("node.r").alias("r"), F.col("node.c").alias("c"), F.col("component").alias("top"))
    top = F.when(F.col("top").isNotNull(), F.concat_ws(":", "top.r", "top.c")).otherwise(F.concat_ws(":", "r", "c"))
    return cells.join(found, [key, "r", "c"], "left").withColumn("component", top).drop("top")


def fill_holes(cells: DataFrame, images: DataFrame, height: int, width: int, least: int, key: str = "img") -> DataFrame:
    """With every 4-connected part of the background under `least` cells filled."""
    parts = components(complement(cells, images, height, width), key, diagonal=False)
    small = parts.groupBy(key, "component").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return union(cells, parts.join(small, [key, "component"], "left_semi").select(*cells.columns))


def clear_border(cells: DataFrame, height: int, width: int) -> DataFrame:
    return cells.where(F.col("r").between(1, height - 2) & F.col("c").between(1, width - 2))


def shrink_by(cells: DataFrame, factor: int, key: str = "img") -> DataFrame:
    """Set where any cell of a block is set."""
    return cells.select(key, F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).distinct()


def _along(values: DataFrame, reach: int, step, key: str) -> DataFrame:
    """`step` over a window of 2 * reach + 1 cells along rows, then along columns; windows are cut at the border."""
    for across, along in (("r", "c"), ("c", "r")):
        w = Window.partitionBy(key, across).orderBy(along).rangeBetween(-reach, reach)
        values = values.withColumn("v", step("v").over(w))
    return values


def box_mean(values: DataFrame, reach: int, key: str = "img") -> DataFrame:
    """Mean over a square, of a dense grid of values (img, r, c, v)."""
    mean = values.withColumn("n", F.lit(1.0))
    for across, along in (("r", "c"), ("c", "r")):
        w = Window.partitionBy(key, across).orderBy(along).rangeBetween(-reach, reach)
        mean = mean.withColumns({"v": F.sum("v").over(w), "n": F.sum("n").over(w)})
    return mean.withColumn("v", F.col("v") / F.col("n")).drop("n")


def dilate(values: DataFrame, reach: int, key: str = "img") -> DataFrame:
    return _along(values, reach, F.max, key)


def erode(values: DataFrame, reach: int, key: str = "img") -> DataFrame:
    return _along(values, reach, F.min, key)


def opened(values: DataFrame, reach: int, key: str = "img") -> DataFrame:
    return dilate(erode(values, reach, key), reach, key)


def closed(values: DataFrame, reach: int, key: str = "img") -> DataFrame:
    return erode(dilate(values, reach, key), reach, key)


def adaptive_threshold(values: DataFrame, reach: int = 50, offset: float = 40.0, lightest: float = 200.0, key: str = "img") -> DataFrame:
    """Cells darker than the mean around them by more than an offset, but none lighter than a bound."""
    mean = box_mean(values.select(key, "r", "c", F.col("v").cast("double").alias("v")), reach, key).withColumnRenamed("v", "mean")
    return values.join(mean, [key, "r", "c"]).where((F.col("v") < F.col("mean") - offset) & (F.col("v") < lightest)).select(key, "r", "c")


def row_distance(grid: DataFrame, key: str = "img") -> DataFrame:
    """Adds d: distance along the row to the nearest set cell, null in a row without; grid: img, r, c, v (1 if set) for all cells."""
    left = Window.partitionBy(key, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy(key, "r").orderBy("c").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("v") == 1, F.col("c"))
    return grid.withColumn("d", F.least(F.col("c") - F.last(at, ignorenulls=True).over(left), F.first(at, ignorenulls=True).over(right) - F.col("c")))


def feature_transform(grid: DataFrame, key: str = "img") -> DataFrame:
    """(img, r, c, d2, fr, fc): squared distance to the nearest set cell and that cell; of equal ones the upper, then the left one.

    Along rows first (the nearest set column on each side), then each column looks at its rows: a join of an image's columns with
    themselves, height squared rows a column instead of cells squared.
    """
    w = Window.partitionBy(key, "r").orderBy("c")
    at = F.when(F.col("v") == 1, F.col("c"))
    before, after = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = grid.select(key, "r", "c", before.alias("b"), after.alias("a"))
    pick = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).when(F.col("c") - F.col("b") <= F.col("a") - F.col("c"), F.col("b")).otherwise(F.col("a"))
    near = near.select(key, "r", "c", pick.alias("fc"))
    other = near.where("fc is not null").select(key, F.col("r").alias("fr"), "c", "fc")
    pairs = near.select(key, "r", "c").join(dealt(other), [key, "c"])
    d2 = (F.col("r") - F.col("fr")) * (F.col("r") - F.col("fr")) + (F.col("c") - F.col("fc")) * (F.col("c") - F.col("fc"))
    best = pairs.groupBy(key, "r", "c").agg(F.min(F.struct(d2.alias("d2"), "fr", "fc")).alias("m"))
    return best.select(key, "r", "c", "m.d2", "m.fr", "m.fc")


def medial_axis(transform: DataFrame, gamma: float = 1.0, rule: str = "constant", key: str = "img") -> DataFrame:
    """Cells on the integer medial axis: the nearest cells of two neighbours (right, below) are far apart; the cell whose own
    middle test fails less is kept. rule: constant, linear or root, for how the bound grows with the distance."""
    out = None
    for dr, dc in ((0, 1), (1, 0)):
        b = transform.select(F.col(key), (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("fr").alias("gr"), F.col("fc").alias("gc"))
        j = transform.join(b, [key, "r", "c"])
        pr, pc = F.col("gr") - F.col("fr"), F.col("gc") - F.col("fc")
        spread = pr * pr + pc * pc
        sr, sc = F.col("gr") + F.col("fr") - (2 * F.col("r") + dr), F.col("gc") + F.col("fc") - (2 * F.col("c") + dc)
        side = pr * sr + pc * sc
        if rule == "constant":
            far = spread > gamma * gamma
        elif rule == "linear":
            far = spread > 0.25 * gamma * gamma * (sr * sr + sc * sc)
        else:
            far = spread > 2 * (dr * pr + dc * pc) + F.sqrt((sr * sr + sc * sc).cast("double")) + 1
        hit = j.where(far & (spread > 1))
        here = hit.where(side >= 0).select(key, "r", "c")
        there = hit.where(side <= 0).select(key, (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"))
        part = here.unionByName(there)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def neighbour_mask(cells: DataFrame, key: str = "img") -> DataFrame:
    """Adds mask, with bit k set if neighbour k is, to every set cell."""
    told = cells.select(key, F.explode(F.array(*(F.struct((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(1 << k).alias("bit")) for k, (dr, dc) in enumerate(NEIGHBOURS)))).alias("n")).select(key, "n.r", "n.c", "n.bit")
    mask = told.groupBy(key, "r", "c").agg(F.sum("bit").cast("int").alias("mask"))
    return cells.join(dealt(mask), [key, "r", "c"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def _bit(mask: Column, k: int) -> Column:
    return F.shiftright(mask, k).bitwiseAND(F.lit(1))


def turns(mask: Column) -> Column:
    """How often the circle of neighbours goes from unset to set."""
    return sum((((_bit(mask, k) == 0) & (_bit(mask, (k + 1) % 8) == 1)).cast("int") for k in range(8)), F.lit(0))


def thin_step(cells: DataFrame, second: bool, key: str = "img") -> DataFrame:
    """Cells left after one parallel half-step of thinning: those on two sides of the shape go if the shape stays connected."""
    m = neighbour_mask(cells, key)
    k = F.col("mask")
    up, right, down, left = (_bit(k, i) for i in (0, 2, 4, 6))
    open_sides = ((up * right * left == 0) & (up * down * left == 0)) if second else ((up * right * down == 0) & (right * down * left == 0))
    return m.where(~(F.bit_count(k).between(2, 6) & (turns(k) == 1) & open_sides)).select(*cells.columns)


def thinned(cells: DataFrame, most_rounds: int | None = None, key: str = "img") -> DataFrame:
    """Thinning by half-steps until nothing goes; raises if cells still go in the last of a given number of rounds."""
    now = write_table(cells, "thin")
    n = now.count()
    for _ in count() if most_rounds is None else range(most_rounds):
        now = write_table(thin_step(thin_step(now, False, key), True, key), "thin")
        left = now.count()
        if left == n:
            return now
        n = left
    raise ValueError(f"cells still went after {most_rounds} rounds of thinning")


def end_and_branch_points(cells: DataFrame, key: str = "img") -> DataFrame:
    """Adds kind to skeleton cells: end (one neighbour run of one or two cells), branch (three or more runs), inner."""
    m = neighbour_mask(cells, key)
    k = F.col("mask")
    kind = F.when((turns(k) <= 1) & (F.bit_count(k) <= 2), "end").when(turns(k) >= 3, "branch").otherwise("inner")
    return m.withColumn("kind", kind).drop("mask")


def grown(seeds: DataFrame, mask: DataFrame, rounds: int, key: str = "img") -> DataFrame:
    """(img, r, c, source): seeds (img, r, c, source) spread over mask cells, a ring of neighbours a round; the first to come keeps a
    cell, of those of one round the smallest source."""
    owned = write_table(seeds.groupBy(key, "r", "c").agg(F.min("source").alias("source")), "grown")
    front = owned
    for _ in range(rounds):
        around = front.select(key, "source", F.explode(F.array(*(F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in NEIGHBOURS))).alias("n")).select(key, "n.r", "n.c", "source")
        fresh = around.join(mask, [key, "r", "c"], "left_semi").join(owned, [key, "r", "c"], "left_anti").groupBy(key, "r", "c").agg(F.min("source").alias("source"))
        front = write_table(fresh, "front")
        if front.isEmpty():
            break
        owned = write_table(owned.unionByName(front), "grown")
    return owned


def in_polygon(points: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Points (x, y) inside of a polygon, by the number of edges to their right; points on a lower edge count as inside."""
    x, y = F.col("x"), F.col("y")
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 != y2:
            spans = (F.lit(min(y1, y2)) <= y) & (y < F.lit(max(y1, y2)))
            hits = hits + (spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).cast("int")
    return points.where(hits % 2 == 1)


def tight_box(cells: DataFrame, key: str = "img") -> DataFrame:
    """Cells moved so that each image begins at (0, 0)."""
    low = cells.groupBy(key).agg(F.min("r").alias("r0"), F.min("c").alias("c0"))
    return cells.join(low, key).withColumns({"r": F.col("r") - F.col("r0"), "c": F.col("c") - F.col("c0")}).select(*cells.columns)


def turned(cells: DataFrame, degrees: float, r0: float = 0.0, c0: float = 0.0) -> DataFrame:
    """Cells turned about a point, each to the nearest cell; cells that meet are one."""
    a = math.radians(degrees)
    dr, dc = F.col("r") - r0, F.col("c") - c0
    r = F.floor(r0 + dr * math.cos(a) - dc * math.sin(a) + 0.5).cast("int")
    c = F.floor(c0 + dr * math.sin(a) + dc * math.cos(a) + 0.5).cast("int")
    return cells.select(*(x for x in cells.columns if x not in ("r", "c")), r.alias("r"), c.alias("c")).distinct()


def sheared(cells: DataFrame, slope: float, height: int) -> DataFrame:
    """Rows moved sideways by slope, about the middle row."""
    return cells.withColumn("c", (F.col("c") + F.floor(slope * (F.col("r") - height / 2) + 0.5)).cast("int"))


def deskew_slope(cells: DataFrame, key: str = "img") -> DataFrame:
    """(img, slope): shear that makes the second moments of an image upright; 0 where rows don't vary."""
    return cells.groupBy(key).agg(F.coalesce(-F.try_divide(F.covar_pop("r", "c"), F.var_pop("r")), F.lit(0.0)).alias("slope"))


def centred(cells: DataFrame, height: int, width: int, key: str = "img") -> DataFrame:
    """Tight boxes set in the middle of a frame; what is over on the right and below falls off."""
    tight = tight_box(cells, key)
    size = tight.groupBy(key).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    move = lambda full, own: F.greatest(F.lit(0), F.floor((full - F.col(own)) / 2)).cast("int")
    placed = tight.join(size, key).withColumns({"r": F.col("r") + move(height, "h"), "c": F.col("c") + move(width, "w")})
    return placed.where((F.col("r") < height) & (F.col("c") < width)).select(*cells.columns)


def fitted(cells: DataFrame, side: int, key: str = "img") -> DataFrame:
    """Tight boxes scaled to fit a square, in its middle; each cell goes to one cell."""
    tight = tight_box(cells, key)
    size = tight.groupBy(key).agg((F.max(F.greatest("r", "c")) + 1).alias("n"))
    scaled = tight.join(size, key).withColumns({x: F.floor(F.col(x) * side / F.col("n")).cast("int") for x in ("r", "c")}).select(*cells.columns).distinct()
    return centred(scaled, side, side, key)


def grown_disks(skeleton: DataFrame, key: str = "img") -> DataFrame:
    """Cells within the radius of any skeleton cell (img, r, c, d2): the shape again from its skeleton."""
    reach = F.floor(F.sqrt(F.col("d2").cast("double"))).cast("int")
    steps = F.sequence(-reach, reach)
    around = F.flatten(F.transform(steps, lambda dr: F.transform(steps, lambda dc: F.struct(dr.alias("dr"), dc.alias("dc")))))
    spread = skeleton.select(key, "r", "c", "d2", F.explode(around).alias("o")).where(F.col("o.dr") * F.col("o.dr") + F.col("o.dc") * F.col("o.dc") < F.greatest("d2", F.lit(1)))
    return spread.select(key, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()


def nearest_source(cells: DataFrame, sources: DataFrame, reach: int) -> DataFrame:
    """(r, c, source, d2): the nearest source (r, c, source) of each cell within a reach; ties to the smaller source."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = F.flatten(F.transform(steps, lambda dr: F.transform(steps, lambda dc: F.struct(dr.alias("dr"), dc.alias("dc")))))
    spread = sources.select("source", F.col("r").alias("r0"), F.col("c").alias("c0"), F.explode(around).alias("o")).select("source", (F.col("r0") + F.col("o.dr")).alias("r"), (F.col("c0") + F.col("o.dc")).alias("c"), (F.col("o.dr") * F.col("o.dr") + F.col("o.dc") * F.col("o.dc")).alias("d2"))
    best = spread.where(F.col("d2") <= reach * reach).groupBy("r", "c").agg(F.min(F.struct("d2", "source")).alias("m"))
    return cells.join(best, ["r", "c"]).select("r", "c", "m.source", "m.d2")


def oriented_crop(cells: DataFrame, boxes: DataFrame, key: str = "img") -> DataFrame:
    """(key, r, c): set cells of an upright image of each box (key, x, y: the middle of its left side, ux, uy, width, height); cell (r, c)
    shows the cell c along and r less half the height across, cut to whole numbers."""
    size = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    out = boxes.where((F.col("width") >= 0.5) & (F.col("height") >= 0.5)).withColumns({"_h": size("height"), "_w": size("width")})
    out = out.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_h") - 1))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
    off = F.col("_r") - F.floor(F.col("_h") / 2)
    source = out.select(key, F.col("_r"), F.col("_c"), (F.col("y") + F.col("_c") * F.col("uy") + off * F.col("ux")).cast("int").alias("r"), (F.col("x") + F.col("_c") * F.col("ux") - off * F.col("uy")).cast("int").alias("c"))
    return source.join(cells.select(key, "r", "c").distinct(), [key, "r", "c"], "left_semi").select(key, F.col("_r").alias("r"), F.col("_c").alias("c"))


def splat(cells: DataFrame, x: float, y: float, ux: float, uy: float, key: str = "img") -> DataFrame:
    """Cells sent to a line's own coordinates (along, across) about a point, cut to whole numbers; cells that meet are one."""
    dx, dy = F.col("c") - x, F.col("r") - y
    return cells.select(key, (dy * ux - dx * uy).cast("int").alias("r"), (dx * ux + dy * uy).cast("int").alias("c")).distinct()


def by_middle(parts: DataFrame, key: str = "img") -> DataFrame:
    """(key, component, x, place): components from left to right by the mean of their columns, ties by name. parts: key, r, c, component."""
    mean = parts.groupBy(key, "component").agg(F.avg("c").alias("x"))
    return mean.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("x", "component")))


def extents_along(points: DataFrame, key: str = "img") -> DataFrame:
    """Of points (key, r, c, ux, uy: the group's direction): centroid, the least and greatest place along and across from it with the
    points there (first by (r, c)), width, height and the middle of the box."""
    c = F.col
    middle = points.groupBy(key).agg(F.avg("c").alias("mx"), F.avg("r").alias("my"))
    placed = points.join(middle, key).withColumns({"along": (c("c") - c("mx")) * c("ux") + (c("r") - c("my")) * c("uy"), "across": (c("r") - c("my")) * c("ux") - (c("c") - c("mx")) * c("uy")})
    out = []
    for name in ("along", "across"):
        exact = F.round(name, 9)
        out += [F.min(F.struct(exact.alias("v"), "r", "c")).alias(f"low_{name}"), F.min(F.struct((-exact).alias("v"), "r", "c")).alias(f"high_{name}")]
    found = placed.groupBy(key, "mx", "my", "ux", "uy").agg(*out)
    span = lambda n: -c(f"high_{n}.v") - c(f"low_{n}.v")
    at = lambda n: (c(f"low_{n}.v") - c(f"high_{n}.v")) / 2
    return found.withColumns({"width": span("along"), "height": span("across"), "box_x": c("mx") + at("along") * c("ux") - at("across") * c("uy"), "box_y": c("my") + at("along") * c("uy") + at("across") * c("ux")})
