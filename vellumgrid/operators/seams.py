"""Streets carved along the seams at their edges: how high a street is, its best seam on each side, and the cells between.

A street (street_id, x1..y2) is looked at from its own line, on side p as it stands and on side n from its other end. Points across it
are sampled in columns along the line. Heights and samples are joins with the planes of the map; only the way of a seam through the
columns of one side, which depends on every column before, is followed in a kernel that takes many sides a batch. A side is at most
`search` high, so it is as large as its street is long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as g


@dataclass(frozen=True)
class Carving:
    """Fixed values of carving, in cells of the map unless said otherwise."""

    height_step: int = 20
    """Between samples of a street's height, along and across."""
    search: int = 500
    sample: int = 2
    """Between samples across."""
    wide: int = 250
    """For each so much of a street's length samples along are one further apart, up to most_apart."""
    most_apart: int = 6
    close: float = 70.0
    """Distance from the expected height at which a black cell counts half."""
    ratio: float = 1.7
    """Of the expected height, up to which a seam is looked for, and a tenth of search in any case."""
    inside: float = 0.05
    """For each cell of `sample`, by how much an outer way has to be better."""
    edge: int = 25
    """Samples below the seam that are edge."""
    good: float = 0.4
    """Share of a seam's columns that must be black for it to hold."""
    slack: int = 20
    """Past the expected height that a street without a good seam is filled."""


def _sides(streets: DataFrame, p: Carving) -> DataFrame:
    """(street_id, side, x1..y2, width, apart, columns): both sides of each street, side n from its other end."""
    both = F.array(F.struct(F.lit("p").alias("side"), "x1", "y1", "x2", "y2"), F.struct(F.lit("n").alias("side"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")))
    sides = streets.select("street_id", F.inline(both)).withColumn("width", g.Segment.named().length)
    apart = 1 + F.least(F.lit(p.most_apart), F.floor(F.col("width") / p.wide).cast("int"))
    return sides.withColumn("apart", apart).withColumn("columns", F.floor(F.col("width") / F.col("apart")).cast("int")).where("columns > 0")


def _cell(along: Column, off: Column) -> tuple[Column, Column]:
    """(r, c) of a point along and off a side."""
    x, y = g.from_end(g.Segment.named(), along, off)
    return y.cast("int"), x.cast("int")


def street_heights(sides: DataFrame, area: DataFrame, p: Carving = Carving()) -> DataFrame:
    """(street_id, side, heights): at each sample along a side, how far across the street's area (cells r, c) goes: the first sample off it after
    one on it; search if it doesn't end, 0 if it doesn't begin."""
    n, levels = F.floor(F.col("width") / p.height_step).cast("int"), p.search // p.height_step
    at = sides.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    r, c = _cell(F.col("k") * float(p.height_step), F.col("j") * float(p.height_step))
    on = area.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(True).alias("on")).distinct()
    seen = at.select("street_id", "side", "k", "j", r.alias("r"), c.alias("c")).join(on, ["r", "c"], "left")
    marks = seen.groupBy("street_id", "side", "k").agg(F.min(F.when(F.col("on"), F.col("j"))).alias("first"), F.collect_set(F.when(F.col("on").isNull(), F.col("j"))).alias("off"))  # a level each
    end = F.array_min(F.filter("off", lambda j: j > F.col("first")))
    height = F.when(F.col("first").isNull(), 0).otherwise(F.coalesce(end * p.height_step, F.lit(p.search)))
    return marks.select("street_id", "side", "k", height.alias("height")).groupBy("street_id", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "height"))), lambda x: x["height"]).alias("heights"))


def _height_at(x: Column) -> Column:
    """Expected height of a column from the samples of its side; 0 where a side is too short for a sample."""
    return F.coalesce(F.get("heights", F.floor(x * F.size("heights") / F.col("columns")).cast("int")), F.lit(0))


def follow(limits: np.ndarray, gains: list[tuple[int, int, float]], levels: int, inside: float) -> tuple[np.ndarray, int]:
    """The seam with the greatest sum of gains, a level a column, and the columns of it that gained.

    A step from column to column is one level at most; levels from the second to below limits[column] take part, the rest hold 0. From
    the last column back, the inner way is taken unless an outer one is better by `inside` a level.
    """
    n = len(limits)
    energy = np.zeros((n, levels))
    gain = np.zeros((n, levels))
    for x, y, v in gains:
        gain[x, y] = v
    for x in range(1, n):
        before, top = energy[x - 1], int(limits[x])
        best = np.maximum(np.maximum(before[:-2], before[1:-1]), before[2:])
        energy[x, 1:top] = best[: max(0, top - 1)] + gain[x, 1:top]
    at = 1 + int(energy[-1, 1:-1].argmax())
    last, count = energy[-1, at], 0
    seam = np.zeros(n, np.int64)
    for x in range(n - 1, 0, -1):
        seam[x] = at
        low, same, high = energy[x - 1, at - 1 : at + 2]
        if low + inside > same and low + 2 * inside > high:
            at -= 1
        elif same + inside <= high:
            at += 1
        most = max(low, same, high)
        count += most + 0.01 < last
        last = most
        at = min(max(at, 1), levels - 2)
    seam[0] = at
    return seam, count


def find_seams(streets: DataFrame, area: DataFrame, black: DataFrame, p: Carving = Carving()) -> DataFrame:
    """(street_id, side, x1..y2, apart, columns, heights, seam, good): the seam of each side as a sample number for each column."""
    sides = _sides(streets, p)
    with_heights = sides.join(street_heights(sides, area, p), ["street_id", "side"], "left").withColumn("heights", F.coalesce("heights", F.array().cast("array<int>")))
    levels = p.search // p.sample
    x, y = F.col("x"), F.col("y")
    # of a column, samples up to the ratio of its height or a tenth of the search
    reach = F.greatest(F.floor(_height_at(x) * p.ratio / p.sample), F.floor(F.lit(p.search / 10) / p.sample)).cast("int")
    limit = lambda x: F.least(F.greatest(F.floor(_height_at(x) * p.ratio / p.sample), F.floor(F.lit(p.search / 10) / p.sample)).cast("int") + 1, F.lit(levels - 1))
    columns = with_heights.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("height", _height_at(x))
    tries = columns.where("x > 0").withColumn("y", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(reach, F.lit(levels - 2))))))
    r, c = _cell(x * F.col("apart").cast("double"), y * float(p.sample))
    weight = 1 / (F.abs(y * p.sample - F.col("height")) / p.close + 1)
    dark = black.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct()
    hits = tries.select("street_id", "side", "x", "y", weight.alias("v"), r.alias("r"), c.alias("c")).join(dark, ["r", "c"], "left_semi")
    gains = hits.groupBy("street_id", "side").agg(F.collect_list(F.struct("x", "y", "v")).alias("gains"))
    limits = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), limit)
    own = with_heights.withColumn("limits", limits).join(gains, ["street_id", "side"], "left")
    names = ("street_id", "side", "x1", "y1", "x2", "y2", "apart", "columns", "heights")
    rows = own.select(*names, "limits", "gains")
    schema = own.select(*names, F.array().cast("array<long>").alias("seam"), F.lit(True).alias("good")).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seam, good = [], []
            for limits, gains in zip(batch.column("limits").to_pylist(), batch.column("gains").to_pylist()):
                found, count = follow(np.array(limits), [(g["x"], g["y"], g["v"]) for g in gains or ()], levels, p.inside * p.sample)
                seam.append(found)
                good.append(count > p.good * len(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seam, pa.list_(pa.int64())), pa.array(good, pa.bool_())], names=[*names, "seam", "good"])

    return rows.mapInArrow(kernel, schema)


def carve(found: DataFrame, p: Carving = Carving()) -> DataFrame:
    """(street_id, zone, r, c, distance): cells of streets from their seams: middle, edge (the last samples below a good seam) and seam; a
    side without a good seam is middle up to its height and some more. distance: the least sample number at which a cell is met, and 0.01."""
    columns = found.select("*", F.posexplode("seam").alias("x", "s")).withColumn("height", _height_at(F.col("x")))
    low, s = F.greatest(F.lit(0), F.col("s") - p.edge), F.col("s")
    middle = F.greatest(F.least(low, s), F.when(~F.col("good"), F.col("height") + p.slack // p.sample).otherwise(0))
    top = F.least(middle, F.lit(p.search // p.sample)).cast("int")
    upto = lambda a, b: F.when(b > a, F.sequence(a.cast("int"), (b - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    edge = F.when(F.col("good"), upto(low, F.least(s - 1, F.lit(p.search // p.sample)))).otherwise(F.array().cast("array<int>"))
    seam = F.when(F.col("good"), F.array(s.cast("int"))).otherwise(F.array().cast("array<int>"))
    zones = F.array(*(F.struct(F.lit(n).alias("zone"), a.alias("ys")) for n, a in (("middle", upto(F.lit(0), top)), ("edge", edge), ("seam", seam))))
    cells = columns.select("street_id", "x1", "y1", "x2", "y2", "apart", "x", F.inline(zones)).withColumn("y", F.explode("ys"))
    r, c = _cell(F.col("x") * F.col("apart").cast("double"), F.col("y") * float(p.sample))
    return cells.select("street_id", "zone", r.alias("r"), c.alias("c"), "y").groupBy("street_id", "zone", "r", "c").agg((F.min("y") + 0.01).alias("distance"))
