"""Distance joins as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_cells(x_low: Column, y_low: Column, x_high: Column, y_high: Column, cell: float) -> Column:
    """Array of the cells (cx, cy) that a box meets."""
    at = lambda v: F.floor(v / cell).cast("int")
    xs, ys = F.sequence(at(x_low), at(x_high)), F.sequence(at(y_low), at(y_high))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def grid_join(left: DataFrame, right: DataFrame, box: tuple[str, str, str, str], other: tuple[str, str, str, str], reach: float, cell: float) -> DataFrame:
    """Pairs of rows whose boxes come within `reach` along each axis, every pair once; test the true distance after it.

    box, other: names of x_low, y_low, x_high, y_high on each side (no name may be on both sides). Rows with a null edge have no
    partner. The cell that reports a pair is the one with the lower corner of the boxes' common part, so nothing has to be made
    distinct. A cell is a join key: skewed cells are Spark's to split.
    """
    l_low_x, l_low_y, l_high_x, l_high_y = F.col(box[0]) - reach, F.col(box[1]) - reach, F.col(box[2]) + reach, F.col(box[3]) + reach
    r_low_x, r_low_y, r_high_x, r_high_y = (F.col(c) for c in other)
    here = left.withColumn("_cell", F.explode(box_cells(l_low_x, l_low_y, l_high_x, l_high_y, cell)))
    there = right.withColumn("_cell_", F.explode(box_cells(r_low_x, r_low_y, r_high_x, r_high_y, cell)))
    corner = F.struct(F.floor(F.greatest(l_low_x, r_low_x) / cell).cast("int").alias("cx"), F.floor(F.greatest(l_low_y, r_low_y) / cell).cast("int").alias("cy"))
    meets = (l_low_x <= r_high_x) & (r_low_x <= l_high_x) & (l_low_y <= r_high_y) & (r_low_y <= l_high_y)
    return here.join(there, (F.col("_cell") == F.col("_cell_")) & meets & (F.col("_cell") == corner)).drop("_cell", "_cell_")


def with_box(df: DataFrame, prefix: str) -> DataFrame:
    """Adds <prefix>x_low and so on from the ends <prefix>x1 and so on."""
    c = lambda n: F.col(f"{prefix}{n}")
    return df.withColumns({f"{prefix}x_low": F.least(c("x1"), c("x2")), f"{prefix}y_low": F.least(c("y1"), c("y2")), f"{prefix}x_high": F.greatest(c("x1"), c("x2")), f"{prefix}y_high": F.greatest(c("y1"), c("y2"))})


def box_names(prefix: str) -> tuple[str, str, str, str]:
    return tuple(f"{prefix}{n}" for n in ("x_low", "y_low", "x_high", "y_high"))
