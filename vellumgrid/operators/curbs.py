"""All evidence for a curb on each side of a long line, and the decision from it.

A long line's ends are the two vertices of its lines that lie farthest apart (the one farthest from the mean of all, then the
one farthest from that; ties to the smaller (x, y)). Its positive side is the one that the normal of the way between them points to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as g
from vellumgrid.operators import streets

#: Greatest length that counts, bonus of a branch and of a unit of length, penalty.
MOST_LENGTH, BRANCH_BONUS, LENGTH_BONUS, PENALTY = 60.0, 0.08, 0.005, 0.4
SIDES = ("p", "n")


def long_line_axes(lines: DataFrame) -> DataFrame:
    """(group_id, length, n_lines, x1, y1, x2, y2): each long line's length, number of lines and ends."""
    ends = lines.select("group_id", F.inline(F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in "12"))))
    middle = ends.groupBy(F.col("group_id").alias("_g")).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))

    def farthest(points: DataFrame, px: str, py: str) -> Column:
        # rounded, so that which of two equally far ends is taken doesn't hang on the order of sums
        d = F.round((F.col("x") - F.col(px)) * (F.col("x") - F.col(px)) + (F.col("y") - F.col(py)) * (F.col("y") - F.col(py)), 6)
        return F.min(F.struct((-d).alias("d"), "x", "y"))

    placed = ends.join(middle, F.col("group_id") == F.col("_g"))
    first = placed.groupBy(F.col("group_id").alias("_f")).agg(farthest(placed, "_mx", "_my").alias("a")).select("_f", F.col("a.x").alias("_ax"), F.col("a.y").alias("_ay"))
    seen = ends.join(first, F.col("group_id") == F.col("_f"))
    second = seen.groupBy("group_id").agg(farthest(seen, "_ax", "_ay").alias("b"), F.first("_ax").alias("x1"), F.first("_ay").alias("y1"))
    total = lines.groupBy(F.col("group_id").alias("_t")).agg(F.sum(g.Segment.named().length).alias("length"), F.count("*").alias("n_lines"))
    return second.join(total, F.col("group_id") == F.col("_t")).select("group_id", "length", "n_lines", "x1", "y1", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def corner_evidence(lines: DataFrame, most_length: float = MOST_LENGTH) -> DataFrame:
    """(group_id, branch_p, branch_n, end_p, end_n): what other long lines that meet this one say of its sides.

    lines: line_id, group_id, x1..y2. Lines meet where ends have equal whole coordinates. A line of another long line that leaves from an end of
    one of this one's lines is a branch, on the side that it leaves to, with the length of its long line up to most_length; branches on one
    side speak for the other. Where they are few or short on a side, its score is the bonus of the other side's, at most 1, less a third for
    its own; else it goes by the ratio, at most 1 - PENALTY. Without any branch both sides lose PENALTY; no score is under -1. At the
    two ends of the long line, lines to one side speak for the other in proportion to their length and against their own more; an end
    that no other line shares costs both sides half of PENALTY.
    """
    axes = long_line_axes(lines)
    end = lambda k: F.struct(g.truncated(F.col(f"x{k}")).alias("vx"), g.truncated(F.col(f"y{k}")).alias("vy"), *((F.col(f"{c}{3 - int(k)}") - F.col(f"{c}{k}")).alias(f"d{c}") for c in "xy"))
    ends = lines.select("line_id", "group_id", F.inline(F.array(end("1"), end("2"))))
    capped = axes.select(F.col("group_id").alias("_o"), F.least(F.lit(most_length), F.col("length")).alias("len"))
    other = ends.join(capped, F.col("group_id") == F.col("_o")).select("vx", "vy", F.col("group_id").alias("other"), F.col("dx").alias("ox"), F.col("dy").alias("oy"), "len")
    own = ends.select("group_id", "vx", "vy")
    axis = axes.select(F.col("group_id").alias("_a"), "x1", "y1", "x2", "y2")
    side = F.when(g.beside(g.Segment.named(), F.col("ox"), F.col("oy")), "p").otherwise("n")
    met = own.join(other, ["vx", "vy"]).where("group_id <> other").join(axis, F.col("group_id") == F.col("_a")).withColumn("side", side)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = met.groupBy("group_id").agg(*(F.count_if(F.col("side") == s).cast("double").alias(f"c{s}") for s in SIDES), *(zero(F.sum(F.when(F.col("side") == s, F.col("len")))).alias(f"l{s}") for s in SIDES))

    def branch(own_side: str, far_side: str) -> Column:
        n, cum, m, other_cum = F.col(f"c{own_side}"), F.col(f"l{own_side}"), F.col(f"c{far_side}"), F.col(f"l{far_side}")
        ahead = (other_cum - cum) * LENGTH_BONUS
        few = F.least(m * BRANCH_BONUS + ahead, F.lit(1.0)) - (n * BRANCH_BONUS / 3 + cum * LENGTH_BONUS / 3)
        many = F.least((F.try_divide(m, n) - 1) * BRANCH_BONUS + ahead, F.lit(1 - PENALTY)) - cum * LENGTH_BONUS / 3
        return F.greatest(F.when((n <= 1) | (cum < most_length), few).otherwise(many), F.lit(-1.0))

    branches = sums.select("group_id", branch("p", "n").alias("branch_p"), branch("n", "p").alias("branch_n"))
    # the long line's own ends, each vertex once
    tips = axes.select("group_id", F.explode(F.array_distinct(F.array(*(F.struct(g.truncated(F.col(f"x{k}")).alias("vx"), g.truncated(F.col(f"y{k}")).alias("vy")) for k in "12")))).alias("t")).select(F.col("group_id").alias("tip"), "t.vx", "t.vy")
    degree = ends.groupBy("vx", "vy").agg(F.count("*").alias("degree"))
    alone = tips.join(degree, ["vx", "vy"]).groupBy("tip").agg((F.count_if(F.col("degree") == 1) * (-PENALTY / 2)).alias("alone"))
    at_tip = tips.join(other, ["vx", "vy"]).where("tip <> other").join(axis, F.col("tip") == F.col("_a")).withColumn("side", side).withColumn("share", F.col("len") / most_length)
    pull = lambda s: F.sum(F.when(F.col("side") == s, -(0.5 + PENALTY) * F.col("share")).otherwise(0.5 * F.col("share")))
    corners = at_tip.groupBy(F.col("tip").alias("_c")).agg(pull("p").alias("end_p"), pull("n").alias("end_n"))
    found = axes.select("group_id").join(branches, "group_id", "left").join(alone, F.col("group_id") == F.col("tip"), "left").join(corners, F.col("group_id") == F.col("_c"), "left")
    none = F.lit(-PENALTY)
    return found.select("group_id", F.coalesce("branch_p", none).alias("branch_p"), F.coalesce("branch_n", none).alias("branch_n"), *((zero(F.col(f"end_{s}")) + zero(F.col("alone"))).alias(f"end_{s}") for s in SIDES))


def of_long_lines(lines: DataFrame, evidence: DataFrame, names: tuple[str, ...], most: float | None = None) -> DataFrame:
    """(group_id, <name>_p, <name>_n): evidence of lines (line_id, <name>_p, <name>_n) by their share of the long line's length; a line whose normal
    points to the other side of its long line has its sides changed. most: of a sum."""
    axes = long_line_axes(lines).select(F.col("group_id").alias("_a"), "length", *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    own = g.Segment.named()
    turned = ~g.beside(g.Segment.named("a_"), -own.dy, own.dx)
    rows = lines.select("line_id", "group_id", "x1", "y1", "x2", "y2").join(evidence, "line_id").join(axes, F.col("group_id") == F.col("_a")).withColumn("turned", turned)
    share = F.coalesce(F.try_divide(own.length, F.col("length")), F.lit(0.0))
    total = lambda n, a, b: F.sum(F.when(F.col("turned"), F.col(f"{n}_{b}")).otherwise(F.col(f"{n}_{a}")) * share)
    cap = (lambda c: c) if most is None else (lambda c: F.least(c, F.lit(most)))
    return rows.groupBy("group_id").agg(*(cap(total(n, a, b)).alias(f"{n}_{a}") for n in names for a, b in (SIDES, SIDES[::-1])))


def curb_features(lines: DataFrame, present: DataFrame, marks: DataFrame, flood: DataFrame, mask: DataFrame, gaps: DataFrame | None = None, most_length: float = MOST_LENGTH) -> DataFrame:
    """A row for each long line with all that `streets.curb_decision` weighs: length, gaps, and for both sides modern, branch, end, flood,
    marking and parallel. gaps: (group_id, gaps), pairs of its lines joined over a gap; without it every line but the first counts as one."""
    axes = long_line_axes(lines).select("group_id", "length", (F.col("n_lines") - 1).alias("jumps"))
    out = axes.join(streets.modern_evidence(lines, present), "group_id", "left")
    out = out.join(corner_evidence(lines, most_length), "group_id", "left")
    out = out.join(of_long_lines(lines, streets.flood_evidence(lines.select("line_id", "x1", "y1", "x2", "y2"), flood, mask), ("flood",)), "group_id", "left")
    out = out.join(of_long_lines(lines, streets.marking_evidence(lines, marks), ("marking",)), "group_id", "left")
    beside = streets.parallel_evidence(lines).select("group_id", F.col("parallel").alias("parallel_p"), F.col("parallel").alias("parallel_n"))
    out = out.join(beside, "group_id", "left")
    if gaps is None:
        return out.withColumnRenamed("jumps", "gaps")
    return out.drop("jumps").join(gaps.groupBy("group_id").agg(F.max("gaps").alias("gaps")), "group_id", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
