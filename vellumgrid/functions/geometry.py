"""Plane geometry as column expressions over flat coordinates x1, y1, x2, y2 (double)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Segment:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def named(cls, prefix: str = "", suffix: str = "") -> Segment:
        """From columns such as h_x1 or x1_h."""
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def dx(self) -> Column:
        return self.x2 - self.x1

    @property
    def dy(self) -> Column:
        return self.y2 - self.y1

    @property
    def length(self) -> Column:
        return F.sqrt(self.dx * self.dx + self.dy * self.dy)

    @property
    def ends(self) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
        return (self.x1, self.y1), (self.x2, self.y2)

    def extended(self, times: float) -> Segment:
        """Longer by `times` its length at both ends."""
        return Segment(self.x1 - times * self.dx, self.y1 - times * self.dy, self.x2 + times * self.dx, self.y2 + times * self.dy)


def truncated(x: Column) -> Column:
    """Toward zero, as a cast to a whole number does."""
    return x.cast("long")


def midpoint(s: Segment) -> tuple[Column, Column]:
    """Of whole coordinates, halves dropped toward zero."""
    return truncated((s.x1 + s.x2) / 2), truncated((s.y1 + s.y2) / 2)


def folded_degrees(radians: Column) -> Column:
    """Degrees in 0 to 90; from 90 on, what is left to 180."""
    d = radians * 180 / math.pi
    return F.when(d >= 90, 180 - d).otherwise(d)


def angle(a: Segment, b: Segment) -> Column:
    """Between two segments in degrees; null if one has no length. A cosine beyond 1 by rounding is 0 degrees."""
    cosine = F.try_divide(a.dx * b.dx + a.dy * b.dy, a.length * b.length)
    return F.when(cosine > 1, F.lit(0.0)).when(cosine.isNotNull(), folded_degrees(F.acos(F.greatest(cosine, F.lit(-1.0)))))


def within_angle(a: Segment, b: Segment, degrees: float) -> Column:
    """True wherever the angle is under `degrees`, and hardly elsewhere: products only, to stand before dearer tests."""
    least = max(0.0, math.cos(math.radians(min(degrees, 90.0)))) ** 2 - 1e-9
    dot = a.dx * b.dx + a.dy * b.dy
    return dot * dot >= least * (a.dx * a.dx + a.dy * a.dy) * (b.dx * b.dx + b.dy * b.dy)


def box_gap(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Distance of two boxes along the axis where they are farther apart, from names of x_low, y_low, x_high, y_high; no more than
    the distance of what they hold."""
    c = F.col
    return F.greatest(F.lit(0.0), c(b[0]) - c(a[2]), c(a[0]) - c(b[2]), c(b[1]) - c(a[3]), c(a[1]) - c(b[3]))


def intersect(a: Segment, b: Segment, strict: bool = False) -> Column:
    """Whether two segments cross. By default only for one sense of turning; `strict` knows both."""
    delta = b.dx * a.dy - b.dy * a.dx
    s = F.try_divide(a.dx * (b.y1 - a.y1) + a.dy * (a.x1 - b.x1), delta)
    t = F.try_divide(b.dx * (a.y1 - b.y1) + b.dy * (b.x1 - a.x1), -delta)
    enough = F.abs(delta) >= 0.0001 if strict else delta >= 0.0001
    return F.coalesce(enough & s.between(0, 1) & t.between(0, 1), F.lit(False))


def along(x: Column, y: Column, s: Segment) -> Column:
    """Where a point falls on a segment: 0 at the first end, 1 at the second. On a point, the distance to it."""
    square = s.dx * s.dx + s.dy * s.dy
    at = F.try_divide((x - s.x1) * s.dx + (y - s.y1) * s.dy, square)
    return F.when(square == 0, F.sqrt((x - s.x1) * (x - s.x1) + (y - s.y1) * (y - s.y1))).otherwise(at)


def point_distance(x: Column, y: Column, s: Segment) -> Column:
    square = s.dx * s.dx + s.dy * s.dy
    t = F.coalesce(F.try_divide((x - s.x1) * s.dx + (y - s.y1) * s.dy, square), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    u, v = x - (s.x1 + t * s.dx), y - (s.y1 + t * s.dy)
    return F.sqrt(u * u + v * v)


def distance(a: Segment, b: Segment, strict: bool = False) -> Column:
    ends = [point_distance(x, y, b) for x, y in a.ends] + [point_distance(x, y, a) for x, y in b.ends]
    return F.when(intersect(a, b, strict), F.lit(0.0)).otherwise(F.least(*ends))


def extended_distance(a: Segment, b: Segment, times: float = 3.0) -> Column:
    """From the longer first segment to the second."""
    return distance(a.extended(times), b)


def overshoot(a: Segment, b: Segment) -> Column:
    """How far all of b falls beyond an end of a, in lengths of a; 0 if it does not."""
    p, q = (along(x, y, a) for x, y in b.ends)
    return F.greatest(F.lit(0.0), F.least(p, q) - 1, -F.greatest(p, q))


def measured(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds angle, distance, over_ab (how far b is beyond a) and over_ba to pairs of segments <a>x1 and so on, <b>x1 and so on.

    The same values as `angle`, `distance` and `overshoot`. Each step names what the next ones use, so that a pair is worked out once; a
    filter on these columns would be pushed below the steps and repeat them, so test them inside of an aggregate.
    """
    s, t = Segment.named(a), Segment.named(b)
    c = F.col
    steps = pairs.withColumns({"_ax": s.dx, "_ay": s.dy, "_bx": t.dx, "_by": t.dy})
    steps = steps.withColumns({"_aa": c("_ax") * c("_ax") + c("_ay") * c("_ay"), "_bb": c("_bx") * c("_bx") + c("_by") * c("_by"), "_delta": c("_bx") * c("_ay") - c("_by") * c("_ax")})
    project = lambda x, y, one, k: (x - one.x1) * c(f"_{k}x") + (y - one.y1) * c(f"_{k}y")
    steps = steps.withColumns(
        {f"_{k}{n}": F.try_divide(project(x, y, one, k), c(f"_{k}{k}")) for k, one, two in (("a", s, t), ("b", t, s)) for n, (x, y) in enumerate(two.ends, 1)}
        | {
            "_cosine": F.abs(F.try_divide(c("_ax") * c("_bx") + c("_ay") * c("_by"), F.sqrt("_aa") * F.sqrt("_bb"))),
            "_s": F.try_divide(c("_ax") * (t.y1 - s.y1) + c("_ay") * (s.x1 - t.x1), c("_delta")),
            "_t": F.try_divide(c("_bx") * (s.y1 - t.y1) + c("_by") * (t.x1 - s.x1), -c("_delta")),
        }
    )
    held = lambda name: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c(name), F.lit(0.0))))
    steps = steps.withColumns({f"_h{k}{n}": held(f"_{k}{n}") for k in "ab" for n in (1, 2)})
    off = {}
    for k, one, two in (("a", s, t), ("b", t, s)):
        for n, (x, y) in enumerate(two.ends, 1):
            off |= {f"_u{k}{n}": x - one.x1 - c(f"_h{k}{n}") * c(f"_{k}x"), f"_v{k}{n}": y - one.y1 - c(f"_h{k}{n}") * c(f"_{k}y")}
    steps = steps.withColumns(off)
    nearest = F.sqrt(F.least(*(c(f"_u{k}{n}") * c(f"_u{k}{n}") + c(f"_v{k}{n}") * c(f"_v{k}{n}") for k in "ab" for n in (1, 2))))
    crosses = F.coalesce((c("_delta") >= 0.0001) & c("_s").between(0, 1) & c("_t").between(0, 1), F.lit(False))

    def beyond(k: str, one: Segment, two: Segment) -> Column:
        to_point = [F.sqrt((x - one.x1) * (x - one.x1) + (y - one.y1) * (y - one.y1)) for x, y in two.ends]
        over = lambda p, q: F.greatest(F.lit(0.0), F.least(p, q) - 1, -F.greatest(p, q))
        return F.when(c(f"_{k}{k}") == 0, over(*to_point)).otherwise(over(c(f"_{k}1"), c(f"_{k}2")))

    angle_ = F.degrees(F.acos(F.when(c("_cosine") > 1, 1.0).otherwise(c("_cosine"))))
    return steps.select(*pairs.columns, angle_.alias("angle"), F.when(crosses, 0.0).otherwise(nearest).alias("distance"), beyond("a", s, t).alias("over_ab"), beyond("b", t, s).alias("over_ba"))


def beside(s: Segment, x: Column, y: Column) -> Column:
    """True if the vector (x, y) points to the normal's side of the segment, or along it; a segment without length has direction (1, 0).

    The cross product isn't divided by the length, which would turn its exact 0 for a point in line into a rounded one below 0.
    """
    return F.when((s.dx == 0) & (s.dy == 0), y >= 0).otherwise(s.dx * y - s.dy * x >= 0)


def circular_difference(a: Column, b: Column, period: float) -> Column:
    """Of two values on a circle, the shorter way round."""
    d = F.abs(a - b)
    return F.least(d, period - d)


def upright(dx: Column, dy: Column, cutoff: float = 0.1) -> Column:
    """Whether a direction must turn round to be read upright: it points clearly left, or nearly straight with its normal left."""
    normal = -dy
    return ((dx < -cutoff) & (normal > 0)) | ((dx < cutoff) & (normal < 0))


def outside(low: float, high: float, slope: float, x: Column) -> Column:
    """Penalty that grows by `slope` with the distance of x from the interval."""
    return F.greatest(F.lit(0.0), slope * (x - high), slope * (low - x))


def unit(s: Segment) -> tuple[Column, Column]:
    """Direction of a segment; (1, 0) for one without length."""
    n = s.length
    return F.when(n > 0, F.try_divide(s.dx, n)).otherwise(1.0), F.when(n > 0, F.try_divide(s.dy, n)).otherwise(0.0)


def from_end(s: Segment, ahead: Column, across: Column) -> tuple[Column, Column]:
    """Whole map coordinates of a point given from the first end, along the segment and along its normal."""
    ux, uy = unit(s)
    return truncated(s.x1 + ux * ahead - uy * across), truncated(s.y1 + uy * ahead + ux * across)


def from_middle(s: Segment, x: Column, y: Column) -> tuple[Column, Column]:
    """Whole coordinates of a map point from the segment's middle, along it and along its normal. This isn't the inverse of `from_end`,
    which counts from an end."""
    ux, uy = unit(s)
    gx, gy = x - (s.x1 + s.x2) / 2, y - (s.y1 + s.y2) / 2
    return truncated(gx * ux + gy * uy), truncated(-gx * uy + gy * ux)


def farther_end(s: Segment, x: Column, y: Column) -> tuple[Column, Column]:
    """Vector from a point to the end of the segment that is farther from it; to the second end if both are as far."""
    a = (s.x1 - x) * (s.x1 - x) + (s.y1 - y) * (s.y1 - y)
    b = (s.x2 - x) * (s.x2 - x) + (s.y2 - y) * (s.y2 - y)
    return F.when(a > b, s.x1 - x).otherwise(s.x2 - x), F.when(a > b, s.y1 - y).otherwise(s.y2 - y)


def corners(s: Segment, height: Column) -> Column:
    """Array of the box around a segment of some height: top left, bottom left, bottom right, top right."""
    ux, uy = unit(s)
    hx, hy = -uy * height / 2, ux * height / 2
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(s.x1 + hx, s.y1 + hy), at(s.x1 - hx, s.y1 - hy), at(s.x2 - hx, s.y2 - hy), at(s.x2 + hx, s.y2 + hy))


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Sign of the turn from a by b to c: 1 to the normal's side, -1 to the other, 0 in line."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)).cast("int")


def dot(a: Segment, b: Segment) -> Column:
    return a.dx * b.dx + a.dy * b.dy


def square_distance(s: Segment) -> Column:
    return s.dx * s.dx + s.dy * s.dy


def chebyshev(s: Segment) -> Column:
    """The longer of both sides of the box around two points."""
    return F.greatest(F.abs(s.dx), F.abs(s.dy))


def scaled(lines: DataFrame, factor: float, *extents: str) -> DataFrame:
    """Coordinates, and columns that hold extents, times a factor."""
    return lines.withColumns({c: F.col(c) * factor for c in ("x1", "y1", "x2", "y2", *extents)})
