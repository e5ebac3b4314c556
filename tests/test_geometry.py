import math

import pytest

from vellumgrid.functions import geometry as g
from vellumgrid.operators.gridjoin import box_names, grid_join, with_box

CASES = [
    # x1..y2 of both; angle, crosses as told, strictly, distance, overshoot
    ((0, 0, 10, 0, 0, 5, 10, 5), 0.0, False, False, 5.0, 0.0),
    ((0, 0, 10, 10, 0, 10, 10, 0), 90.0, True, True, 0.0, 0.0),
    ((0, 10, 10, 0, 0, 0, 10, 10), 90.0, False, True, None, 0.0),
    ((0, 0, 10, 0, 20, 0, 30, 0), 0.0, False, False, 10.0, 1.0),
    ((0, 0, 10, 0, -20, 0, -10, 0), 0.0, False, False, 10.0, 1.0),
    ((0, 0, 10, 0, 10, 0, 10, 10), 90.0, False, True, 0.0, 0.0),
]


@pytest.mark.parametrize("case", CASES)
def test_pairs(spark, case):
    xs, angle, crosses, strictly, distance, over = case
    names = [f"{k}_{c}" for k in "ab" for c in ("x1", "y1", "x2", "y2")]
    df = spark.createDataFrame([tuple(map(float, xs))], ", ".join(f"{n} double" for n in names))
    a, b = g.Segment.named("a_"), g.Segment.named("b_")
    row = df.select(g.angle(a, b).alias("angle"), g.intersect(a, b).alias("i"), g.intersect(a, b, strict=True).alias("s"), g.distance(a, b).alias("d"), g.overshoot(a, b).alias("o")).first()
    assert row.angle == pytest.approx(angle) and row.i == crosses and row.s == strictly and row.o == pytest.approx(over)
    if distance is not None:
        assert row.d == pytest.approx(distance)


def test_segment_without_length(spark):
    df = spark.createDataFrame([(3.0, 4.0, 3.0, 4.0, 0.0, 0.0, 0.0, 10.0)], "a_x1 double, a_y1 double, a_x2 double, a_y2 double, b_x1 double, b_y1 double, b_x2 double, b_y2 double")
    a, b = g.Segment.named("a_"), g.Segment.named("b_")
    row = df.select(g.angle(a, b).alias("angle"), g.distance(a, b).alias("d"), g.along(b.x1, b.y1, a).alias("t")).first()
    assert row.angle is None and row.d == pytest.approx(3.0) and row.t == pytest.approx(5.0)


def test_grid_join_equals_brute_force(spark):
    import random

    rnd = random.Random(5)
    box = lambda: [rnd.uniform(-50, 50) for _ in range(4)]
    left, right = [(k, *box()) for k in range(40)], [(k, *box()) for k in range(40)]
    l = with_box(spark.createDataFrame(left, "l_id long, l_x1 double, l_y1 double, l_x2 double, l_y2 double"), "l_")
    r = with_box(spark.createDataFrame(right, "r_id long, r_x1 double, r_y1 double, r_x2 double, r_y2 double"), "r_")
    got = sorted((x.l_id, x.r_id) for x in grid_join(l, r, box_names("l_"), box_names("r_"), 3.0, 7.0).collect())
    near = lambda a, b, k: min(a[k], a[k + 2]) - 3 <= max(b[k], b[k + 2]) and min(b[k], b[k + 2]) <= max(a[k], a[k + 2]) + 3
    assert got == sorted((a[0], b[0]) for a in left for b in right if near(a, b, 1) and near(a, b, 2))


def test_folded_degrees(spark):
    row = spark.range(1).select(*(g.folded_degrees(x).alias(n) for n, x in (("a", g.F.lit(math.pi)), ("b", g.F.lit(math.pi / 4))))).first()
    assert row.a == pytest.approx(0.0) and row.b == pytest.approx(45.0)
