"""Nearest points on cubic curves against all roots of the power form and a dense walk along the curve."""

import numpy as np

from vellumgrid.operators import curves
from vellumgrid.plans import form_queries


def plain(controls: np.ndarray, point: np.ndarray) -> tuple[float, float]:
    """(t, squared distance) by the roots of the derivative in powers of t."""
    p0, p1, p2, p3 = controls
    xs = [np.polynomial.Polynomial([a, 3 * (b - a), 3 * (a - 2 * b + c), d - a + 3 * (b - c)]) for a, b, c, d in zip(p0, p1, p2, p3)]
    square = sum((x - v) ** 2 for x, v in zip(xs, point))
    places = [0.0, 1.0] + [float(r.real) for r in square.deriv().roots() if abs(r.imag) < 1e-7 and 0 < r.real < 1]
    return min((float(sum((x(t) - v) ** 2 for x, v in zip(xs, point))), t) for t in places)[::-1]


def test_nearest_equals_all_roots():
    rnd = np.random.default_rng(3)
    controls, point = rnd.normal(size=(400, 4, 2)) * 100, rnd.normal(size=(400, 2)) * 120
    t, found, d2 = curves.nearest(controls, point)
    for k in range(400):
        want_t, want = plain(controls[k], point[k])
        assert abs(d2[k] - want) <= 1e-6 * max(1, want)
        assert abs(t[k] - want_t) < 1e-5 or abs(np.sqrt(d2[k]) - np.sqrt(want)) < 1e-6
        assert np.allclose(((found[k] - point[k]) ** 2).sum(), d2[k])
        walk = curves.on_curve(np.repeat(controls[k : k + 1], 2000, axis=0), np.linspace(0, 1, 2000))
        assert d2[k] <= ((walk - point[k]) ** 2).sum(axis=1).min() + 1e-9


def test_curves_of_special_kinds():
    line = np.array([[0, 0], [1, 0], [2, 0], [3, 0]], float)
    same = np.full((4, 2), 5.0)
    back = np.array([[0, 0], [3, 0], [-2, 0], [1, 0]], float)
    loop = np.array([[0, 0], [2, 2], [-1, 2], [1, 0]], float)
    controls = np.stack([line, line, same, back, loop, line])
    point = np.array([[1.5, 2], [-4, 0], [1, 1], [0.5, 0], [0.5, 5], [1.5, 0]])
    t, _, d2 = curves.nearest(controls, point)
    assert np.allclose(t[[0, 1, 5]], [0.5, 0, 0.5]) and np.allclose(d2[[0, 1, 2, 5]], [4, 16, 32, 0])
    for k in range(len(t)):
        assert abs(d2[k] - plain(controls[k], point[k])[1]) < 1e-9
    assert t[2] == 0  # a curve of one point: its beginning


def test_rows_with_nulls(spark):
    rows = [(1, 0.0, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0, 0.0, 1.5, 2.0, "a"), (2, None, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0, 0.0, 1.5, 2.0, "b"), (3, float("nan"), 0.0, 1.0, 0.0, 2.0, 0.0, 3.0, 0.0, 1.5, 2.0, "c")]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in curves.CONTROLS) + ", px double, py double, t string")
    found = {r["id"]: r for r in curves.nearest_on_cubic(df).collect()}
    assert abs(found[1]["t"] - 0.5) < 1e-12 and found[1]["d2"] == 4.0 and found[2]["t"] is None and found[3]["d2"] is None
    assert curves.nearest_on_cubic(df.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = form_queries.nearest_on_cubic(spark, folder).collect()
    e = {r["vec_id"]: np.array(r["embedding"], float)[:10] * 1000 for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    assert len(rows) == len(e)
    for r in rows:
        t, d2 = plain(e[r["vec_id"]][:8].reshape(4, 2), e[r["vec_id"]][8:])
        assert abs(r["d2"] - d2) <= 1e-4 and abs(r["t"] - t) < 1e-4
