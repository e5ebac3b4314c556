"""Nearest points on cubic curves.

The nearest point is at an end of the curve or where the way to it is at right angles, a root of a polynomial of degree five. In
Bernstein form, its roots in an interval are at most as many as the changes of sign of its coefficients, and one where there is one
change. Intervals of all rows of a batch are halved together until none has more, then every root is narrowed by halving.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Halvings until an interval with several changes of sign counts as one root (a double one, say), and of an interval with one.
ISOLATE, NARROW = 40, 60
CONTROLS = tuple(f"{c}{k}" for k in range(4) for c in "xy")
#: What the products of the coefficients of degrees three and two weigh in those of degree five.
_PRODUCTS = np.zeros((6, 4, 3))
for _i, _a in enumerate((1, 3, 3, 1)):
    for _j, _b in enumerate((1, 2, 1)):
        _PRODUCTS[_i + _j, _i, _j] = _a * _b / (1, 5, 10, 10, 5, 1)[_i + _j]


def right_angles(controls: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Bernstein coefficients, [row, 6], of the way to the point times the curve's direction. controls: [row, 4, 2]."""
    way = controls - point[:, None, :]
    return np.einsum("kij,nid,njd->nk", _PRODUCTS, way, np.diff(controls, axis=1))


def halves(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients on the lower and the upper half of an interval."""
    low, high = [c[:, 0]], [c[:, -1]]
    while c.shape[1] > 1:
        c = (c[:, :-1] + c[:, 1:]) / 2
        low.append(c[:, 0])
        high.append(c[:, -1])
    return np.stack(low, axis=1), np.stack(high[::-1], axis=1)


def changes(c: np.ndarray) -> np.ndarray:
    """Changes of sign in each row, zeros left out."""
    sign = np.sign(c)
    last, n = sign[:, 0].copy(), np.zeros(len(c), np.int64)
    for k in range(1, c.shape[1]):
        n += (sign[:, k] * last) < 0
        last = np.where(sign[:, k] != 0, sign[:, k], last)
    return n


def roots(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, t): roots in (0, 1) of polynomials in Bernstein form; roots at 0 or 1 may be left out."""
    row, begin, size = np.arange(len(c)), np.zeros(len(c)), np.ones(len(c))
    single: list[tuple[np.ndarray, ...]] = []
    rows, at = [], []
    for depth in range(ISOLATE + 1):
        n = changes(c)
        one = n == 1
        single.append((row[one], c[one], begin[one], size[one]))
        more = n > 1
        row, c, begin, size = row[more], c[more], begin[more], size[more]
        if depth == ISOLATE:
            rows.append(row)
            at.append(begin + size / 2)
            break
        if not len(row):
            break
        low, high = halves(c)
        # a root in the very middle is a zero at the edge of both
        middle = low[:, -1] == 0
        rows.append(row[middle])
        at.append((begin + size / 2)[middle])
        row, size = np.concatenate([row, row]), np.concatenate([size, size]) / 2
        begin = np.concatenate([begin, begin + size[: len(begin)]])
        c = np.concatenate([low, high])
    row, c, begin, size = (np.concatenate(x) for x in zip(*single))
    for _ in range(NARROW):
        low, high = halves(c)
        first = (changes(low) == 1) | (low[:, -1] == 0)
        c = np.where(first[:, None], low, high)
        size = size / 2
        begin = np.where(first, begin, begin + size)
    return np.concatenate([row, *rows]), np.concatenate([begin + size / 2, *at])


def on_curve(controls: np.ndarray, t: np.ndarray) -> np.ndarray:
    s = 1 - t
    weights = np.stack([s**3, 3 * s * s * t, 3 * s * t * t, t**3], axis=1)
    return np.einsum("ni,nid->nd", weights, controls)


def nearest(controls: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place t, point and squared distance of the nearest point of each curve; of equally near ones the first along the curve."""
    row, t = roots(right_angles(controls, point))
    n = np.arange(len(point))
    row, t = np.concatenate([n, n, row]), np.concatenate([np.zeros(len(n)), np.ones(len(n)), t])
    found = on_curve(controls[row], t)
    d2 = ((found - point[row]) ** 2).sum(axis=1)
    order = np.lexsort((t, d2, row))
    first = order[np.concatenate([[True], np.diff(row[order]) > 0])] if len(order) else order
    return t[first], found[first], d2[first]


def nearest_on_cubic(rows: DataFrame) -> DataFrame:
    """Adds t, nx, ny and d2 to rows with a point (px, py) and the control points (x0, y0) to (x3, y3) of a cubic curve.

    t is the place along the curve, from 0 to 1; the first of equally near ones. A row with a null or a value that isn't finite has
    nulls. Columns of the names added are replaced.
    """
    base = rows.drop("t", "nx", "ny", "d2")
    named = base.withColumns({f"_{c}": F.col(c).cast("double") for c in (*CONTROLS, "px", "py")})
    added = ("t", "nx", "ny", "d2")
    schema = named.withColumns({c: F.lit(None).cast("double") for c in added}).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(f"_{c}").to_numpy(zero_copy_only=False).astype(float) for c in (*CONTROLS, "px", "py")], axis=1)
            ok = np.isfinite(values).all(axis=1)
            out = np.full((len(values), 4), np.nan)
            if ok.any():
                t, found, d2 = nearest(values[ok, :8].reshape(-1, 4, 2), values[ok, 8:])
                out[ok] = np.column_stack([t, found, d2])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, k], mask=~ok) for k in range(4))], names=[*batch.schema.names, *added])

    return named.mapInArrow(kernel, schema).drop(*(f"_{c}" for c in (*CONTROLS, "px", "py")))
