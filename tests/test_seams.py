"""Streets carved sample by sample, and what curbs say of long lines that meet."""

from __future__ import annotations

import math
import random

from vellumgrid.operators import curbs, seams
from vellumgrid.plans import form_queries

SF = "/root/testdata/sf0.001"


class Plain:
    """One side of a street, sample by sample."""

    def __init__(self, street: tuple, area: set, black: set, p: seams.Carving):
        self.x1, self.y1, x2, y2 = street
        self.width = math.hypot(x2 - self.x1, y2 - self.y1)
        self.ux, self.uy = ((x2 - self.x1) / self.width, (y2 - self.y1) / self.width) if self.width else (1.0, 0.0)
        self.area, self.black, self.p = area, black, p
        self.apart = 1 + min(p.most_apart, int(self.width / p.wide))
        self.columns = int(self.width / self.apart)

    def cell(self, ahead: float, across: float) -> tuple[int, int]:
        return int(self.y1 + self.uy * ahead + self.ux * across), int(self.x1 + self.ux * ahead - self.uy * across)

    def heights(self) -> list[int]:
        p, out = self.p, []
        for k in range(int(self.width / p.height_step)):
            height, seen = None, False
            for j in range(p.search // p.height_step):
                on = self.cell(k * p.height_step, j * p.height_step) in self.area
                if seen and not on:
                    height = j * p.height_step
                    break
                seen = seen or on
            out.append(height if height is not None else p.search if seen else 0)
        return out

    def run(self) -> dict:
        p, levels = self.p, self.p.search // self.p.sample
        heights = self.heights()
        height = lambda x: heights[x * len(heights) // self.columns] if heights else 0
        energy = [[0.0] * levels for _ in range(self.columns)]
        for x in range(1, self.columns):
            for y in range(1, levels - 1):
                if y * p.sample > height(x) * p.ratio and y * p.sample > p.search / 10:
                    break
                gain = 1 / (abs(y * p.sample - height(x)) / p.close + 1) if self.cell(x * self.apart, y * p.sample) in self.black else 0.0
                energy[x][y] = max(energy[x - 1][y - 1 : y + 2]) + gain
        at = max(range(1, levels - 1), key=lambda y: (energy[-1][y], -y))
        last, count, inside = energy[-1][at], 0, p.inside * p.sample
        seam = [0] * self.columns
        for x in range(self.columns - 1, 0, -1):
            seam[x] = at
            low, mid, high = energy[x - 1][at - 1 : at + 2]
            if low + inside > mid and low + 2 * inside > high:
                at -= 1
            elif not mid + inside > high:
                at += 1
            if max(low, mid, high) + 0.01 < last:
                count += 1
            last = max(low, mid, high)
            at = min(max(at, 1), levels - 2)
        seam[0] = at
        good = count > p.good * self.columns
        cells: dict = {}
        for x in range(self.columns):
            low = max(0, seam[x] - p.edge)
            zones = [("middle", range(min(levels, max(min(low, seam[x]), 0 if good else height(x) + p.slack // p.sample))))]
            if good:
                zones += [("edge", range(low, min(seam[x] - 1, levels))), ("seam", [seam[x]])]
            for zone, ys in zones:
                for y in ys:
                    key = (zone, *self.cell(x * self.apart, y * p.sample))
                    cells[key] = min(cells.get(key, 1 << 30), y)
        return cells


def plain_carving(streets: list[tuple], area: set, black: set, p: seams.Carving) -> dict:
    out: dict = {}
    for k, x1, y1, x2, y2 in streets:
        for ends in ((x1, y1, x2, y2), (x2, y2, x1, y1)):
            side = Plain(ends, area, black, p)
            if side.columns:
                for (zone, r, c), y in side.run().items():
                    key = (k, zone, r, c)
                    out[key] = min(out.get(key, 1 << 30), y)
    return out


SMALL = seams.Carving(height_step=5, search=60, sample=2, wide=40, most_apart=3, close=9.0, edge=5, slack=6)


def found_cells(spark, streets, area, black, p) -> dict:
    table = lambda cells: spark.createDataFrame(sorted(cells), "r int, c int")
    df = spark.createDataFrame(streets, "street_id long, x1 double, y1 double, x2 double, y2 double")
    rows = seams.carve(seams.find_seams(df, table(area), table(black), p), p).collect()
    return {(r["street_id"], r["zone"], r["r"], r["c"]): round(r["distance"] - 0.01) for r in rows}


def test_carving_equals_samples_one_by_one(spark):
    rnd = random.Random(5)
    area = {(r, c) for r in range(40, 95) for c in range(10, 190)} | {(r, c) for r in range(100, 170) for c in range(120, 150)}
    black = {(r, c) for r in (42, 43, 92) for c in range(10, 190) if rnd.random() < 0.9} | {(rnd.randint(0, 180), rnd.randint(0, 200)) for _ in range(1500)} | {(r, c) for r in range(100, 170) for c in (122, 148)}
    streets = [(1, 12.0, 67.0, 185.0, 69.0), (2, 135.0, 168.0, 134.0, 101.0), (3, 60.0, 20.0, 100.0, 160.0), (4, 5.0, 5.0, 9.0, 8.0), (5, 7.0, 7.0, 7.0, 7.0), (6, 300.0, 300.0, 350.0, 310.0)]
    want = plain_carving(streets, area, black, SMALL)
    assert found_cells(spark, streets, area, black, SMALL) == want
    assert {z for k, z, _, _ in want if k == 1} == {"middle", "edge", "seam"} and not any(k == 5 for k, *_ in want)


def test_carving_without_streets_or_cells(spark):
    assert found_cells(spark, [], {(1, 1)}, {(1, 1)}, SMALL) == {}
    streets = [(1, 0.0, 0.0, 30.0, 0.0)]
    assert found_cells(spark, streets, {(500, 500)}, {(500, 500)}, SMALL) == plain_carving(streets, set(), set(), SMALL)


def test_carving_query(spark):
    streets = [tuple(r) for r in form_queries._small_streets(spark, SF).collect()]
    area, black = ({tuple(r) for r in plane.collect()} for plane in form_queries._street_planes(spark, SF))
    want = plain_carving(streets, area, black, form_queries.STREETS)
    rows = form_queries.seam_carving(spark, SF).collect()
    assert {(r["street_id"], r["zone"], r["r"], r["c"]): round(r["distance"] - 0.01) for r in rows} == want
    assert len({k for k, z, *_ in want if z == "seam"}) > 5


def test_corners_by_hand(spark):
    """A long line of two pieces from (0, 0) to (100, 0), one branch up in the middle, one corner down at its second end."""
    rows = [(1, 1, 0.0, 0.0, 50.0, 0.0), (2, 1, 50.0, 0.0, 100.0, 0.0), (3, 2, 50.0, 0.0, 50.0, 30.0), (4, 3, 100.0, 0.0, 100.0, -200.0)]
    lines = spark.createDataFrame(rows, "line_id long, group_id long, x1 double, y1 double, x2 double, y2 double")
    found = {r["group_id"]: r for r in curbs.corner_evidence(lines).collect()}
    r = found[1]
    # the branch is met by both pieces: two of 30 on one side; the corner once, with 60 at most, on the other; the first end is free
    sides = {"p": (2, 60.0), "n": (1, 60.0)}
    (cp, lp), (cn, ln) = sides["p"], sides["n"]
    up = min(cn * 0.08 + (ln - lp) * 0.005, 1) - (cp * 0.08 / 3 + lp * 0.005 / 3) if cp <= 1 or lp < 60 else min((cn / cp - 1) * 0.08 + (ln - lp) * 0.005, 0.6) - lp * 0.005 / 3
    down = min(cp * 0.08 + (lp - ln) * 0.005, 1) - (cn * 0.08 / 3 + ln * 0.005 / 3)
    assert math.isclose(r["branch_p"], up) and math.isclose(r["branch_n"], down)
    assert math.isclose(r["end_p"], 0.5 - 0.2) and math.isclose(r["end_n"], -0.9 - 0.2)
    assert found[2]["branch_p"] <= 0 and math.isclose(found[2]["end_p"], -0.2 + sum(0.5 * 60 / 60 if s == "n" else -0.9 * 60 / 60 for s in ("p", "n")))
