"""Pairs of segments by tiles against all pairs, over many cells and blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as g
from vellumgrid.operators import streets, tiles
from vellumgrid.params import ParallelEvidence


@pytest.fixture
def lines(spark):
    """400 lines over an area of several cells, some without length, copies, one without a coordinate; long lines of four."""
    rnd = np.random.default_rng(5)
    start = rnd.uniform(-900, 900, (400, 2))
    end = start + rnd.normal(size=(400, 2)) * 90
    end[:9] = start[:9]
    start[20:30], end[20:30] = start[10:20], end[10:20]
    rows = [(k, k // 4, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(start, end))]
    return spark.createDataFrame([*rows, (400, 100, 0.0, None, 1.0, 1.0)], "line_id long, group_id long, x1 double, y1 double, x2 double, y2 double").cache()


def all_pairs(lines):
    side = lambda k: lines.select(*(F.col(c).alias(f"{k}{c}") for c in lines.columns))
    return g.measured(side("a_").crossJoin(side("b_")), "a_", "b_")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("reach, block", [(20.0, 64), (300.0, 8192)])
def test_each_near_pair_is_in_one_tile(spark, lines, reach, block):
    def kernel(cell, width, one, two):
        found = [(one.column("line_id").to_numpy()[x.i], two.column("line_id").to_numpy()[x.j], x.distance, x.over_ab, x.angle) for x in tiles.near_pairs(one, two, cell, width, reach)]
        a, b, *more = (np.concatenate(v) for v in zip(*found)) if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 3
        near = more[0] < reach
        return pa.table([a[near], b[near], *(v[near] for v in more)], names=["a", "b", "d", "o", "g"])

    got = tiles.tile_pairs(lines, lines, reach, kernel, "a long, b long, d double, o double, g double", block)
    want = {(r.a_line_id, r.b_line_id): r for r in all_pairs(lines.where("y1 is not null")).where(F.col("distance") < reach).collect()}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.a, r.b) for r in rows} == set(want)
    for r in rows:
        w = want[r.a, r.b]
        assert (r.d, r.o) == pytest.approx((w.distance, w.over_ab), abs=1e-9)
        assert np.isnan(r.g) if w.angle is None else r.g == pytest.approx(w.angle, abs=1e-6)


def test_matches_are_those_of_all_pairs(spark, lines):
    old, present = lines.where("line_id % 2 = 0").withColumnRenamed("line_id", "h_id"), lines.where("line_id % 2 = 1").withColumnRenamed("line_id", "p_id")
    side = lambda df, k: df.select(*(F.col(c).alias(f"{k}{c}") for c in ("x1", "y1", "x2", "y2")), *(c for c in df.columns if c.endswith("_id") and c != "group_id"))
    cost = streets.match_cost(g.Segment.named("a_"), g.Segment.named("b_"))
    pairs = side(old, "a_").crossJoin(side(present, "b_")).where(cost < 1000).groupBy("h_id").agg(F.sort_array(F.collect_list("p_id")).alias("m"))
    want = {r.h_id: r.m for r in pairs.collect()}
    found = streets.match_streets(old, present)
    assert "FlatMapCoGroupsInArrow" in plan(found)
    got = {r.h_id: list(r.matches) for r in found.collect()}
    assert len(got) == old.count() and {k: v for k, v in got.items() if v} == want and want
    assert {r.h_id: r.n_matches for r in streets.match_counts(old, present).collect()} == {k: len(v) for k, v in got.items()}


@pytest.mark.parametrize("groups", ["group_id", "line_id % 3"])
def test_parallel_share_of_few_and_of_many_long_lines(spark, lines, groups):
    lines, p = lines.withColumn("group_id", F.expr(groups)), ParallelEvidence(most_angle=12.0)
    good = (F.col("angle") < p.most_angle) & (F.col("distance") > p.least_distance) & (F.col("distance") < p.most_distance) & (F.col("over_ab") + F.col("over_ba") < p.most_overshoot)
    length = g.Segment.named("a_").length.alias("w")
    flags = all_pairs(lines).where("a_group_id <> b_group_id").where(good).select("a_line_id", "a_group_id", "b_group_id", length).distinct()
    sums = {r.a_group_id: r.w for r in flags.groupBy("a_group_id").agg(F.sum("w").alias("w")).collect()}
    total = {r.group_id: r.w for r in lines.groupBy("group_id").agg(F.sum(g.Segment.named().length).alias("w")).collect()}
    got = {r.group_id: r.parallel for r in streets.parallel_evidence(lines, p).collect()}
    assert got == {k: pytest.approx(min(1.0, sums.get(k, 0.0) / w) if w else 0.0) for k, w in total.items()}
