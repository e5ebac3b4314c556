import itertools

import numpy as np
import pytest

from vellumgrid.operators import folds, text

#: Pairs of strings without expected results, and what unit costs give.
PAIRS = [("", "", 0), ("", "aaabb", 5), ("aabbd", "", 5), ("abcd", "defg", 4), ("dggi", "doggo", 2), ("qtuie", "quiet", 2)]


@pytest.mark.parametrize("a, b, cost", PAIRS)
def test_alignment(a, b, cost):
    found, steps = text.align(a, b)
    assert found == cost
    assert "".join(o for o, _ in steps if o != text.EMPTY) == a and "".join(i for _, i in steps if i != text.EMPTY) == b


def test_costs_settle(spark):
    df = spark.createDataFrame([("CAT", "CAT"), ("CET", "CAT"), ("DOG", "DOC"), ("", "A")], "observed string, intended string")
    costs, rounds = text.train_costs(df)
    p = {(r.o, r.i): r.p for r in costs.collect()}
    assert rounds >= 2 and p["A", "A"] == pytest.approx(1 / 3) and p["E", "A"] == pytest.approx(1 / 3)


def test_decoding_takes_the_best_cut():
    c = [(0, 8, "A", 0.9), (8, 16, "B", 0.9), (0, 16, "M", 0.5), (4, 16, "C", 0.95), (0, 20, "I", 1.0)]
    # the strip is 20 wide, so the last cut is at 16: A (0 to 8) and then C, which begins at 4, or M alone
    assert folds.decode([*c, (8, 16, "C", 0.95)], 20) == ("M", 0.5)
    assert folds.decode([(0, 4, "A", 0.9), (8, 16, "B", 0.9)], 20) == ("AB", pytest.approx(0.81))


def test_decoding_without_a_path():
    assert folds.decode([(4, 8, "A", 0.5)], 20) == ("", -1.0)


def test_seam_equals_brute_force():
    rnd = np.random.default_rng(2)
    e = rnd.random((4, 6))
    paths = [p for p in itertools.product(range(4), repeat=6) if all(abs(a - b) <= 1 for a, b in zip(p, p[1:]))]
    best = min(sum(e[r, c] for c, r in enumerate(p)) for p in paths)
    assert sum(e[r, c] for c, r in enumerate(folds.seam(e))) == pytest.approx(best)


def test_split_keeps_a_straight_chain_and_breaks_a_corner():
    line = np.array([(k, 0.0) for k in range(10)])
    corner = np.array([(k, 0.0) for k in range(10)] + [(9.0, k) for k in range(1, 10)])
    assert folds.split_chain(line, 1.0) == [(0, 9)]
    assert (0, 9) in folds.split_chain(corner, 1.0)


def test_resampling_ends_on_any_chain():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        u = folds.resample(rnd.normal(size=(30, 2)) * 20)
        assert np.allclose(np.hypot(u[:, 0], u[:, 1]), 1)


def test_shelves_do_not_overlap(spark):
    rows = [(1, k, 300 + 37 * k % 500, 100) for k in range(60)]
    got = folds.pack_shelves(spark.createDataFrame(rows, "map_id long, word_id long, width int, height int")).collect()
    assert len(got) == 60 and all(r.x + r.w <= 2048 and r.y + 127 <= 2048 for r in got)
    for a, b in itertools.combinations(got, 2):
        assert a.sheet != b.sheet or a.y != b.y or a.x + a.w <= b.x or b.x + b.w <= a.x


def test_dense_ids(spark):
    got = text.dense_ids(spark.range(1000).selectExpr("(id * 7919) % 1000 as v"), "v", buckets=8).collect()
    assert sorted((r.v, r.sample_id) for r in got) == [(k, k + 1) for k in range(1000)]
