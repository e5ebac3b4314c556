"""Lists of ids as packed bytes, and matches of streets that go through shuffles only as those."""

import numpy as np
import pytest

from vellumgrid.operators import packed, streets

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("ids", [[], [5], [-3, -3, 7], [2**63 - 1, -(2**63), 0], list(range(1000)), [9, 1, 300, 70_000, 2**40]])
def test_lists_come_back(ids):
    assert packed.unpack(packed.pack(np.array(ids, np.int64))).tolist() == ids


def test_dense_lists_take_about_a_byte_an_id():
    ids = np.cumsum(RNG.geometric(1 / 40, 5000))
    assert len(packed.pack(ids)) < 5500


def test_columns_come_back(spark):
    lists = [[3, 1, 2], [], None, [7, None, 8]]
    rows = packed.with_packed(spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ids array<long>"), "ids").orderBy("k").collect()
    assert packed.lists_of([None if r.ids is None else bytes(r.ids) for r in rows]).to_pylist() == lists


def test_matches_are_packed_before_their_shuffle(spark):
    ends = RNG.uniform(0, 60, (40, 4)).round(1).tolist()
    old = spark.createDataFrame([(k % 18 if k else None, *x) for k, x in enumerate(ends[:20])], "h_id int, x1 double, y1 double, x2 double, y2 double")
    present = spark.createDataFrame([(k // 2, *x) for k, x in enumerate(ends[20:])], "p_id long, x1 double, y1 double, x2 double, y2 double")
    found = streets.match_streets(old, present)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.schema.simpleString() == "struct<h_id:int,matches:array<bigint>>"
    rows = found.collect()
    counts = streets.match_counts(old, present).collect()
    assert len(rows) == 20 and sorted((r.h_id or -1, len(r.matches)) for r in rows) == sorted((r.h_id or -1, r.n_matches) for r in counts)
    assert any(len(r.matches) > 3 for r in rows) and all(list(r.matches) == sorted(r.matches) for r in rows)
    assert [list(r.matches) for r in rows if r.h_id is None] == [[]]
