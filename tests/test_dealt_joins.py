"""Joins of rounds go by key: no table of theirs is sent through the driver."""

from vellumgrid.operators import linking, raster


def test_no_broadcast_in_rounds(spark):
    cells = spark.createDataFrame([("a", r, c) for r in range(5) for c in range(5)], "img string, r int, c int")
    links = spark.createDataFrame([(k, k + 1 if k < 9 else None) for k in range(10)], "node long, next long")
    for df in (raster.neighbour_mask(cells), linking._doubled(links.selectExpr("node", "next ahead", "1L far", "node least", "0L at", "true changed", "if(next is null, node, null) last", "if(next is null, 0L, null) rest"))):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
