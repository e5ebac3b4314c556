import pytest

from vellumgrid.operators import raster
from vellumgrid.plans import fold_queries, raster_queries


def test_queries_thin_to_the_fixed_point(spark, monkeypatch):
    """A solid block of 21 by 40 cells needs more than 4 rounds."""
    cells = spark.createDataFrame([("a", r, c) for r in range(21) for c in range(40)], "img string, r int, c int")
    for queries in (raster_queries, fold_queries):
        monkeypatch.setattr(queries, "_cells", lambda *_: cells)
    monkeypatch.setattr(fold_queries.folds, "trace_chains", lambda df: df)
    for found in (raster_queries.skeleton(spark, ""), fold_queries.chains(spark, "")):
        again = raster.thin_step(raster.thin_step(found, False), True)
        assert 0 < found.count() == again.count() < 60


def test_a_bound_that_is_met_is_told(spark):
    cells = spark.createDataFrame([("a", r, c) for r in range(21) for c in range(40)], "img string, r int, c int")
    with pytest.raises(ValueError):
        raster.thinned(cells, 4)
