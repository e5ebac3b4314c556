"""Queries on small rasters: cells of 48 x 48 grids, one a kind of event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.operators import raster
from vellumgrid.plans import fixtures as fx

SIDE = 48
SPARSE, THICK, PEAK = fx.SPARSE, fx.THICK, fx.PEAK


def _cells(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return fx.cells(spark, sf_dir).where(where).select(F.col("kind").alias("img"), "r", "c")


def _plane(spark: SparkSession, sf_dir: str, kind: str, where: str = "true") -> DataFrame:
    return fx.cells(spark, sf_dir).where(F.col("kind") == kind).where(where).select("r", "c")


def _grid(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """All cells with v = 1 where set."""
    cells = _cells(spark, sf_dir, where)
    images = _cells(spark, sf_dir).select("img").distinct()
    return raster.full_grid(images, SIDE, SIDE).join(cells.withColumn("v", F.lit(1)), ["img", "r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda kind, where="true": _plane(spark, sf_dir, kind, where)
    return raster.marking_in_street(p("click"), p("view"), p("purchase"), p("error"), p("signup", SPARSE))


MASK_SQL = f"""
WITH {fx.CELLS}, p AS (SELECT kind, r, c FROM cell WHERE kind <> 'signup' OR {SPARSE})
SELECT r, c FROM (
  (SELECT r, c FROM p WHERE kind = 'click' INTERSECT (SELECT r, c FROM p WHERE kind = 'purchase' UNION SELECT r, c FROM p WHERE kind = 'error'))
  UNION ((SELECT r, c FROM p WHERE kind = 'view' INTERSECT SELECT r, c FROM p WHERE kind = 'purchase') EXCEPT SELECT r, c FROM p WHERE kind = 'signup'))"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.components(_cells(spark, sf_dir, SPARSE)).select("img", "r", "c", "component")


_STEP8 = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1"
COMPONENTS_SQL = f"""
WITH RECURSIVE {fx.CELLS}, s AS (SELECT kind AS img, r, c FROM cell WHERE {SPARSE}),
t AS (SELECT img, r, c, r AS tr, c AS tc FROM s UNION SELECT a.img, a.r, a.c, b.tr, b.tc FROM t b JOIN s a ON a.img = b.img AND {_STEP8}),
m AS (SELECT img, r, c, min((tr, tc)) AS top FROM t GROUP BY 1, 2, 3)
SELECT img, r, c, top[1] || ':' || top[2] AS component FROM m"""


def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir, THICK)
    return raster.fill_holes(cells, _cells(spark, sf_dir).select("img").distinct(), SIDE, SIDE, 4)


FILL_SQL = f"""
WITH RECURSIVE {fx.CELLS}, s AS (SELECT kind AS img, r, c FROM cell WHERE {THICK}),
g AS (SELECT img, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT DISTINCT kind AS img FROM cell), range({SIDE}) AS a(r), range({SIDE}) AS b(c)),
o AS (SELECT img, r, c FROM g EXCEPT SELECT img, r, c FROM s),
t AS (SELECT img, r, c, r * 100 + c AS top, 0 AS n FROM o UNION SELECT a.img, a.r, a.c, b.top, 0 FROM t b JOIN o a ON a.img = b.img AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
m AS (SELECT img, r, c, min(top) AS top FROM t GROUP BY 1, 2, 3), k AS (SELECT img, top FROM m GROUP BY 1, 2 HAVING count(*) < 4)
SELECT img, r, c FROM s UNION SELECT img, r, c FROM m JOIN k USING (img, top)"""


def clear_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.clear_border(raster.shrink_by(_cells(spark, sf_dir, SPARSE), 3), 16, 16)


def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir, SPARSE).withColumn("v", F.col("v").cast("double"))
    return raster.box_mean(g, 2).select("img", "r", "c", F.round("v", 6).alias("v"))


_GRID = f"""{fx.CELLS}, s AS (SELECT kind AS img, r, c FROM cell WHERE {{}}),
g AS (SELECT q.img, CAST(a.r AS INTEGER) AS r, CAST(b.c AS INTEGER) AS c, CASE WHEN s.r IS NULL THEN 0 ELSE 1 END AS v FROM (SELECT DISTINCT kind AS img FROM cell) q CROSS JOIN range({SIDE}) AS a(r) CROSS JOIN range({SIDE}) AS b(c) LEFT JOIN s ON s.img = q.img AND s.r = a.r AND s.c = b.c)"""
_AROUND = "SELECT a.img, a.r, a.c, {0} AS v FROM g a JOIN g b ON a.img = b.img AND abs(a.r - b.r) <= {1} AND abs(a.c - b.c) <= {1} GROUP BY 1, 2, 3"


def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.erode(_grid(spark, sf_dir, THICK), 1).select("img", "r", "c", "v")


def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilate(_grid(spark, sf_dir, SPARSE), 1).select("img", "r", "c", "v")


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.opened(_grid(spark, sf_dir, "true"), 1).select("img", "r", "c", "v")


def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir, SPARSE).withColumn("v", (255 - 200 * F.col("v") + (F.col("r") * 5 + F.col("c")) % 40).cast("double"))
    return raster.adaptive_threshold(g, 3)


THRESHOLD_SQL = f"""
WITH {_GRID.format(SPARSE)}, x AS (SELECT img, r, c, 255 - 200 * v + (r * 5 + c) % 40 AS v FROM g),
m AS (SELECT a.img, a.r, a.c, any_value(a.v) AS v, avg(b.v) AS m FROM x a JOIN x b ON a.img = b.img AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY 1, 2, 3)
SELECT img, r, c FROM m WHERE v < m - 40 AND v < 200"""


def row_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.row_distance(_grid(spark, sf_dir, SPARSE)).select("img", "r", "c", F.coalesce("d", F.lit(-1)).alias("d"))


def feature_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.feature_transform(_grid(spark, sf_dir, SPARSE))


FEATURE_SQL = f"""
WITH {_GRID.format(SPARSE)}, n AS (SELECT a.img, a.r, a.c, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2, b.r AS fr, b.c AS fc FROM g a JOIN g b ON a.img = b.img AND b.v = 1)
SELECT img, r, c, d2, fr, fc FROM (SELECT *, row_number() OVER (PARTITION BY img, r, c ORDER BY d2, fr, fc) AS k FROM n) WHERE k = 1"""


def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_transform(spark, sf_dir).select("img", "r", "c", "d2")


def medial_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.medial_axis(feature_transform(spark, sf_dir), gamma=3.0)


def neighbour_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.neighbour_mask(_cells(spark, sf_dir, THICK)).select("img", "r", "c", "mask")


_MASK = "sum(CASE (b.r - a.r, b.c - a.c) " + " ".join(f"WHEN ({dr}, {dc}) THEN {1 << k}" for k, (dr, dc) in enumerate(raster.NEIGHBOURS)) + " ELSE 0 END)"
_MASKED = f"{fx.CELLS}, s AS (SELECT kind AS img, r, c FROM cell WHERE {THICK}), m AS (SELECT a.img, a.r, a.c, CAST({_MASK} AS INTEGER) AS mask FROM s a JOIN s b ON a.img = b.img AND {_STEP8} GROUP BY 1, 2, 3)"
_B = [f"(mask >> {k} & 1)" for k in range(8)]
_TURNS = "(" + " + ".join(f"CASE WHEN {_B[k]} = 0 AND {_B[(k + 1) % 8]} = 1 THEN 1 ELSE 0 END" for k in range(8)) + ")"


def thin_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.thin_step(_cells(spark, sf_dir, THICK), second=False)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.end_and_branch_points(_cells(spark, sf_dir, THICK))


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.thinned(_cells(spark, sf_dir, THICK))


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir, THICK)
    seeds = _cells(spark, sf_dir, PEAK).withColumn("source", F.col("r") * 100 + F.col("c"))
    return raster.grown(seeds, cells, 3)


GROWN_SQL = f"""
WITH {fx.CELLS}, s AS (SELECT kind AS img, r, c FROM cell WHERE {THICK}), g0 AS (SELECT kind AS img, r, c, r * 100 + c AS source FROM cell WHERE {PEAK}),
""" + ",\n".join(f"g{n} AS (SELECT * FROM g{n - 1} UNION ALL SELECT a.img, a.r, a.c, min(b.source) FROM s a JOIN g{n - 1} b ON a.img = b.img AND {_STEP8} ANTI JOIN g{n - 1} o ON o.img = a.img AND o.r = a.r AND o.c = a.c GROUP BY 1, 2, 3)" for n in (1, 2, 3)) + " SELECT * FROM g3"  # noqa: ISC003


def in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.segments(spark, sf_dir).select("vec_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return raster.in_polygon(p, [(-100.0, -120.0), (150.0, -60.0), (60.0, 140.0), (0.0, 20.0)]).select("vec_id")


def tight_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.tight_box(_cells(spark, sf_dir, PEAK))


_POLYGON = [(-100.0, -120.0), (150.0, -60.0), (60.0, 140.0), (0.0, 20.0)]
_HITS = " + ".join(f"CASE WHEN {min(b, d)} <= y1 AND y1 < {max(b, d)} AND x1 < ({c} - ({a})) * (y1 - ({b})) / ({d} - ({b})) + ({a}) THEN 1 ELSE 0 END" for (a, b), (c, d) in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1]))

QUERIES = {
    "q_mask_algebra": mask_algebra,
    "q_components": components,
    "q_fill_holes": fill_holes,
    "q_clear_border": clear_border,
    "q_box_mean": box_mean,
    "q_erode": erode,
    "q_dilate": dilate,
    "q_opened": opened,
    "q_adaptive_threshold": threshold,
    "q_row_distance": row_distance,
    "q_distance_transform": distance_transform,
    "q_feature_transform": feature_transform,
    "q_medial_axis": medial_axis,
    "q_neighbour_mask": neighbour_mask,
    "q_thin_step": thin_step,
    "q_skeleton_points": points,
    "q_skeleton": skeleton,
    "q_geodesic_growth": grown,
    "q_polygon_mask": in_polygon,
    "q_tight_box": tight_box,
}
SQL = {
    "q_mask_algebra": MASK_SQL,
    "q_components": COMPONENTS_SQL,
    "q_fill_holes": FILL_SQL,
    "q_clear_border": f"WITH {fx.CELLS} SELECT DISTINCT kind AS img, r // 3 AS r, c // 3 AS c FROM cell WHERE {SPARSE} AND r // 3 BETWEEN 1 AND 14 AND c // 3 BETWEEN 1 AND 14",
    "q_box_mean": f"WITH {_GRID.format(SPARSE)}, w AS ({_AROUND.format('avg(b.v)', 2)}) SELECT img, r, c, round(v, 6) AS v FROM w",
    "q_erode": f"WITH {_GRID.format(THICK)} {_AROUND.format('min(b.v)', 1)}",
    "q_dilate": f"WITH {_GRID.format(SPARSE)} {_AROUND.format('max(b.v)', 1)}",
    "q_opened": f"WITH {_GRID.format('true')}, e AS ({_AROUND.format('min(b.v)', 1)}) {_AROUND.format('max(b.v)', 1).replace('FROM g a JOIN g b', 'FROM e a JOIN e b')}",
    "q_adaptive_threshold": THRESHOLD_SQL,
    "q_row_distance": f"WITH {_GRID.format(SPARSE)} SELECT a.img, a.r, a.c, coalesce(min(abs(a.c - b.c)), -1) AS d FROM g a LEFT JOIN g b ON a.img = b.img AND a.r = b.r AND b.v = 1 GROUP BY 1, 2, 3",
    "q_distance_transform": f"SELECT img, r, c, d2 FROM ({FEATURE_SQL})",
    "q_feature_transform": FEATURE_SQL,
    "q_neighbour_mask": f"WITH {_MASKED} SELECT * FROM m",
    "q_thin_step": f"WITH {_MASKED} SELECT img, r, c FROM m WHERE NOT (bit_count(mask) BETWEEN 2 AND 6 AND {_TURNS} = 1 AND {_B[0]} * {_B[2]} * {_B[4]} = 0 AND {_B[2]} * {_B[4]} * {_B[6]} = 0)",
    "q_skeleton_points": f"WITH {_MASKED} SELECT img, r, c, CASE WHEN {_TURNS} <= 1 AND bit_count(mask) <= 2 THEN 'end' WHEN {_TURNS} >= 3 THEN 'branch' ELSE 'inner' END AS kind FROM m",
    "q_geodesic_growth": GROWN_SQL,
    "q_polygon_mask": f"WITH {fx.SEGMENTS} SELECT vec_id FROM seg WHERE ({_HITS}) % 2 = 1",
    "q_tight_box": f"WITH {fx.CELLS}, s AS (SELECT kind AS img, r, c FROM cell WHERE {PEAK}) SELECT img, r - min(r) OVER (PARTITION BY img) AS r, c - min(c) OVER (PARTITION BY img) AS c FROM s",
}
