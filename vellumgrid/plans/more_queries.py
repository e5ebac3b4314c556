"""Queries on transforms, joins at vertices, probes and moved images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as g
from vellumgrid.operators import raster, streets
from vellumgrid.plans import fixtures as fx
from vellumgrid.plans import geometry_sql as q
from vellumgrid.plans.raster_queries import _cells, _plane


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, line = fx.segments(spark, sf_dir), g.Segment.named()
    ax, ay = g.from_end(line, F.lit(10.0), F.lit(-4.0))
    mx, my = g.from_middle(line, F.lit(3.0), F.lit(7.0))
    ex, ey = g.farther_end(line, F.lit(0.0), F.lit(0.0))
    box = g.corners(line, F.lit(12.0))
    r = lambda c, n: F.round(c, 5).alias(n)
    return s.select("vec_id", ax.alias("ax"), ay.alias("ay"), mx.alias("mx"), my.alias("my"), r(ex, "ex"), r(ey, "ey"), r(box[0]["x"], "tlx"), r(box[2]["y"], "bry"), g.upright(*g.unit(line)).alias("turn"))


_L = q.length("")
_UX, _UY = f"((x2-x1)/{_L})", f"((y2-y1)/{_L})"
TRANSFORM_SQL = f"""
WITH {fx.SEGMENTS} SELECT vec_id, CAST(trunc(x1 + {_UX}*10 + {_UY}*4) AS BIGINT) AS ax, CAST(trunc(y1 + {_UY}*10 - {_UX}*4) AS BIGINT) AS ay,
  CAST(trunc((3-(x1+x2)/2)*{_UX} + (7-(y1+y2)/2)*{_UY}) AS BIGINT) AS mx, CAST(trunc(-(3-(x1+x2)/2)*{_UY} + (7-(y1+y2)/2)*{_UX}) AS BIGINT) AS my,
  round(CASE WHEN x1*x1+y1*y1 > x2*x2+y2*y2 THEN x1 ELSE x2 END, 5) AS ex, round(CASE WHEN x1*x1+y1*y1 > x2*x2+y2*y2 THEN y1 ELSE y2 END, 5) AS ey,
  round(x1 - {_UY}*6, 5) AS tlx, round(y2 - {_UX}*6, 5) AS bry, ({_UX} < -0.1 AND -{_UY} > 0) OR ({_UX} < 0.1 AND -{_UY} < 0) AS turn FROM seg"""


def vertex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends on a grid of 40, so that they meet."""
    lines = fx.lines(spark, sf_dir).select("line_id", *(F.round(F.col(c) / 40).alias(c) for c in ("x1", "y1", "x2", "y2")))
    p = streets.vertex_pairs(lines)
    return p.select("vx", "vy", "a", "b", F.round("score", 5).alias("score"))


VERTEX_SQL = f"""
WITH {fx.SEGMENTS}, l AS (SELECT vec_id AS line_id, round(x1/40) AS x1, round(y1/40) AS y1, round(x2/40) AS x2, round(y2/40) AS y2 FROM seg),
e AS (SELECT line_id, x1 AS vx, y1 AS vy, x2-x1 AS dx, y2-y1 AS dy FROM l UNION ALL SELECT line_id, x2, y2, x1-x2, y1-y2 FROM l),
p AS (SELECT a.vx, a.vy, a.line_id AS a, b.line_id AS b, (a.dx*b.dx+a.dy*b.dy)/(sqrt(a.dx*a.dx+a.dy*a.dy)*sqrt(b.dx*b.dx+b.dy*b.dy)) AS k
  FROM e a JOIN e b ON a.vx = b.vx AND a.vy = b.vy AND a.line_id < b.line_id WHERE (a.dx <> 0 OR a.dy <> 0) AND (b.dx <> 0 OR b.dy <> 0))
SELECT CAST(vx AS BIGINT) AS vx, CAST(vy AS BIGINT) AS vy, a, b, round(1.5 * k, 5) AS score FROM p WHERE k <= -0.8 AND k <= -sqrt(3)/2 AND 1.5 * k <= -1.1"""


def flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments over eight, moved into the grid."""
    lines = fx.lines(spark, sf_dir).select("line_id", *((F.col(c) / 8 + 24).alias(c) for c in ("x1", "y1", "x2", "y2")))
    found = streets.flood_evidence(lines, _plane(spark, sf_dir, "click"), _plane(spark, sf_dir, "view"))
    return found.select("line_id", F.round("flood_p", 5).alias("flood_p"), F.round("flood_n", 5).alias("flood_n"))


_SIDE = "0.5*f{0}l + 0.5*f{0}s + 0.4*m{0}l + 0.4*m{0}s - 0.5*f{1}l + 0.3*m{1}l"
FLOOD_SQL = f"""
WITH {fx.SEGMENTS}, {fx.CELLS}, l AS (SELECT vec_id AS line_id, x1/8+24 AS x1, y1/8+24 AS y1, x2/8+24 AS x2, y2/8+24 AS y2 FROM seg),
p AS (SELECT line_id, name, CAST(trunc(x1 + {_UX}*({_L}/2) - {_UY}*d) AS INTEGER) AS c, CAST(trunc(y1 + {_UY}*({_L}/2) + {_UX}*d) AS INTEGER) AS r FROM l, (VALUES ('pl', 15.0), ('ps', 5.0), ('ns', -5.0), ('nl', -15.0)) AS t(name, d)),
s AS (SELECT line_id, name, CASE WHEN EXISTS (SELECT 1 FROM cell WHERE kind = 'click' AND cell.r = p.r AND cell.c = p.c) THEN 1 ELSE 0 END AS f, CASE WHEN EXISTS (SELECT 1 FROM cell WHERE kind = 'view' AND cell.r = p.r AND cell.c = p.c) THEN 0 ELSE 1 END AS m FROM p),
w AS (SELECT line_id, {", ".join(f"max({v}) FILTER (name = '{n}') AS {v}{n}" for v in "fm" for n in ("pl", "ps", "ns", "nl"))} FROM s GROUP BY 1)
SELECT line_id, round({_SIDE.format("p", "n")}, 5) AS flood_p, round({_SIDE.format("n", "p")}, 5) AS flood_n FROM w"""


def turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.turned(_cells(spark, sf_dir, fx.SPARSE), 30.0, 24.0, 24.0)


def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.centred(_cells(spark, sf_dir, fx.PEAK), 60, 64)


CENTRED_SQL = f"""
WITH {fx.CELLS}, s AS (SELECT kind AS img, r - min(r) OVER w AS r, c - min(c) OVER w AS c FROM cell WHERE {fx.PEAK} WINDOW w AS (PARTITION BY kind)),
z AS (SELECT *, max(r) OVER w + 1 AS h, max(c) OVER w + 1 AS v FROM s WINDOW w AS (PARTITION BY img))
SELECT img, CAST(r + (60 - h) // 2 AS INTEGER) AS r, CAST(c + (64 - v) // 2 AS INTEGER) AS c FROM z"""


def deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.deskew_slope(_cells(spark, sf_dir, fx.THICK)).select("img", F.round("slope", 6).alias("slope"))


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.fitted(_cells(spark, sf_dir, fx.THICK), 20)


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _plane(spark, sf_dir, "signup", fx.PEAK).withColumn("source", F.col("r") * 100 + F.col("c"))
    return raster.nearest_source(_plane(spark, sf_dir, "click"), sources, 4)


NEAREST_SQL = f"""
WITH {fx.CELLS}, s AS (SELECT r, c, r * 100 + c AS source FROM cell WHERE kind = 'signup' AND {fx.PEAK}),
n AS (SELECT a.r, a.c, s.source, (a.r-s.r)*(a.r-s.r)+(a.c-s.c)*(a.c-s.c) AS d2 FROM cell a, s WHERE a.kind = 'click')
SELECT r, c, source, d2 FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d2, source) AS k FROM n WHERE d2 <= 16) WHERE k = 1"""


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cells(spark, sf_dir, fx.PEAK).withColumn("d2", F.col("r") % 3 * (F.col("r") % 3) + 1)
    return raster.grown_disks(d)


DISK_SQL = f"WITH {fx.CELLS}, s AS (SELECT kind AS img, r, c, (r % 3) * (r % 3) + 1 AS d2 FROM cell WHERE {fx.PEAK}) SELECT DISTINCT img, CAST(s.r + a AS INTEGER) AS r, CAST(s.c + b AS INTEGER) AS c FROM s, range(-3, 4) AS x(a), range(-3, 4) AS y(b) WHERE a * a + b * b < d2"

FIT_SQL = f"""
WITH {fx.CELLS}, s AS (SELECT kind AS img, r - min(r) OVER w AS r, c - min(c) OVER w AS c FROM cell WHERE {fx.THICK} WINDOW w AS (PARTITION BY kind)),
n AS (SELECT *, greatest(max(r) OVER w, max(c) OVER w) + 1 AS n FROM s WINDOW w AS (PARTITION BY img)), f AS (SELECT DISTINCT img, r * 20 // n AS r, c * 20 // n AS c FROM n),
t AS (SELECT img, r - min(r) OVER w AS r, c - min(c) OVER w AS c FROM f WINDOW w AS (PARTITION BY img)), z AS (SELECT *, max(r) OVER w + 1 AS h, max(c) OVER w + 1 AS v FROM t WINDOW w AS (PARTITION BY img))
SELECT img, CAST(r + (20 - h) // 2 AS INTEGER) AS r, CAST(c + (20 - v) // 2 AS INTEGER) AS c FROM z"""

QUERIES = {
    "q_line_transforms": transforms,
    "q_vertex_pairs": vertex_pairs,
    "q_flood_evidence": flood,
    "q_rotate": turned,
    "q_centre": centred,
    "q_deskew": deskew,
    "q_fit_square": fitted,
    "q_nearest_curb": nearest,
    "q_disks": disks,
}
SQL = {
    "q_line_transforms": TRANSFORM_SQL,
    "q_vertex_pairs": VERTEX_SQL,
    "q_flood_evidence": FLOOD_SQL,
    "q_rotate": f"WITH {fx.CELLS}, s AS (SELECT kind AS img, r - 24 AS r, c - 24 AS c FROM cell WHERE {fx.SPARSE}) SELECT DISTINCT img, CAST(floor(24 + r * cos(radians(30)) - c * sin(radians(30)) + 0.5) AS INTEGER) AS r, CAST(floor(24 + r * sin(radians(30)) + c * cos(radians(30)) + 0.5) AS INTEGER) AS c FROM s",
    "q_centre": CENTRED_SQL,
    "q_fit_square": FIT_SQL,
    "q_deskew": f"WITH {fx.CELLS} SELECT kind AS img, round(-covar_pop(r, c) / var_pop(r), 6) AS slope FROM cell WHERE {fx.THICK} GROUP BY 1",
    "q_nearest_curb": NEAREST_SQL,
    "q_disks": DISK_SQL,
}
