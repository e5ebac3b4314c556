"""Queries on single rules: points and pixels, letters of a word, graphs of lines and skeletons, splits and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import arrays
from vellumgrid.functions import geometry as g
from vellumgrid.operators import graphs, metrics, raster, streets, text, words
from vellumgrid.plans import fixtures as fx
from vellumgrid.plans import geometry_sql as q
from vellumgrid.plans.raster_queries import _cells, _plane

_L = q.length("")


def _r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, line = g.scaled(fx.segments(spark, sf_dir).withColumn("extent", F.abs("x1")), 0.25, "extent"), g.Segment.named()
    zero = F.lit(0.0)
    return s.select("vec_id", _r("extent", "extent"), _r("x2", "x2"), g.turn(line.x1, line.y1, line.x2, line.y2, zero, zero).alias("turn"), _r(g.dot(line, line), "dot"), _r(g.square_distance(line), "square"), _r(g.chebyshev(line), "chebyshev"))


POINTS_SQL = f"""
WITH {fx.SEGMENTS}, s AS (SELECT vec_id, abs(x1) * 0.25 AS extent, x1 * 0.25 AS x1, y1 * 0.25 AS y1, x2 * 0.25 AS x2, y2 * 0.25 AS y2 FROM seg), d AS (SELECT *, pow(x2-x1, 2) + pow(y2-y1, 2) AS sq FROM s)
SELECT vec_id, round(extent, 6) AS extent, round(x2, 6) AS x2, CAST(sign(-(x2-x1)*y1 + (y2-y1)*x1) AS INTEGER) AS turn, round(sq, 6) AS dot, round(sq, 6) AS square, round(greatest(abs(x2-x1), abs(y2-y1)), 6) AS chebyshev FROM d"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings")
    value = lambda k: F.floor(F.abs(fx.component(k, 1000.0))) % 256
    light = arrays.luminance(value(0), value(1), value(2))
    return e.select("vec_id", _r(light, "luminance"), (light >= 128).alias("bright"), _r(arrays.normalised(value(3) / 255), "normal"), _r(1 - value(3) / 255, "inverted"), arrays.half_even(F.col("vec_id") / 8, 2).alias("rounded"))


_V = "CAST(floor(abs(CAST(embedding[{}] AS DOUBLE) * 1000)) AS BIGINT) % 256"
PIXELS_SQL = f"""
WITH v AS (SELECT vec_id, {", ".join(f"{_V.format(k + 1)} AS v{k}" for k in range(4))} FROM embeddings), l AS (SELECT *, 0.2126::DOUBLE * v0 + 0.7152::DOUBLE * v1 + 0.0722::DOUBLE * v2 AS lum FROM v)
SELECT vec_id, round(lum, 6) AS luminance, lum >= 128 AS bright, round((v3 / 255.0 - 0.5) / 0.5, 6) AS normal, round(1 - v3 / 255.0, 6) AS inverted, round_even(vec_id / 8.0::DOUBLE, 2) AS rounded FROM l"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100).alias("x1"), (F.col("doc_id") % 100 + F.col("n_chars") % 110).alias("x2"))
    start, end = words.slot(F.col("x1"), F.col("x2"))
    return d.select("doc_id", start.cast("int").alias("start"), end.alias("end_"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 400 + 1).cast("int").alias("width"))
    return words.profile_windows(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("x1").alias("last"), F.max("x2").alias("right_"))


def upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = g.Segment.named()
    return fx.segments(spark, sf_dir).select("vec_id", F.array_join(arrays.read_upright(F.array(F.lit("a"), F.lit("b"), F.lit("c")), g.upright(*g.unit(line))), "").alias("letters"))


_UX, _UY = f"((x2-x1)/{_L})", f"((y2-y1)/{_L})"
UPRIGHT_SQL = f"WITH {fx.SEGMENTS} SELECT vec_id, CASE WHEN ({_UX} < -0.1 AND -{_UY} > 0) OR ({_UX} < 0.1 AND -{_UY} < 0) THEN 'cba' ELSE 'abc' END AS letters FROM seg"


def letter_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of 26 letters from an embedding, widths from the id."""
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 26), lambda x: F.abs(x.cast("double"))).alias("w"))
    chosen = e.select("vec_id", words.letter_choice(F.col("w"), F.col("vec_id") % 60).alias("x"))
    return chosen.select("vec_id", "x.letter", _r("x.p", "p"), "x.kept")


LETTER_SQL = """
WITH e AS (SELECT vec_id, vec_id % 60 AS width, list_transform(embedding[1:26], lambda x: abs(CAST(x AS DOUBLE))) AS w FROM embeddings),
b AS (SELECT *, list_max(w) AS best, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', list_position(w, list_max(w)), 1) AS first FROM e),
n AS (SELECT *, width <= 12 AND (first = 'I' OR (best < 0.5 AND w[9] > 0.2)) AS narrow FROM b), l AS (SELECT *, CASE WHEN narrow THEN 'I' ELSE first END AS letter FROM n)
SELECT vec_id, letter, round(CASE WHEN narrow THEN 0.93 ELSE best / list_sum(w) END, 6) AS p, NOT ((width > 48 AND letter NOT IN ('M', 'W')) OR (width > 16 AND letter = 'I')) AS kept FROM l"""


def false_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at most 40 events of a user."""
    e = fx.table(spark, sf_dir, "events")
    rows = e.select(F.concat_ws(":", "user_id", F.floor(F.col("event_id") / 2000)).alias("word_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 5 < 3, "I").otherwise("T").alias("letter"), ((F.col("event_id") * 37 % 100) / 100.0).alias("weight"))
    return words.without_false_i(rows).select("word_id", "pos", "letter")


FALSE_I_SQL = """
WITH RECURSIVE e AS (SELECT concat_ws(':', CAST(user_id AS VARCHAR), CAST(CAST(floor(event_id / 2000) AS BIGINT) AS VARCHAR)) AS word_id, event_id AS pos, CASE WHEN event_id % 5 < 3 THEN 'I' ELSE 'T' END AS letter, (event_id * 37 % 100) / 100.0 AS weight FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY pos) AS k FROM e),
s AS (SELECT word_id, k, pos, letter, letter <> 'I' OR weight >= 0.42 AS kept FROM n WHERE k = 1
  UNION ALL SELECT n.word_id, n.k, n.pos, n.letter, n.letter <> 'I' OR (n.weight >= 0.42 AND NOT (s.kept AND s.letter = 'I')) FROM s JOIN n ON n.word_id = s.word_id AND n.k = s.k + 1)
SELECT word_id, pos, letter FROM s WHERE kept"""


def word_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five characters make a word, in a row by their ids with jitter from the table."""
    c = fx.characters(spark, sf_dir).select((F.col("char_id") - F.col("char_id") % 5).alias("word_id"), (F.col("char_id") % 5 * 15 + F.col("from_curb") * 0.2).alias("x"), (F.col("from_middle") * 0.15 + 20).alias("y"), (F.col("area") % 60 + 12).alias("area"), F.lit(30).alias("rows"))
    return words.check_words(c, words.PLAIN_WORD)


WORD_SQL = f"""
WITH {fx.CHARACTERS}, p AS (SELECT char_id - char_id % 5 AS word_id, CAST(trunc(char_id % 5 * 15 + from_curb * 0.2) AS INTEGER) AS x, CAST(trunc(from_middle * 0.15 + 20) AS INTEGER) AS y, area % 60 + 12 AS area FROM ch),
a AS (SELECT word_id, count(*) AS parts, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t, bool_and(area BETWEEN 15 AND 66) AS fit FROM p GROUP BY 1),
o AS (SELECT *, (x-mx)*cos(t)+(y-my)*sin(t) AS u, (y-my)*cos(t)-(x-mx)*sin(t) AS v FROM p JOIN a USING (word_id)),
d AS (SELECT *, u - lag(u) OVER (PARTITION BY word_id ORDER BY u) AS space FROM o)
SELECT word_id, parts, coalesce(parts >= 2 AND fit AND max(v) - min(v) <= 6.0 AND abs(sin(t)) <= 0.2 AND min(space) >= 6 AND max(space) <= 26, false) AS passes FROM d GROUP BY word_id, parts, fit, t"""


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.segments(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("group_id"), "x1", "y1", "x2", "y2", (F.col("label") == 9).alias("ignore"))
    return streets.long_lines(s, 900.0).select("group_id", _r("length", "length"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the next one; evidence from components 20 to 23."""
    e = fx.table(spark, sf_dir, "embeddings")
    side = lambda k: [*(fx.component(n, 1000.0).alias(f"{k}{c}") for n, c in enumerate(("x1", "y1", "x2", "y2"))), (F.abs(fx.component(20, 3.0))).alias(f"{k}score_p"), (F.abs(fx.component(21, 3.0))).alias(f"{k}score_n")]
    a, b = e.select(F.col("vec_id").alias("a"), *side("a_")), e.select((F.col("vec_id") - 1).alias("a"), *side("b_"))
    return streets.facing(a.join(b, "a")).select("a")


_MX, _MY = "(trunc(({0}x1+{0}x2)/2))", "(trunc(({0}y1+{0}y2)/2))"


def _faces(k: str, j: str) -> str:
    return q.beside(k, f"{_MX.format(j)}-{_MX.format(k)}", f"{_MY.format(j)}-{_MY.format(k)}")


CANDIDATE_SQL = f"""
WITH {fx.SEGMENTS}, s AS (SELECT seg.*, abs(CAST(embedding[21] AS DOUBLE) * 3) AS score_p, abs(CAST(embedding[22] AS DOUBLE) * 3) AS score_n FROM seg JOIN embeddings USING (vec_id)),
p AS (SELECT a.vec_id AS a, {", ".join(f"{k}.{c} AS {k}_{c}" for k in "ab" for c in ("x1", "y1", "x2", "y2", "score_p", "score_n"))} FROM s a JOIN s b ON b.vec_id = a.vec_id + 1)
SELECT a FROM p WHERE (CASE WHEN {_faces("a_", "b_")} THEN a_score_p ELSE a_score_n END) > 0.3 AND (CASE WHEN {_faces("b_", "a_")} THEN b_score_p ELSE b_score_n END) > 0.3"""


def carvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, line = fx.segments(spark, sf_dir), g.Segment.named()
    ux, uy = g.unit(line)
    return s.select("vec_id", streets.carvable(line.length * 3, ux, uy, F.lit(0.8), F.lit(0.6)).alias("carved"))


def polyline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.segments(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("group_id"), F.col("vec_id").alias("line_id"), "x1", "y1", "x2", "y2")
    starts = s.groupBy("group_id").agg(F.min_by("x1", "line_id").alias("x"), F.min_by("y1", "line_id").alias("y"))
    return graphs.in_order(s, starts).select("group_id", "line_id", "pos")


ORDER_SQL = f"""
WITH {fx.SEGMENTS}, s AS (SELECT vec_id // 8 AS group_id, vec_id AS line_id, x1, y1, x2, y2 FROM seg), b AS (SELECT group_id, arg_min(x1, line_id) AS x, arg_min(y1, line_id) AS y FROM s GROUP BY 1)
SELECT group_id, line_id, row_number() OVER (PARTITION BY group_id ORDER BY least(pow(x1-x,2)+pow(y1-y,2), pow(x2-x,2)+pow(y2-y,2)), line_id) AS pos FROM s JOIN b USING (group_id)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.lines(spark, sf_dir).select("line_id", *(F.round(F.col(c) / 40).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return graphs.graph_of_lines(graphs.alone(lines)).select("line_id", "v1", "v2")


GRAPH_SQL = f"""
WITH {fx.SEGMENTS}, l AS (SELECT vec_id AS line_id, round(x1/40) AS x1, round(y1/40) AS y1, round(x2/40) AS x2, round(y2/40) AS y2 FROM seg),
e AS (SELECT line_id, 0 AS k, x1 AS x, y1 AS y FROM l UNION ALL SELECT line_id, 1, x2, y2 FROM l), v AS (SELECT *, min(2 * line_id + k) OVER (PARTITION BY x, y) AS vertex FROM e)
SELECT line_id, max(vertex) FILTER (k = 0) AS v1, max(vertex) FILTER (k = 1) AS v2 FROM v GROUP BY 1"""


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four segments make a branch."""
    return fx.segments(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("branch"), F.col("vec_id").alias("way"), (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))


def around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.around(_ways(spark, sf_dir)).select("branch", "way", "turn")


def farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.farthest_pair(_ways(spark, sf_dir))


_WAYS = f"{fx.SEGMENTS}, w AS (SELECT vec_id // 4 AS branch, vec_id AS way, x2-x1 AS dx, y2-y1 AS dy, {_L} AS n FROM seg)"
FARTHEST_SQL = f"""
WITH {_WAYS}, p AS (SELECT a.branch, a.way AS a, b.way AS b, round(pow(a.dx/a.n-b.dx/b.n,2)+pow(a.dy/a.n-b.dy/b.n,2), 9) AS d FROM w a JOIN w b ON a.branch = b.branch AND a.way < b.way)
SELECT branch, a, b FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY d DESC, a, b) AS k FROM p) WHERE k = 1"""


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _cells(spark, sf_dir, fx.PEAK).select("img", (F.col("r") * 48 + F.col("c")).alias("point_id"), F.col("r").alias("x"), F.col("c").alias("y"), (F.col("r") % 5 * 4 + 1).alias("d2"))
    return graphs.within_disks(p, 5.0)


DISKS_SQL = f"""
WITH {fx.CELLS}, p AS (SELECT kind AS img, r * 48 + c AS id, r, c, ceil(sqrt(r % 5 * 4 + 1)) AS radius FROM cell WHERE {fx.PEAK})
SELECT a.img, a.id AS a, b.id AS b FROM p a JOIN p b ON a.img = b.img WHERE trunc(sqrt(pow(a.r-b.r,2)+pow(a.c-b.c,2))) <= a.radius"""


def branch_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("end"), F.col("n_chars").alias("branch"))
    return graphs.ends_of_branches(d).select("branch", F.array_join(F.transform("ends", lambda x: x.cast("string")), ",").alias("ends"))


def open_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.open_circle(_cells(spark, sf_dir, fx.SPARSE))


_RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
CIRCLE_SQL = f"""
WITH {fx.CELLS}, s AS (SELECT kind AS img, r, c FROM cell WHERE {fx.SPARSE}),
b AS (SELECT img, r, c, {" || ".join(f"CASE WHEN EXISTS (SELECT 1 FROM s t WHERE t.img = s.img AND t.r = s.r + {dr} AND t.c = s.c + {dc}) THEN '1' ELSE '0' END" for dr, dc in _RING)} AS ring FROM s)
SELECT img, r, c, contains(ring || substr(ring, 1, 5), '000000') AS is_end FROM b"""


def contour_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours are the peaks of one kind, told apart by thirds of the grid."""
    sources = _plane(spark, sf_dir, "signup", fx.PEAK).withColumn("source", F.col("r") * 100 + F.col("c"))
    near = raster.nearest_source(_plane(spark, sf_dir, "click"), sources, 4).select(F.lit("click").alias("img"), "r", "c", (F.col("source") % 3).alias("label"))
    return graphs.contour_axis(near)


AXIS_SQL = f"""
WITH {fx.CELLS}, s AS (SELECT r, c, r * 100 + c AS source FROM cell WHERE kind = 'signup' AND {fx.PEAK}),
n AS (SELECT a.r, a.c, s.source, (a.r-s.r)*(a.r-s.r)+(a.c-s.c)*(a.c-s.c) AS d2 FROM cell a, s WHERE a.kind = 'click'),
l AS (SELECT r, c, source % 3 AS label FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d2, source) AS k FROM n WHERE d2 <= 16) WHERE k = 1)
SELECT 'click' AS img, r, c FROM l WHERE EXISTS (SELECT 1 FROM l t WHERE t.label <> l.label AND ((t.r = l.r AND t.c = l.c + 1) OR (t.r = l.r + 1 AND t.c = l.c)))"""


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from documents: two rules on their lengths."""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chain_id"), (F.col("n_chars") % 23 / 2.0).alias("length"), (F.col("n_chars") % 7 / 2.0).alias("radius"), (F.col("doc_id") % 2 == 0).alias("has_end"), F.floor(F.col("doc_id") / 100).alias("img"))
    return graphs.by_length(graphs.cut_branches(d, 1.5)).select("img", "chain_id", "importance")


BRANCH_SQL = """
WITH d AS (SELECT doc_id AS chain_id, n_chars % 23 / 2.0 AS length, n_chars % 7 / 2.0 AS radius, doc_id % 2 = 0 AS has_end, doc_id // 100 AS img FROM documents)
SELECT img, chain_id, row_number() OVER (PARTITION BY img ORDER BY length, chain_id) AS importance FROM d WHERE NOT (has_end AND floor(length) <= ceil(radius * 1.5))"""


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = fx.table(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("street_id"), (F.col("event_id") % 40 * 7 % 30).alias("width"), (F.col("user_id") % 50).alias("r"), (F.col("event_id") % 61).alias("c"), F.abs("value").alias("distance"))
    return graphs.owners(strips)


OWNER_SQL = """
WITH s AS (SELECT event_id % 40 AS street_id, event_id % 40 * 7 % 30 AS width, user_id % 50 AS r, event_id % 61 AS c, abs(value) AS distance FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY width DESC, street_id) AS k, min(distance) OVER (PARTITION BY r, c) AS d FROM s) SELECT r, c, street_id, d AS distance FROM o WHERE k = 1"""


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = lambda kind: _plane(spark, sf_dir, kind, fx.PEAK).select(F.lit(1).alias("pair"), "r", "c", F.lit(48).alias("width"))
    return words.touching_overlap(image("click"), image("view"), pixels=3)


OVERLAP_SQL = f"""
WITH {fx.CELLS}, a AS (SELECT r, c FROM cell WHERE kind = 'click' AND {fx.PEAK}), b AS (SELECT r, c FROM cell WHERE kind = 'view' AND {fx.PEAK}),
m AS (SELECT 48 - a.c + b.c AS slide, count(*) AS n FROM a JOIN b USING (r) WHERE 48 - a.c + b.c BETWEEN 1 AND 8 GROUP BY 1)
SELECT 1 AS pair, CAST(least(8, coalesce((SELECT min(slide) FROM m WHERE n >= 3), 8)) AS INTEGER) AS overlap"""


def oriented_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _cells(spark, sf_dir).select("img").distinct().select("img", F.lit(9.5).alias("x"), F.lit(12.25).alias("y"), F.lit(0.8).alias("ux"), F.lit(0.6).alias("uy"), F.lit(25.0).alias("width"), F.lit(11.0).alias("height"))
    return raster.oriented_crop(_cells(spark, sf_dir, fx.SPARSE), boxes)


CROP_SQL = f"""
WITH {fx.CELLS}, o AS (SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(trunc(12.25::DOUBLE + c * 0.6::DOUBLE + (r - 5) * 0.8::DOUBLE) AS INTEGER) AS sr, CAST(trunc(9.5::DOUBLE + c * 0.8::DOUBLE - (r - 5) * 0.6::DOUBLE) AS INTEGER) AS sc FROM range(11) AS x(r), range(25) AS y(c))
SELECT kind AS img, o.r, o.c FROM o JOIN cell ON cell.r = sr AND cell.c = sc WHERE {fx.SPARSE}"""


def splat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.splat(_cells(spark, sf_dir, fx.SPARSE), 24.0, 20.0, 0.8, 0.6)


def by_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = raster.components(_cells(spark, sf_dir, fx.PEAK))
    return raster.by_middle(parts).select("img", "component", _r("x", "x"), "place")


MIDDLE_SQL = f"""
WITH RECURSIVE {fx.CELLS}, s AS (SELECT kind AS img, r, c, r * 48 + c AS id FROM cell WHERE {fx.PEAK}),
reach AS (SELECT img, id AS a, id AS b FROM s UNION SELECT reach.img, reach.a, t.id FROM reach JOIN s f ON f.img = reach.img AND f.id = reach.b JOIN s t ON t.img = f.img AND abs(t.r - f.r) <= 1 AND abs(t.c - f.c) <= 1),
root AS (SELECT img, a AS id, min(b) AS root FROM reach GROUP BY 1, 2),
m AS (SELECT img, concat(root // 48, ':', root % 48) AS component, avg(c) AS x FROM root JOIN s USING (img, id) GROUP BY 1, 2)
SELECT img, component, round(x, 6) AS x, row_number() OVER (PARTITION BY img ORDER BY x, component) AS place FROM m"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _cells(spark, sf_dir, fx.SPARSE).withColumns({"ux": F.lit(0.8), "uy": F.lit(0.6)})
    e = raster.extents_along(p)
    return e.select("img", _r("width", "width"), _r("height", "height"), _r("box_x", "box_x"), _r("box_y", "box_y"), F.col("low_along.r").alias("low_r"), F.col("low_along.c").alias("low_c"), F.col("high_across.r").alias("high_r"), F.col("high_across.c").alias("high_c"))


EXTENT_SQL = f"""
WITH {fx.CELLS}, s AS (SELECT kind AS img, r, c, avg(c) OVER (PARTITION BY kind) AS mx, avg(r) OVER (PARTITION BY kind) AS my FROM cell WHERE {fx.SPARSE}),
p AS (SELECT *, round((c-mx)*0.8+(r-my)*0.6, 9) AS u, round((r-my)*0.8-(c-mx)*0.6, 9) AS v FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY u, r, c) AS first, row_number() OVER (PARTITION BY img ORDER BY v DESC, r, c) AS last FROM p)
SELECT img, round(max(u)-min(u), 6) AS width, round(max(v)-min(v), 6) AS height, round(any_value(mx) + (max(u)+min(u))/2*0.8 - (max(v)+min(v))/2*0.6, 6) AS box_x, round(any_value(my) + (max(u)+min(u))/2*0.6 + (max(v)+min(v))/2*0.8, 6) AS box_y,
  max(r) FILTER (first = 1) AS low_r, max(c) FILTER (first = 1) AS low_c, max(r) FILTER (last = 1) AS high_r, max(c) FILTER (last = 1) AS high_c FROM k GROUP BY 1"""


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings")
    one = e.select(F.col("vec_id").alias("sample_id"), "label")
    two = e.select(F.col("vec_id").alias("sample_id"), (F.array_position(F.slice("embedding", 1, 10), F.array_max(F.slice("embedding", 1, 10))) - 1).cast("int").alias("label"))
    return metrics.compare_models(one, two)


def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("words/"), "doc_id").alias("path"))
    known = fx.table(spark, sf_dir, "labels").select(F.concat(F.lit("words/"), "doc_id").alias("path"), "quality")
    return d.join(known, "path").select("path", "quality")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id")
    two = text.split_by_position(d, "doc_id", (80, 20), ("train", "validation")).select("doc_id", F.col("part").alias("two"))
    three = text.split_by_position(d, "doc_id", (60, 20, 20)).select("doc_id", F.col("part").alias("three"))
    return two.join(three, "doc_id")


SPLIT_SQL = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= n * 80 // 100 THEN 'train' ELSE 'validation' END AS two, CASE WHEN k <= n * 60 // 100 THEN 'train' WHEN k <= n * 80 // 100 THEN 'validation' ELSE 'test' END AS three FROM r"""

QUERIES = {
    "q_point_algebra": points,
    "q_pixel_values": pixels,
    "q_window_slots": slots,
    "q_profile_windows": windows,
    "q_read_upright": upright,
    "q_letter_choice": letter_i,
    "q_false_letters": false_i,
    "q_word_check": word_check,
    "q_long_lines": eligible,
    "q_facing_lines": candidates,
    "q_carvable_streets": carvable,
    "q_polyline_order": polyline_order,
    "q_line_graph": graph,
    "q_ways_around": around,
    "q_farthest_ways": farthest,
    "q_branch_disks": disks,
    "q_branch_ends": branch_ends,
    "q_open_circle": open_circle,
    "q_contour_axis": contour_axis,
    "q_branch_cut": branches,
    "q_street_owners": owners,
    "q_touching_overlap": overlap,
    "q_oriented_crop": oriented_crop,
    "q_splat": splat,
    "q_components_by_middle": by_middle,
    "q_extents_along": extents,
    "q_model_agreement": agreement,
    "q_path_labels": path_labels,
    "q_splits": splits,
}
SQL = {
    "q_point_algebra": POINTS_SQL,
    "q_pixel_values": PIXELS_SQL,
    "q_window_slots": "WITH d AS (SELECT doc_id, n_chars % 110 AS w FROM documents) SELECT doc_id, CAST(greatest(0, trunc((72 - w) / 2.0)) AS INTEGER) AS start, CAST(least(greatest(0, trunc((72 - w) / 2.0)) + w, 72) AS INTEGER) AS end_ FROM d",
    "q_profile_windows": "WITH d AS (SELECT doc_id, n_chars % 400 + 1 AS w FROM documents) SELECT doc_id, greatest(0, w - 72) // 8 + 1 AS n, CAST(greatest(0, w - 72) // 8 * 8 AS INTEGER) AS last, CAST(least(greatest(0, w - 72) // 8 * 8 + 72, w) AS INTEGER) AS right_ FROM d",
    "q_read_upright": UPRIGHT_SQL,
    "q_letter_choice": LETTER_SQL,
    "q_false_letters": FALSE_I_SQL,
    "q_word_check": WORD_SQL,
    "q_long_lines": f"WITH {fx.SEGMENTS} SELECT vec_id // 4 AS group_id, round(sum({_L}), 6) AS length FROM seg GROUP BY 1 HAVING NOT bool_or(label = 9) AND sum({_L}) >= 900",
    "q_facing_lines": CANDIDATE_SQL,
    "q_carvable_streets": f"WITH {fx.SEGMENTS} SELECT vec_id, NOT (({_L} * 3 < 600 AND abs({_UX} * 0.8 + {_UY} * 0.6) < 0.8) OR {_L} * 3 < 100) AS carved FROM seg",
    "q_polyline_order": ORDER_SQL,
    "q_line_graph": GRAPH_SQL,
    "q_ways_around": f"WITH {_WAYS} SELECT branch, way, CAST(row_number() OVER (PARTITION BY branch ORDER BY atan2(dy, dx), way) AS INTEGER) AS turn FROM w",
    "q_farthest_ways": FARTHEST_SQL,
    "q_branch_disks": DISKS_SQL,
    "q_branch_ends": "SELECT n_chars AS branch, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ends FROM documents GROUP BY 1 HAVING count(*) >= 2",
    "q_open_circle": CIRCLE_SQL,
    "q_contour_axis": AXIS_SQL,
    "q_branch_cut": BRANCH_SQL,
    "q_street_owners": OWNER_SQL,
    "q_touching_overlap": OVERLAP_SQL,
    "q_oriented_crop": CROP_SQL,
    "q_splat": f"WITH {fx.CELLS} SELECT DISTINCT kind AS img, CAST(trunc((r-20.0)*0.8::DOUBLE-(c-24.0)*0.6::DOUBLE) AS INTEGER) AS r, CAST(trunc((c-24.0)*0.8::DOUBLE+(r-20.0)*0.6::DOUBLE) AS INTEGER) AS c FROM cell WHERE {fx.SPARSE}",
    "q_components_by_middle": MIDDLE_SQL,
    "q_extents_along": EXTENT_SQL,
    "q_model_agreement": "WITH p AS (SELECT label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS other FROM embeddings) SELECT label, count(*) AS n, count(*) FILTER (label = other) AS agree FROM p GROUP BY 1",
    "q_path_labels": "SELECT 'words/' || d.doc_id AS path, quality FROM documents d JOIN labels l USING (doc_id)",
    "q_splits": SPLIT_SQL,
}
