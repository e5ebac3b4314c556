"""Queries on characters, words and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.operators import characters
from vellumgrid.plans import fixtures as fx

_NEAR = """
placed AS (SELECT *, floor(x / 300) AS cx, floor(y / 300) AS cy FROM ch),
duo AS (
  SELECT a.char_id AS u, b.char_id AS v, a.x - b.x AS dx, a.y - b.y AS dy, a.width AS w1, b.width AS w2, a.height AS h1, b.height AS h2,
         greatest(floor(a.height), floor(b.height)) AS hh, greatest(floor(a.width), floor(b.width)) AS ww,
         a.from_curb + b.from_curb > a.from_middle + b.from_middle AS mid, a.height > 0.65 * a.width AS up1, b.height > 0.65 * b.width AS up2,
         2.5 * a.height < a.width OR 2.5 * b.height < b.width AS dash
  FROM placed a JOIN placed b ON a.char_id <> b.char_id AND a.area >= 30 AND b.area >= 30
    AND ((b.cx = a.cx AND b.cy = a.cy AND a.char_id < b.char_id) OR (b.cx - a.cx, b.cy - a.cy) IN ((1, 0), (0, 1), (1, 1)))
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 62500),
near AS (
  SELECT least(u, v) AS u, greatest(u, v) AS v FROM duo
  WHERE ((up1 OR up2) AND abs(dy) < hh * CASE WHEN mid THEN 0.35 ELSE 0.39 END AND abs(dx) < (w1 + w2) * CASE WHEN mid THEN 1.10 ELSE 0.77 END AND NOT (mid AND dash AND abs(dx) > ww * 0.3))
     OR (NOT up1 AND NOT up2 AND NOT mid AND abs(dx) < ww * 0.39 AND abs(dy) < (h1 + h2) * 0.77))"""
_WORDS = f"""{fx.CHARACTERS}, {_NEAR},
edge AS (SELECT u, v FROM near UNION SELECT v, u FROM near),
reach AS (SELECT char_id AS node, char_id AS top FROM ch UNION SELECT e.v, r.top FROM reach r JOIN edge e ON e.u = r.node),
word AS (SELECT node AS char_id, min(top) AS word_id FROM reach GROUP BY 1)"""


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characters.character_pairs(fx.characters(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characters.words(fx.characters(spark, sf_dir))


def _r(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(F.round(c, 5).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(characters.extents(fx.characters(spark, sf_dir)))


EXTENTS = """ext AS (
  SELECT group_id, count(*) AS points, max(x) - min(x) AS width, max(y) - min(y) AS height, greatest(0.0, sum(x * x) - count(*) * avg(x) * avg(x)) / (count(*) + 1) AS spread_w,
         greatest(0.0, sum(y * y) - count(*) * avg(y) * avg(y)) / (count(*) + 1) AS spread_h, (min(x) + max(x)) / 2 AS center_x, (min(y) + max(y)) / 2 AS center_y FROM ch GROUP BY 1)"""


def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(characters.line_fit(fx.characters(spark, sf_dir)))


def component_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.characters(spark, sf_dir).select("char_id", "area", F.col("width").alias("width"), "height", (F.col("from_curb") + 1).alias("spread_w"), (F.col("from_middle") + 1).alias("spread_h"))
    return characters.component_class(c).select("char_id", "is_marking", "is_line", "is_dash")


COMPONENT_SQL = f"""
WITH {fx.CHARACTERS}, f AS (
  SELECT char_id, area, area > 3500 AS large, area < 6 AS tiny, width, height, from_middle + 1 AS vh, width / height AS aspect,
         width < 140 AND height < 105 AND area * CAST(area AS DOUBLE) / ((from_curb + 1) * (from_middle + 1)) > 0.35 AND width / height < 13 AS fits FROM ch),
m AS (SELECT *, NOT large AND NOT tiny AND fits AS mark FROM f), d AS (SELECT *, mark AND aspect > 4 AND width > 10 AND (vh < 2.4 OR height < 8) AS dash FROM m)
SELECT char_id, mark AS is_marking, large OR (NOT tiny AND (NOT fits OR dash)) AS is_line, dash AS is_dash FROM d"""


def street_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.characters(spark, sf_dir).select("char_id", (F.col("area") * 200).alias("area"), (F.col("width") * 20).alias("width"), (F.col("height") * 3).alias("height"), (F.col("from_curb") * 40 + 1).alias("spread_w"), (F.col("from_middle") + 1).alias("spread_h"))
    return characters.street_class(c).select("char_id", "is_street")


STREET_CLASS_SQL = f"""
WITH {fx.CHARACTERS}, f AS (
  SELECT char_id, area * 200 AS area, width * 20 AS width, height * 3 AS height, from_curb * 40 + 1 AS vw, from_middle + 1 AS vh FROM ch),
d AS (SELECT *, area * CAST(area AS DOUBLE) / (256 * vw * vh) AS density FROM f)
SELECT char_id, (area > 15000 AND density < 0.8) OR (area <= 15000 AND area > 1000 AND density > 0.4 AND width > 120 AND vh < 60 AND height > 10 AND vw / vh > 10) AS is_street FROM d"""


def spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(characters.spacing(fx.characters(spark, sf_dir)))


_OUT = "greatest(0.0, {s} * ({x} - {b}), {s} * ({a} - {x}))"
_STREET_GAP, _NUMBER_GAP = _OUT.format(s=2, a=0.87, b=2.3, x="r"), _OUT.format(s=2, a=0.37, b=1.7, x="r")
SPACING_SQL = f"""
WITH {fx.CHARACTERS}, n AS (SELECT group_id, (lead(x) OVER w - x) / ((width + lead(width) OVER w) / 2) AS r FROM ch WINDOW w AS (PARTITION BY group_id ORDER BY x, char_id))
SELECT group_id, count(*) AS gaps, round(100 * avg({_STREET_GAP}), 5) AS street_penalty, round(100 * avg({_NUMBER_GAP}), 5) AS number_penalty FROM n WHERE r IS NOT NULL GROUP BY 1"""


def word_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are ids over five."""
    c = fx.characters(spark, sf_dir).withColumn("word_id", F.floor(F.col("char_id") / 5))
    return _r(characters.word_type(c))


_D = "(area / height)"
WORD_TYPE_SQL = f"""
WITH {fx.CHARACTERS}, a AS (SELECT *, char_id // 5 AS word_id FROM ch),
b AS (SELECT *, max(height) OVER (PARTITION BY word_id) AS hmax, count(*) OVER (PARTITION BY word_id) AS n, sum(area) OVER (PARTITION BY word_id) AS wa FROM a),
c AS (SELECT *, height / hmax AS q FROM b WHERE n >= 2),
f AS (
  SELECT word_id, any_value(n) AS chars, sum(CASE WHEN q > 0.4 THEN 100.0 / (n - 1) * {_OUT.format(s=2, a=0.75, b=1.0, x="q")} ELSE 0 END) AS heights, sum(CASE WHEN q > 0.4 THEN 0 ELSE 100 END) AS connected,
         sum(100.0 / n * {_OUT.format(s=0.35, a=2.5, b=12.0, x=_D)}) AS number_areas,
         sum(CASE WHEN 2 * width < height THEN 0 ELSE 100.0 / n * CASE WHEN hmax > 57 THEN {_OUT.format(s=0.35, a=10.0, b=36.0, x=_D)} WHEN hmax > 45 THEN {_OUT.format(s=0.35, a=8.0, b=30.0, x=_D)} ELSE {_OUT.format(s=0.35, a=7.0, b=21.0, x=_D)} END END) AS street_areas,
         sum(from_curb) > sum(from_middle) AS mid, any_value(wa) AS wa FROM c GROUP BY 1),
n AS (SELECT word_id, (lead(x) OVER w - x) / ((width + lead(width) OVER w) / 2) AS r FROM c WHERE height > 0.5 * hmax WINDOW w AS (PARTITION BY word_id ORDER BY x, char_id)),
g AS (SELECT word_id, 100 * avg({_STREET_GAP}) AS sp, 100 * avg({_NUMBER_GAP}) AS np FROM n WHERE r IS NOT NULL GROUP BY 1),
s AS (
  SELECT f.*, coalesce(sp, 0.0) + CASE WHEN mid THEN 0 ELSE 30 END + CASE WHEN wa < 250 THEN 40 ELSE 0 END AS ss, coalesce(np, 0.0) + CASE WHEN mid THEN 20 ELSE 0 END + CASE WHEN wa < 95 THEN 40 ELSE 0 END AS ns FROM f LEFT JOIN g USING (word_id)),
k AS (SELECT *, ss < ns AND ss < 35 AND heights < 35 AS st, ns < ss AND ns < 35 AND heights < 45 AS hn FROM s)
SELECT word_id, chars, round(heights, 5) AS heights, round(ss, 5) AS street_score, round(ns, 5) AS number_score, round(street_areas, 5) AS street_areas, round(number_areas, 5) AS number_areas,
       st AS is_street_name, hn AS is_house_number, heights < 1 AND connected < 1 AND ((st AND ss < 1 AND street_areas < 1) OR (hn AND ns < 1 AND number_areas < 1)) AS connected_pass, heights > 50 AS not_a_word FROM k"""


def single_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characters.single_word_type(fx.characters(spark, sf_dir)).select("char_id", "kind")


def character_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characters.character_filter(fx.characters(spark, sf_dir)).select("char_id")


def owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells(spark, sf_dir)
    grid = cells.where("kind = 'click'").where(fx.PEAK).select("r", "c", (F.col("r") * 100 + F.col("c")).alias("owner"))
    points = cells.where("kind = 'signup'").select((F.col("r") * 1000 + F.col("c")).alias("id"), "r", "c")
    return characters.owners(points, grid).select("id", F.coalesce("owner", F.lit(-1)).alias("owner"))


OWNER_SQL = f"""
WITH {fx.CELLS}, grid AS (SELECT r, c, r * 100 + c AS owner FROM cell WHERE kind = 'click' AND {fx.PEAK}),
pt AS (SELECT r * 1000 + c AS id, r, c FROM cell WHERE kind = 'signup'),
near AS (SELECT id, owner, row_number() OVER (PARTITION BY id ORDER BY (g.r = p.r AND g.c = p.c) DESC, g.c - p.c, g.r - p.r) AS k FROM pt p JOIN grid g ON abs(g.r - p.r) <= 2 AND abs(g.c - p.c) <= 2)
SELECT pt.id, coalesce(near.owner, -1) AS owner FROM pt LEFT JOIN near ON near.id = pt.id AND k = 1"""

QUERIES = {
    "q_char_adjacency": adjacency,
    "q_words_components": words,
    "q_word_extents": extents,
    "q_line_fit_moments": line_fit,
    "q_component_class": component_class,
    "q_street_class": street_class,
    "q_word_spacing": spacing,
    "q_word_type": word_type,
    "q_single_word_type": single_word,
    "q_char_filter": character_filter,
    "q_owner_lookup": owner_lookup,
}
SQL = {
    "q_char_adjacency": f"WITH {fx.CHARACTERS}, {_NEAR} SELECT u, v FROM near",
    "q_words_components": f"WITH RECURSIVE {_WORDS} SELECT char_id, word_id FROM word",
    "q_word_extents": f"WITH {fx.CHARACTERS}, {EXTENTS} SELECT group_id, points, {', '.join(f'round({c}, 5) AS {c}' for c in ('width', 'height', 'spread_w', 'spread_h', 'center_x', 'center_y'))} FROM ext",
    "q_line_fit_moments": f"WITH {fx.CHARACTERS} SELECT group_id, round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 5) AS angle FROM ch GROUP BY 1",
    "q_component_class": COMPONENT_SQL,
    "q_street_class": STREET_CLASS_SQL,
    "q_word_spacing": SPACING_SQL,
    "q_word_type": WORD_TYPE_SQL,
    "q_single_word_type": f"WITH {fx.CHARACTERS} SELECT char_id, CASE WHEN from_curb > from_middle AND width < 200 AND width > 30 AND height < 85 AND height > 20 AND area > 150 THEN 'street name' WHEN from_curb <= from_middle AND width < 200 AND width > 30 AND height < 45 AND height > 15 AND area > 95 THEN 'house number' ELSE 'none' END AS kind FROM ch",
    "q_char_filter": f"WITH {fx.CHARACTERS} SELECT char_id FROM ch WHERE area >= 15 AND width <= 120 AND height <= 100 AND width <= 7 * height",
    "q_owner_lookup": OWNER_SQL,
}
