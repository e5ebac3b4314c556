"""Queries on image files, sample stores, contours, skeleton graphs, growth and long lines."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.operators import contours, curbs, curves, folds, growth, polylines, raster, seams, skeletons, streets
from vellumgrid.operators.linking import rank_lists
from vellumgrid.plans import fixtures as fx
from vellumgrid.plans import geometry_sql as q
from vellumgrid.plans import more_queries, street_queries
from vellumgrid.sources import images, samples
from vellumgrid.storage import dealt, shared_folder, write_table


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the shared tables, as a path that Python reads."""
    return f"{shared_folder(spark)}/vellumgrid-{name}-{uuid.uuid4().hex}"


def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images written as PNG files and read back as cells."""
    path = _folder(spark, "images")
    images.write_images(images.encoded_images(fx.grey_cells(spark, sf_dir)), path)
    return images.read_images(spark, path).where("v > 0").select("img", "r", "c", "v")


def image_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images written and read back grey; rows of each image with the sum of their values."""
    path = _folder(spark, "colours")
    images.write_images(images.encoded_images(fx.grey_cells(spark, sf_dir), colour=True), path)
    return images.read_images(spark, path).groupBy("img", "r").agg(F.sum("v").alias("v")).where("v > 0")


def image_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of images with a number divisible by 3 only half of the file is there."""
    encoded = images.encoded_images(fx.grey_cells(spark, sf_dir))
    damaged = F.regexp_extract("img", r"(\d+)", 1).cast("long") % 3 == 0
    content = F.when(damaged, F.expr("substring(content, 1, length(content) div 2)")).otherwise(F.col("content"))
    path = _folder(spark, "damaged")
    images.write_images(encoded.withColumn("content", content), path)
    return images.read_images(spark, path).groupBy("img").agg(F.count_if(F.col("v").isNotNull() & (F.col("v") > 0)).alias("cells"), F.bool_and(F.col("v").isNotNull()).alias("valid"))


def sample_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures as numbered samples, every fourth damaged; each id gives the next whole one."""
    cells = fx.figures(spark, sf_dir).select((F.col("img") + 1).cast("string").alias("img"), "r", "c", F.lit(255).alias("v"))
    encoded = images.encoded_images(cells).select(F.col("img").cast("long").alias("sample_id"), "content", F.concat(F.lit("s"), "img").alias("label"))
    content = F.when(F.col("sample_id") % 4 == 0, F.expr("substring(content, 1, 20)")).otherwise(F.col("content"))
    path = _folder(spark, "samples")
    samples.write_store(encoded.withColumn("content", content), path)
    return samples.read_store(spark, path).select("sample_id", "found_id", "label")


def contour_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and area of all contours of a figure."""
    found = contours.contour_areas(contours.trace_contours(fx.figures(spark, sf_dir)))
    return found.groupBy("img").agg(F.sum("n").alias("edges"), F.sum("area").cast("long").alias("area"))


def contour_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contours.trace_contours(fx.figures(spark, sf_dir))


def contour_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours where only cells with a common side are of one figure."""
    return contours.contour_areas(contours.trace_contours(fx.figures(spark, sf_dir), diagonal=False))


def _skeleton_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chains and vertices of the thinned figures, with squared distances to the outside."""
    cells = write_table(fx.figures(spark, sf_dir).select(F.col("img").cast("string").alias("img"), "r", "c"), "figures")
    chains = write_table(folds.trace_chains(raster.thinned(cells)), "skeleton-chains")
    side = fx.FIGURE_SIDE + 2  # a margin of one, so that what touches the edge of an image has an outside
    grid = raster.full_grid(cells.select("img").distinct(), side, side).join(dealt(cells.select("img", (F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), F.lit(1).alias("in"))), ["img", "r", "c"], "left")
    far = raster.feature_transform(grid.select("img", "r", "c", F.when(F.col("in").isNull(), 1).otherwise(0).alias("v"))).select("img", (F.col("r") - 1).alias("r"), (F.col("c") - 1).alias("c"), "d2")
    id_of = lambda r, c: (F.col("img").cast("long") * fx.FIGURE_SIDE + F.col(r)) * fx.FIGURE_SIDE + F.col(c)
    ends = chains.groupBy("img", "chain_id").agg(F.min(F.struct("pos", "r", "c")).alias("a"), F.max(F.struct("pos", "r", "c")).alias("b"), F.count("*").alias("n"))
    ends = ends.select("img", (F.col("img").cast("long") * 100_000 + F.col("chain_id")).alias("chain_id"), "n", *(F.col(f"{k}.{x}").alias(f"{k}{x}") for k in "ab" for x in "rc"))
    corners = ends.select("img", F.inline(F.array(*(F.struct(F.col(f"{k}r").alias("r"), F.col(f"{k}c").alias("c")) for k in "ab")))).distinct()
    vertices = corners.join(dealt(far), ["img", "r", "c"]).select(id_of("r", "c").alias("vertex"), F.col("c").alias("x"), F.col("r").alias("y"), "d2")
    return write_table(ends.select("chain_id", id_of("ar", "ac").alias("u"), id_of("br", "bc").alias("v"), "n"), "chains"), write_table(vertices, "vertices")


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeletons.prune(*_skeleton_graph(spark, sf_dir), factor=1.2)


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeletons.prune_twins(*_skeleton_graph(spark, sf_dir))


def queue_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains are the rows of figures at every eighth column; the mask is the figure."""
    cells = fx.figures(spark, sf_dir)
    return growth.queue_growth(cells.where("c % 8 = 0 and r % 2 = 0").select("img", F.col("c").alias("source"), F.col("r").alias("pos"), "r", "c"), cells, layers=6)


def _snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in 500s to a map, their ends on a grid of 4, so that they meet."""
    lines = fx.lines(spark, sf_dir).where("line_id is not null")
    return lines.select(F.floor(F.col("line_id") / 500).alias("map_id"), "line_id", *((F.round(F.col(c) / 20) * 4).alias(c) for c in ("x1", "y1", "x2", "y2")))


def polyline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polylines.merge_polylines(_snapped(spark, sf_dir))


def polyline_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended streets, over wider gaps and whole neighbourhoods, after one pass at the vertices."""
    return polylines.merge_polylines(_snapped(spark, sf_dir), "extended streets", 1, "extended streets", whole=True)


#: Carving of small streets.
STREETS = seams.Carving(height_step=3, search=24, sample=1, wide=12, most_apart=3, close=3.0, edge=3, slack=2, good=0.3)


def _small_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments over eight, moved into the grid of the planes."""
    return fx.segments(spark, sf_dir).select(F.col("vec_id").alias("street_id"), *((F.col(c) / 8 + 24).alias(c) for c in ("x1", "y1", "x2", "y2")))


def _street_planes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    plane = lambda kind, where: fx.cells(spark, sf_dir).where(F.col("kind") == kind).where(where).select("r", "c")
    return plane("click", fx.THICK), plane("view", fx.SPARSE)


def seam_carving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seams.carve(seams.find_seams(_small_streets(spark, sf_dir), *_street_planes(spark, sf_dir), STREETS), STREETS)


def nearest_on_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control points are the first eight components of a vector, the point the next two."""
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", *(fx.component(k, 1000.0).alias(c) for k, c in enumerate((*curves.CONTROLS, "px", "py"))))
    return curves.nearest_on_cubic(e).select("vec_id", F.round("t", 6).alias("t"), F.round("d2", 4).alias("d2"))


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with ends on a grid of 20, four vectors a long line."""
    on_grid = (F.round(F.col(c) / 20 + 0.0) * 20 for c in ("x1", "y1", "x2", "y2"))
    return fx.segments(spark, sf_dir).select("vec_id", "label", F.col("vec_id").alias("line_id"), F.floor(F.col("vec_id") / 4).alias("group_id"), *(c.alias(n) for c, n in zip(on_grid, ("x1", "y1", "x2", "y2"))))


def corner_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curbs.corner_evidence(_quads(spark, sf_dir), 600.0)
    return found.select("group_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("branch_p", "branch_n", "end_p", "end_n")))


def curb_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision from all seven kinds of evidence."""
    lines = _quads(spark, sf_dir)
    plane = lambda kind: fx.cells(spark, sf_dir).where(F.col("kind") == kind).select("r", "c")
    found = curbs.curb_features(lines, lines.where("label >= 5"), fx.markings(spark, sf_dir), plane("click"), plane("view"), most_length=600.0)
    r = lambda c, name: (F.round(c, 4) + 0.0).alias(name)
    decided = streets.curb_decision(found)
    return decided.select("group_id", r("curb_score_p", "score_p"), r("curb_score_n", "score_n"), "curb_p", "curb_n", r("flood_p", "flood_p"), r("marking_p", "marking_p"), r("end_n", "end_n"), r("branch_p", "branch_p"))


_GRID = fx.SEGMENTS.replace("seg AS", "raw_seg AS") + ", seg AS (SELECT vec_id, label, round(x1/20)*20 AS x1, round(y1/20)*20 AS y1, round(x2/20)*20 AS x2, round(y2/20)*20 AS y2 FROM raw_seg)"
_FAR = "round((vx-{0})*(vx-{0})+(vy-{1})*(vy-{1}), 6)"
_AXES = f"""
l AS (SELECT vec_id AS line_id, vec_id // 4 AS group_id, x1, y1, x2, y2, {q.length("")} AS w FROM seg),
e AS (SELECT line_id, group_id, x1 AS vx, y1 AS vy, x2-x1 AS dx, y2-y1 AS dy FROM l UNION ALL SELECT line_id, group_id, x2, y2, x1-x2, y1-y2 FROM l),
mid AS (SELECT group_id, avg(vx) AS mx, avg(vy) AS my FROM e GROUP BY 1),
one AS (SELECT group_id, vx AS px, vy AS py FROM e JOIN mid USING (group_id) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {_FAR.format("mx", "my")} DESC, vx, vy) = 1),
two AS (SELECT group_id, px, py, vx AS qx, vy AS qy FROM e JOIN one USING (group_id) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {_FAR.format("px", "py")} DESC, vx, vy) = 1),
axs AS (SELECT two.*, length, n FROM two JOIN (SELECT group_id, sum(w) AS length, count(*) AS n FROM l GROUP BY 1) USING (group_id))"""
_BESIDE = "CASE WHEN qx = px AND qy = py THEN {1} >= 0 ELSE (qx-px)*{1} - (qy-py)*{0} >= 0 END"
_BRANCH = "greatest(CASE WHEN {0}c <= 1 OR {0}l < 600 THEN least({1}c*0.08+({1}l-{0}l)*0.005, 1.0)-({0}c*0.08/3+{0}l*0.005/3) ELSE least(({1}c/{0}c-1)*0.08+({1}l-{0}l)*0.005, 0.6)-{0}l*0.005/3 END, -1.0)"
_PULL = "sum(CASE WHEN {0}s THEN -0.9*share ELSE 0.5*share END)"
_CORNERS = f"""
o AS (SELECT e.group_id AS other, vx, vy, dx AS ox, dy AS oy, least(600.0, length) AS len FROM e JOIN axs USING (group_id)),
met AS (SELECT e.group_id, len, {_BESIDE.format("ox", "oy")} AS s FROM e JOIN o USING (vx, vy) JOIN axs ON axs.group_id = e.group_id WHERE e.group_id <> other),
cnt AS (SELECT group_id, CAST(count(*) FILTER (s) AS DOUBLE) AS pc, CAST(count(*) FILTER (NOT s) AS DOUBLE) AS nc, coalesce(sum(len) FILTER (s), 0.0) AS pl, coalesce(sum(len) FILTER (NOT s), 0.0) AS nl FROM met GROUP BY 1),
br AS (SELECT group_id, {_BRANCH.format("p", "n")} AS branch_p, {_BRANCH.format("n", "p")} AS branch_n FROM cnt),
tip AS (SELECT group_id, px AS vx, py AS vy FROM axs UNION SELECT group_id, qx, qy FROM axs),
deg AS (SELECT vx, vy, count(*) AS d FROM e GROUP BY 1, 2),
alone AS (SELECT group_id, -0.2 * count(*) FILTER (d = 1) AS alone FROM tip JOIN deg USING (vx, vy) GROUP BY 1),
tm AS (SELECT tip.group_id, len / 600.0 AS share, {_BESIDE.format("ox", "oy")} AS s FROM tip JOIN o USING (vx, vy) JOIN axs ON axs.group_id = tip.group_id WHERE tip.group_id <> other),
en AS (SELECT group_id, {_PULL.format("")} AS end_p, {_PULL.format("NOT ")} AS end_n FROM tm GROUP BY 1),
corner AS (SELECT group_id, coalesce(branch_p, -0.4) AS branch_p, coalesce(branch_n, -0.4) AS branch_n, coalesce(end_p, 0.0) + coalesce(alone, 0.0) AS end_p, coalesce(end_n, 0.0) + coalesce(alone, 0.0) AS end_n
  FROM axs LEFT JOIN br USING (group_id) LEFT JOIN alone USING (group_id) LEFT JOIN en USING (group_id))"""
_ROUNDED = lambda *names: ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)
CORNER_SQL = f"WITH {_GRID}, {_AXES}, {_CORNERS} SELECT group_id, {_ROUNDED('branch_p', 'branch_n', 'end_p', 'end_n')} FROM corner"


def _part(sql: str, *changes: tuple[str, str]) -> str:
    """Another query's SQL over segments on the grid, four to a long line."""
    for old, new in ((fx.SEGMENTS, _GRID), ("label AS group_id", "vec_id // 4 AS group_id"), ("label AS a_group", "vec_id // 4 AS a_group"), ("label AS b_group", "vec_id // 4 AS b_group"), *changes):
        sql = sql.replace(old, new)
    return sql


_TURNED = _BESIDE.format("(-(y2-y1))", "(x2-x1)")
_SHARED = "sum(CASE WHEN t THEN {0}_p ELSE {0}_n END * w / length) AS {0}_p, sum(CASE WHEN t THEN {0}_n ELSE {0}_p END * w / length) AS {0}_n"
FEATURE_SQL = f"""
WITH {_GRID}, {_AXES}, {_CORNERS},
modern AS ({_part(street_queries.MODERN_SQL, ("round(coalesce(p / w, 0.0), 6)", "coalesce(p / w, 0.0)"), ("round(coalesce(n / w, 0.0), 6)", "coalesce(n / w, 0.0)"))}),
beside AS ({_part(street_queries.PARALLEL_SQL, ("round(least(1.0, coalesce(s / w, 0.0)), 6)", "least(1.0, coalesce(s / w, 0.0))"))}),
marks AS ({re.sub(r"round[(]([(]close_.*?[)] / 4), 6[)]", "(\\1)", _part(street_queries.MARKING_SQL))}),
floods AS ({_part(more_queries.FLOOD_SQL, ("x1/8+24 AS x1, y1/8+24 AS y1, x2/8+24 AS x2, y2/8+24 AS y2", "x1, y1, x2, y2"))}),
way AS (SELECT l.*, length, {_TURNED} AS t FROM l JOIN axs USING (group_id)),
by_line AS (SELECT group_id, {_SHARED.format("flood")}, {_SHARED.format("marking")} FROM way JOIN floods USING (line_id) JOIN marks USING (line_id) GROUP BY 1),
s AS (SELECT group_id, flood_p, marking_p, end_n, branch_p, {", ".join(f"0.4*modern_{s} + 0.3*branch_{s} + 0.1*end_{s} + 0.1*coalesce(flood_{s}, 0.0) + 0.2*coalesce(marking_{s}, 0.0) + 0.1*parallel + 0.0001*length/n AS sum_{s}" for s in "pn")}
  FROM axs LEFT JOIN modern USING (group_id) LEFT JOIN corner USING (group_id) LEFT JOIN by_line USING (group_id) LEFT JOIN beside USING (group_id))
SELECT group_id, round(sum_p, 4) + 0.0 AS score_p, round(sum_n, 4) + 0.0 AS score_n, sum_p > 0.4 AS curb_p, sum_n > 0.4 AS curb_n, round(flood_p, 4) + 0.0 AS flood_p, round(marking_p, 4) + 0.0 AS marking_p, round(end_n, 4) + 0.0 AS end_n, round(branch_p, 4) + 0.0 AS branch_p FROM s"""


def conversation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lists linked by conversation: each turn's last one and the links to it."""
    turns = fx.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("node"), "conv_id")
    links = turns.withColumn("next", F.lead("node").over(Window.partitionBy("conv_id").orderBy("node"))).select("node", "next")
    return rank_lists(links)


QUERIES = {
    "q_image_pixels": image_pixels,
    "q_image_luminance": image_luminance,
    "q_image_validity": image_validity,
    "q_sample_store": sample_store,
    "q_contour_sums": contour_sums,
    "q_contours": contour_list,
    "q_contour_shapes": contour_shapes,
    "q_pruned_chains": pruned,
    "q_twin_chains": twins,
    "q_queue_growth": queue_growth,
    "q_polyline_merge": polyline_merge,
    "q_polyline_streets": polyline_streets,
    "q_list_ranks": conversation_ranks,
    "q_seam_carving": seam_carving,
    "q_nearest_on_cubic": nearest_on_cubic,
    "q_corner_evidence": corner_evidence,
    "q_curb_features": curb_features,
}
SQL = {
    "q_corner_evidence": CORNER_SQL,
    "q_curb_features": FEATURE_SQL,
    "q_image_pixels": f"WITH {fx.GREYS} SELECT img, r, c, v FROM grey",
    "q_image_luminance": f"WITH {fx.GREYS} SELECT img, r, CAST(sum((19595 * red + 38470 * green + 7471 * blue + 32768) // 65536) AS BIGINT) AS v FROM grey GROUP BY 1, 2 HAVING sum((19595 * red + 38470 * green + 7471 * blue + 32768) // 65536) > 0",
    "q_image_validity": f"WITH {fx.GREYS} SELECT img, CASE WHEN bad THEN 0 ELSE n END AS cells, NOT bad AS valid FROM (SELECT img, count(*) AS n, CAST(regexp_extract(img, '(\\d+)', 1) AS BIGINT) % 3 = 0 AS bad FROM grey GROUP BY 1)",
    "q_sample_store": f"WITH {fx.FIGURES}, ids AS (SELECT DISTINCT img + 1 AS k FROM fig), good AS (SELECT k FROM ids WHERE k % 4 <> 0) SELECT ids.k AS sample_id, min(good.k) AS found_id, 's' || min(good.k) AS label FROM ids LEFT JOIN good ON good.k >= ids.k GROUP BY 1",
    "q_contour_sums": f"WITH {fx.FIGURES}, side AS (SELECT * FROM (VALUES (-1, 0), (0, 1), (1, 0), (0, -1)) AS t(dr, dc)), edge AS (SELECT f.img FROM fig f, side WHERE NOT EXISTS (SELECT 1 FROM fig g WHERE g.img = f.img AND g.r = f.r + dr AND g.c = f.c + dc)) SELECT img, edges, area FROM (SELECT img, count(*) AS edges FROM edge GROUP BY 1) JOIN (SELECT img, count(*) AS area FROM fig GROUP BY 1) USING (img)",
    "q_list_ranks": "WITH t AS (SELECT conv_id * 10000 + turn AS node, conv_id FROM conversations) SELECT node, max(node) OVER (PARTITION BY conv_id) AS head, count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY node) AS steps, false AS ring FROM t",
}
