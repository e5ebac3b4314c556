"""Map-like inputs derived from the driver's tables by fixed rules, and the same rules as SQL.

Segments: coordinates are 1000 times the first four components of an embedding. Old streets have labels under 5, present ones the
others. A long line is a label. Markings are components 8 and 9, size from component 10. Characters are components
4 and 5 times 3000, with width and height from 6 and 7. A spectrum is the absolute components over their sum. Cells of small grids are
(user_id, k) of events; a cell of a small grid is set by its place among those of its kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def component(k: int, scale: float):
    return F.get("embedding", F.lit(k)).cast("double") * scale


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *(component(k, 1000.0).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


SEGMENTS = "seg AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 1000 AS x1, CAST(embedding[2] AS DOUBLE) * 1000 AS y1, CAST(embedding[3] AS DOUBLE) * 1000 AS x2, CAST(embedding[4] AS DOUBLE) * 1000 AS y2 FROM embeddings)"


def old_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where("label < 5").withColumnRenamed("vec_id", "h_id")


def present_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where("label >= 5").withColumnRenamed("vec_id", "p_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments as lines of long lines."""
    return segments(spark, sf_dir).select(F.col("vec_id").alias("line_id"), F.col("label").alias("group_id"), "x1", "y1", "x2", "y2")


def markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(component(8, 1000.0).alias("x"), component(9, 1000.0).alias("y"), F.floor(F.abs(component(10, 1000.0))).cast("long").alias("size"))


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """char_id, x, y, width, height, area, from_curb, from_middle, ux, uy (direction of the street)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("char_id"), F.col("label").alias("group_id"), component(4, 3000.0).alias("x"), component(5, 3000.0).alias("y"),
        (F.abs(component(6, 300.0)) + 5).alias("width"), (F.abs(component(7, 300.0)) + 5).alias("height"), F.floor(F.abs(component(11, 1000.0))).cast("long").alias("area"),
        F.abs(component(12, 100.0)).alias("from_curb"), F.abs(component(13, 100.0)).alias("from_middle"), F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy"),
    )


CHARACTERS = (
    "ch AS (SELECT vec_id AS char_id, label AS group_id, CAST(embedding[5] AS DOUBLE) * 3000 AS x, CAST(embedding[6] AS DOUBLE) * 3000 AS y, abs(CAST(embedding[7] AS DOUBLE) * 300) + 5 AS width,"
    " abs(CAST(embedding[8] AS DOUBLE) * 300) + 5 AS height, CAST(floor(abs(CAST(embedding[12] AS DOUBLE) * 1000)) AS BIGINT) AS area, abs(CAST(embedding[13] AS DOUBLE) * 100) AS from_curb,"
    " abs(CAST(embedding[14] AS DOUBLE) * 100) AS from_middle, 1.0 AS ux, 0.0 AS uy FROM embeddings)"
)


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, spectrum."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return e.select(F.col("vec_id").alias("id"), "label", F.transform("s", lambda x: x / total).alias("spectrum"))


SPECTRA = (
    "raw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS s FROM embeddings),"
    " sp AS (SELECT id, label, list_transform(s, lambda x: x / list_sum(s)) AS spectrum FROM raw)"
)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, r, c, n, place) on a 48 x 48 grid: events of a kind in a cell, and the cell's place among those of its kind, most events first."""
    e = placed_events(spark, sf_dir)
    counted = e.groupBy("kind", "r", "c").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), (F.col("r") * 31 + F.col("c") * 17) % 101, "r", "c")
    return counted.withColumn("place", F.row_number().over(order))


def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("kind"), (F.col("user_id") % 48).cast("int").alias("r"), (F.get_json_object("props", "$.k").cast("long") % 48).cast("int").alias("c")).where("r is not null and c is not null")


CELLS = (
    "ev AS (SELECT event_type AS kind, CAST(user_id % 48 AS INTEGER) AS r, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 48 AS INTEGER) AS c FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL),"
    " cn AS (SELECT kind, r, c, count(*) AS n FROM ev GROUP BY ALL), cell AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, (r * 31 + c * 17) % 101, r, c) AS place FROM cn)"
)
#: So many cells of a kind with the most events, of 2,304 at most: thresholds by rank leave as many however large the tables are.
THICK, SPARSE, PEAK = "place <= 1400", "place <= 500", "place <= 120"

#: Side of a figure's image, and vectors that share one.
FIGURE_SIDE, FIGURE_VECTORS = 64, 20


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, r, c): disks around the first two components of vectors, as wide as the third; 20 vectors share an image of 64 x 64."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    disks = e.select(F.floor(F.col("vec_id") / FIGURE_VECTORS).alias("img"), (component(0, 160.0) + 32).alias("x"), (component(1, 160.0) + 32).alias("y"), (F.abs(component(2, 24.0)) + 2).alias("radius"))
    span = lambda v: F.sequence(F.greatest(F.ceil(F.col(v) - F.col("radius")).cast("int"), F.lit(0)), F.least(F.floor(F.col(v) + F.col("radius")).cast("int"), F.lit(FIGURE_SIDE - 1)))
    on = lambda v: (F.col(v) + F.col("radius") >= 0) & (F.col(v) - F.col("radius") <= FIGURE_SIDE - 1)
    cells = disks.where(on("x") & on("y")).withColumn("r", F.explode(span("y"))).withColumn("c", F.explode(span("x")))
    dx, dy = F.col("c") - F.col("x"), F.col("r") - F.col("y")
    return cells.where(dx * dx + dy * dy <= F.col("radius") * F.col("radius")).select("img", "r", "c").distinct()


FIGURES = (
    "disk AS (SELECT vec_id // 20 AS img, CAST(embedding[1] AS DOUBLE) * 160 + 32 AS x, CAST(embedding[2] AS DOUBLE) * 160 + 32 AS y, abs(CAST(embedding[3] AS DOUBLE) * 24) + 2 AS radius FROM embeddings),"
    " axis AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS v),"
    " fig AS (SELECT DISTINCT img, r.v AS r, c.v AS c FROM disk JOIN axis r ON abs(r.v - y) <= radius JOIN axis c ON abs(c.v - x) <= radius WHERE (c.v - x) * (c.v - x) + (r.v - y) * (r.v - y) <= radius * radius)"
)


def grey_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, r, c, v, red, green, blue): images of 48 users each, a row a user, a column for k; values tell events of the cell by kind."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.floor(F.col("user_id") / 48).cast("string"), F.lit(".png")).alias("img"), (F.col("user_id") % 48).cast("int").alias("r"), (F.get_json_object("props", "$.k").cast("long") % 48).cast("int").alias("c"), "event_type"
    ).where("r is not null and c is not null")
    shade = lambda n: F.least(n * 37, F.lit(255)).cast("int")
    kind = lambda k: shade(F.count_if(F.col("event_type") == k))
    return e.groupBy("img", "r", "c").agg(shade(F.count("*")).alias("v"), kind("click").alias("red"), kind("view").alias("green"), kind("purchase").alias("blue"))


GREYS = (
    "spot AS (SELECT 'u' || (user_id // 48) || '.png' AS img, CAST(user_id % 48 AS INTEGER) AS r, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 48 AS INTEGER) AS c, event_type FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL),"
    " grey AS (SELECT img, r, c, CAST(least(37 * count(*), 255) AS INTEGER) AS v, CAST(least(37 * count(*) FILTER (event_type = 'click'), 255) AS INTEGER) AS red,"
    " CAST(least(37 * count(*) FILTER (event_type = 'view'), 255) AS INTEGER) AS green, CAST(least(37 * count(*) FILTER (event_type = 'purchase'), 255) AS INTEGER) AS blue FROM spot GROUP BY ALL)"
)
