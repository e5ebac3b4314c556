"""Queries on spectra, accuracy and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import arrays as a
from vellumgrid.operators import metrics, spectra
from vellumgrid.plans import fixtures as fx

_R = 6


def _round(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, _R).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def direction_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions are the pairs of neighbouring components of an embedding, long 1000 times as much."""
    e = fx.table(spark, sf_dir, "embeddings")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(62), F.lit(2)), lambda k: F.struct((F.get("embedding", k).cast("double") * 1000).alias("dx"), (F.get("embedding", k + 1).cast("double") * 1000).alias("dy"))))
    votes = spectra.line_votes(e.select("label", pairs.alias("p")).select("label", "p.dx", "p.dy"))
    return _round(spectra.direction_spectrum(votes, "label"))


DIRECTION_SQL = """
WITH v AS (SELECT label, CAST(embedding[k] AS DOUBLE) * 1000 AS dx, CAST(embedding[k + 1] AS DOUBLE) * 1000 AS dy FROM embeddings, range(1, 64, 2) AS t(k)),
d AS (SELECT label, CAST(trunc(atan2(dy, dx) * 180.0 / 3.14159 + 0.5) AS BIGINT) + 720 AS a, CAST(ceil(sqrt(dx * dx + dy * dy) + 1) AS BIGINT) AS n FROM v WHERE dx <> 0 OR dy <> 0),
m AS (SELECT j, CASE WHEN j BETWEEN 10 AND 20 THEN 5 WHEN j BETWEEN 5 AND 25 THEN 2 ELSE 1 END AS w FROM range(31) AS t(j)),
s AS (SELECT label, (a + j - 15) % 180 AS bin, sum(n * w) AS v FROM d, m GROUP BY ALL),
t AS (SELECT label, sum(n) AS n FROM d GROUP BY 1)
SELECT label, CAST(bin AS INTEGER) AS bin, round(v / (85 * CAST(n AS DOUBLE)), 6) AS weight FROM s JOIN t USING (label)"""
TEMPLATES = """
el AS (SELECT id, label, unnest(range(1, len(spectrum) + 1)) AS k, unnest(spectrum) AS v FROM sp),
tv AS (SELECT label, k, avg(v) AS v FROM el GROUP BY ALL),
sc AS (SELECT el.id, any_value(el.label) AS label, tv.label AS template_label, sum(sqrt(el.v * tv.v)) AS score FROM el JOIN tv USING (k) GROUP BY el.id, tv.label)"""


def _matched(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    s = fx.spectra(spark, sf_dir)
    return spectra.best_templates(s, spectra.templates(s), k)


def spectrum_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_matched(spark, sf_dir).select("id", "template_label", "score"))


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_matched(spark, sf_dir, 3).select("id", "rank", "template_label", "score"))


def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.spectra(spark, sf_dir)
    return _round(spectra.best_shift(s, spectra.templates(s)))


ALIGN_SQL = f"""
WITH {fx.SPECTRA}, {TEMPLATES},
al AS (SELECT e.id, t.label AS template_label, h AS shift, sum(sqrt(e.v * t.v)) AS score FROM el e CROSS JOIN range(64) AS r(h) JOIN tv t ON t.k = (e.k - 1 + h) % 64 + 1 GROUP BY ALL)
SELECT id, template_label, CAST(shift AS INTEGER) AS shift, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id, template_label ORDER BY score DESC, shift) AS n FROM al) WHERE n = 1"""


def letter_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles are 7 and 11 times the id, on the circle; letters are 0 to 11, two of them without an attempt."""
    m = _matched(spark, sf_dir).select(F.col("label").alias("truth"), F.col("template_label").alias("predicted"), ((F.col("id") * 7) % 360).cast("double").alias("angle"), ((F.col("id") * 11) % 360).cast("double").alias("found"))
    letters = spark.range(12).select(F.col("id").cast("int").alias("letter"))
    return _round(metrics.letter_report(m, letters).fillna(-1.0, ["mean_error", "mean_error_half"]))


_BEST = f"{fx.SPECTRA}, {TEMPLATES}, best AS (SELECT id, label, template_label, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, template_label) AS n FROM sc) WHERE n = 1)"
LETTER_SQL = f"""
WITH {_BEST}, d AS (SELECT label, template_label, abs((id * 7) % 360 - (id * 11) % 360) AS a, abs((id * 7) % 360 % 180 - (id * 11) % 360 % 180) AS h FROM best)
SELECT CAST(l AS INTEGER) AS letter, count(label) FILTER (label = template_label) AS correct, count(label) AS attempts, round(coalesce(avg(least(a, 360 - a)), -1.0), 6) AS mean_error, round(coalesce(avg(least(h, 180 - h)), -1.0), 6) AS mean_error_half
FROM range(12) AS t(l) LEFT JOIN d ON d.label = l GROUP BY 1"""


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(fx.table(spark, sf_dir, "labels"), "quality", "toxic")


def confusion_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.confusion_share(_matched(spark, sf_dir), "label", "template_label"))


def confusion_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.range(12).select(F.col("id").cast("int").alias("class"))
    return _round(metrics.confusion_complete(_matched(spark, sf_dir), classes, "label", "template_label"))


def accuracy_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.accuracy_by(_matched(spark, sf_dir), "label", "label", "template_label"))


def accuracy_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.padded_accuracy(fx.table(spark, sf_dir, "labels"), "quality", "toxic", 64))


def first_char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select("user_id", F.regexp_extract(F.col("value").cast("decimal(18,4)").cast("string"), "[1-9]", 0).alias("d"))
    return _round(metrics.entropy_by(e.where("d <> ''"), "user_id", "d"))


ENTROPY_SQL = """
WITH e AS (SELECT user_id, regexp_extract(CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR), '[1-9]') AS d FROM events), c AS (SELECT user_id, d, count(*) AS k FROM e WHERE d <> '' GROUP BY ALL),
p AS (SELECT user_id, k, k / CAST(sum(k) OVER (PARTITION BY user_id) AS DOUBLE) AS p FROM c)
SELECT user_id, CAST(sum(k) AS BIGINT) AS n, round(sum(-p * ln(p)), 6) AS entropy FROM p GROUP BY 1"""


def orientation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.orientation_vote(fx.table(spark, sf_dir, "events"), "user_id", "event_type", "click", "view")


def entropy_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "click", F.col("event_id") % 4).alias("a"), F.when(F.col("event_type") == "view", F.col("event_id") % 6).alias("b"))
    return metrics.flipped_by_entropy(e, "user_id", "a", "b")


FLIP_SQL = """
WITH e AS (SELECT user_id, CASE WHEN event_type = 'click' THEN event_id % 4 END AS a, CASE WHEN event_type = 'view' THEN event_id % 6 END AS b FROM events),
ca AS (SELECT user_id, a, count(*) AS k FROM e WHERE a IS NOT NULL GROUP BY ALL), cb AS (SELECT user_id, b, count(*) AS k FROM e WHERE b IS NOT NULL GROUP BY ALL),
ha AS (SELECT user_id, round(ln(sum(k)) - list_sum(list_sort(list(k * ln(k)))) / sum(k), 9) AS h FROM ca GROUP BY 1),
hb AS (SELECT user_id, round(ln(sum(k)) - list_sum(list_sort(list(k * ln(k)))) / sum(k), 9) AS h FROM cb GROUP BY 1)
SELECT u.user_id, coalesce(ha.h > hb.h, true) AS flipped FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN ha USING (user_id) LEFT JOIN hb USING (user_id)"""


def reading_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").withColumn("n", F.length(F.get_json_object("props", "$.k")))
    return metrics.reading_method(e, "user_id", "n", few=8, short=1)


def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.accuracy_by(_matched(spark, sf_dir), "label", "label", "template_label").select(F.col("label").alias("model"), "accuracy")
    return _round(metrics.best_model(m))


def model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models of five classes are components 0-4 and 5-9, the kind components 10 and 11."""
    part = lambda low, n: F.transform(F.slice("embedding", low + 1, n), lambda x: x.cast("double") * 10)
    joint = a.routed(part(10, 2), part(0, 5), part(5, 5))
    return _round(fx.table(spark, sf_dir, "embeddings").select("vec_id", joint.alias("z")).select("vec_id", a.argmax(F.col("z")).alias("predicted"), F.array_max("z").alias("logp")))


_LSM = "list_transform({x}, lambda v: v - ln(list_sum(list_transform({x}, lambda w: exp(w)))))"
ROUTE_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS e FROM embeddings),
m AS (SELECT vec_id, {_LSM.format(x="e[11:12]")} AS k, {_LSM.format(x="e[1:5]")} AS a, {_LSM.format(x="e[6:10]")} AS b FROM e),
z AS (SELECT vec_id, list_concat(list_transform(a, lambda v: v + k[1]), list_transform(b, lambda v: v + k[2])) AS z FROM m)
SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS predicted, round(list_max(z), 6) AS logp FROM z"""

QUERIES = {
    "q_direction_spectrum": direction_spectrum,
    "q_spectrum_score": spectrum_score,
    "q_best_template_topk": topk,
    "q_spectrum_align": align,
    "q_letter_accuracy": letter_accuracy,
    "q_confusion": confusion,
    "q_confusion_norm": confusion_norm,
    "q_confusion_safe": confusion_safe,
    "q_accuracy_by_label": accuracy_by_label,
    "q_accuracy_padded": accuracy_padded,
    "q_first_char_entropy": first_char_entropy,
    "q_orientation_vote": orientation_vote,
    "q_entropy_flip": entropy_flip,
    "q_reading_method": reading_method,
    "q_best_model": best_model,
    "q_model_route": model_route,
}
SQL = {
    "q_direction_spectrum": DIRECTION_SQL,
    "q_spectrum_score": f"WITH {_BEST} SELECT id, template_label, round(score, 6) AS score FROM best",
    "q_best_template_topk": f"WITH {fx.SPECTRA}, {TEMPLATES} SELECT id, CAST(n AS INTEGER) AS rank, template_label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, template_label) AS n FROM sc) WHERE n <= 3",
    "q_spectrum_align": ALIGN_SQL,
    "q_letter_accuracy": LETTER_SQL,
    "q_confusion": "SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL",
    "q_confusion_norm": f"WITH {_BEST}, c AS (SELECT label AS truth, template_label AS predicted, count(*) AS n FROM best GROUP BY ALL) SELECT truth, predicted, n, round(n / CAST(sum(n) OVER (PARTITION BY truth) AS DOUBLE), 6) AS share FROM c",
    "q_confusion_safe": f"WITH {_BEST}, c AS (SELECT CAST(t AS INTEGER) AS truth, CAST(p AS INTEGER) AS predicted, count(label) AS n FROM range(12) AS a(t) CROSS JOIN range(12) AS b(p) LEFT JOIN best ON label = t AND template_label = p GROUP BY ALL) SELECT truth, predicted, n, round(n / CAST(greatest(sum(n) OVER (PARTITION BY truth), 1) AS DOUBLE), 6) AS share FROM c",
    "q_accuracy_by_label": f"WITH {_BEST} SELECT label, count(*) FILTER (label = template_label) AS correct, count(*) AS attempts, round(avg(CAST(label = template_label AS INTEGER)), 6) AS accuracy FROM best GROUP BY 1",
    "q_accuracy_padded": "SELECT count(*) FILTER (quality = toxic) AS correct, count(*) AS n, round(count(*) FILTER (quality = toxic) / (ceil(count(*) / 64) * 64), 6) AS accuracy FROM labels",
    "q_first_char_entropy": ENTROPY_SQL,
    "q_orientation_vote": "SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) AS BIGINT) AS votes, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) > 0 AS flipped FROM events GROUP BY 1",
    "q_entropy_flip": FLIP_SQL,
    "q_reading_method": "SELECT user_id, CASE WHEN count(*) < 8 OR 2 * count(*) FILTER (length(json_extract_string(props, '$.k')) <= 1) > count(*) THEN 1 ELSE 2 END AS method FROM events GROUP BY 1",
    "q_best_model": f"WITH {_BEST} SELECT label AS model, round(avg(CAST(label = template_label AS INTEGER)), 6) AS accuracy FROM best GROUP BY 1 ORDER BY avg(CAST(label = template_label AS INTEGER)) DESC, label LIMIT 1",
    "q_model_route": ROUTE_SQL,
}
