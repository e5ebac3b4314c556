"""Circular direction histograms and template matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import arrays as a

#: The smoothing mask over 31 bins, as (weight, repeats).
MASK_RUNS = ((1, 5), (2, 5), (5, 11), (2, 5), (1, 5))
BINS = 180


def mask() -> list[int]:
    return [w for w, n in MASK_RUNS for _ in range(n)]


def direction_spectrum(votes: DataFrame, key: str, bins: int = BINS) -> DataFrame:
    """(key, bin, weight): a histogram of directions modulo 180 degrees, smoothed by the mask; weights of a key sum to 1.

    votes: key, dx, dy, votes (a count). A direction rounds half up to whole degrees before it is smoothed. Zero vectors don't vote.
    """
    m = mask()
    degree = (F.atan2("dy", "dx") * 180.0 / 3.14159 + 0.5).cast("int") + 720
    by_degree = votes.where("dx <> 0 or dy <> 0").groupBy(key, degree.alias("degree")).agg(F.sum("votes").alias("votes"))
    total = by_degree.groupBy(key).agg(F.sum("votes").alias("all_votes"))
    spread = by_degree.select(key, "degree", "votes", F.posexplode(F.array(*map(F.lit, m))).alias("j", "w"))
    at = F.pmod(F.col("degree") + F.col("j") - len(m) // 2, F.lit(bins))
    return spread.groupBy(key, at.alias("bin")).agg(F.sum(F.col("votes") * F.col("w")).alias("v")).join(total, key).select(key, "bin", (F.col("v") / (sum(m) * F.col("all_votes"))).alias("weight"))


def line_votes(lines: DataFrame) -> DataFrame:
    """Adds votes: one more than the length, rounded up."""
    return lines.withColumn("votes", F.ceil(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) + 1).cast("long"))


def templates(spectra: DataFrame) -> DataFrame:
    """(label, template): mean spectrum of each label, as a spectrum."""
    e = spectra.select("label", F.posexplode("spectrum").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v"))
    return e.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("template"))


def best_templates(spectra: DataFrame, forms: DataFrame, k: int = 1) -> DataFrame:
    """(id, label, rank, template_label, score): the k templates of each spectrum with the highest overlap, ties to the smaller label.

    forms is a small table of one row a template (letters times rotations, not data), so it is joined to all spectra as a broadcast of
    a size that is checked.
    """
    if forms.count() > 10_000:
        raise ValueError("templates are a bounded table: 10,000 at most")
    scored = spectra.crossJoin(F.broadcast(forms.withColumnRenamed("label", "template_label"))).withColumn("score", a.overlap(F.col("spectrum"), F.col("template")))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "template_label")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "label", "rank", "template_label", "score")


def best_shift(spectra: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, template_label, shift, score): for each spectrum and template, the rotation of the template with the highest overlap; the
    least of equal ones. The rotations are looked through within a row."""
    if forms.count() > 10_000:
        raise ValueError("templates are a bounded table: 10,000 at most")
    pairs = spectra.crossJoin(F.broadcast(forms.withColumnRenamed("label", "template_label")))
    tried = F.transform(F.sequence(F.lit(0), F.size("template") - 1), lambda s: F.struct(a.overlap(F.col("spectrum"), a.rotated(F.col("template"), s)).alias("score"), (-s).alias("turn")))
    return pairs.withColumn("best", F.array_max(tried)).select("id", "template_label", (-F.col("best.turn")).alias("shift"), F.col("best.score").alias("score"))
