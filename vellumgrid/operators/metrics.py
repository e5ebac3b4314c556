"""Accuracy, confusion, entropy and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions.geometry import circular_difference


def accuracy_by(df: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum((F.col(truth) == F.col(predicted)).cast("long")).alias("correct"), F.count("*").alias("attempts"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def letter_report(df: DataFrame, letters: DataFrame) -> DataFrame:
    """(letter, correct, attempts, mean_error, mean_error_half): per letter, with those that have no attempt (their means are null).

    df: truth, predicted, angle, found (degrees). Errors go the shorter way round, the second also modulo 180.
    """
    e, h = circular_difference(F.col("angle"), F.col("found"), 360), circular_difference(F.pmod("angle", F.lit(180)), F.pmod("found", F.lit(180)), 180)
    got = df.groupBy(F.col("truth").alias("letter")).agg(F.sum((F.col("truth") == F.col("predicted")).cast("long")).alias("correct"), F.count("*").alias("attempts"), F.avg(e).alias("mean_error"), F.avg(h).alias("mean_error_half"))
    return letters.select("letter").join(got, "letter", "left").select("letter", F.coalesce("correct", F.lit(0)).cast("long").alias("correct"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), "mean_error", "mean_error_half")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_share(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows of the confusion matrix over their sums."""
    return confusion(df, truth, predicted).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def confusion_complete(df: DataFrame, classes: DataFrame, truth: str, predicted: str) -> DataFrame:
    """All pairs of a small table of classes, with 0 where a class has no attempt."""
    grid = classes.select(F.col("class").alias("truth")).crossJoin(classes.select(F.col("class").alias("predicted")))
    n = F.coalesce("n", F.lit(0)).cast("long")
    joined = grid.join(confusion(df, truth, predicted), ["truth", "predicted"], "left").select("truth", "predicted", n.alias("n"))
    return joined.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("truth")), F.lit(1)))


def padded_accuracy(df: DataFrame, truth: str, predicted: str, batch: int) -> DataFrame:
    """Correct ones over the number of batches times their size, so a part of a batch counts as a whole one."""
    return df.agg(F.sum((F.col(truth) == F.col(predicted)).cast("long")).alias("correct"), F.count("*").alias("n")).withColumn("accuracy", F.try_divide(F.col("correct"), F.ceil(F.col("n") / batch) * batch))


def entropy_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, entropy): natural entropy of the values of a key; null values don't count, and a key without any has null."""
    c = df.groupBy(key, value).agg(F.count(value).alias("k"))
    p = F.try_divide(F.col("k"), F.sum("k").over(Window.partitionBy(key)))
    return c.withColumn("p", p).groupBy(key).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p"))).alias("entropy"))


def orientation_vote(df: DataFrame, key: str, kind: str, up: str, down: str) -> DataFrame:
    """(key, votes, flipped): votes for upside down less votes for upright; a key turns over if more are for it."""
    v = F.sum(F.when(F.col(kind) == down, 1).when(F.col(kind) == up, -1).otherwise(0))
    return df.groupBy(key).agg(v.cast("long").alias("votes"), (v > 0).alias("flipped"))


def ordered_entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, entropy): natural entropy of the values of a key to 9 digits, ln n - sum(k ln k) / n over the counts k in order of size,
    so that equal counts have equal entropies however rows arrive. Null values don't count; a key without any has null."""
    k = df.groupBy(key, value).agg(F.count(value).cast("double").alias("_k"))
    counts = k.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("_k") > 0, F.col("_k")))).alias("_ks"))  # one number a value
    n, s = (F.aggregate("_ks", F.lit(0.0), f) for f in (lambda a, x: a + x, lambda a, x: a + x * F.log(x)))
    return counts.select(key, F.when(F.size("_ks") > 0, F.round(F.log(n) - s / n, 9)).alias("entropy"))


def flipped_by_entropy(df: DataFrame, key: str, upright: str, turned: str) -> DataFrame:
    """(key, flipped): whether the first characters read turned are more ordered than upright; equal ones stay, keys without a value on
    either side turn over."""
    a, b = (ordered_entropy(df, key, value).withColumnRenamed("entropy", name) for value, name in ((upright, "ea"), (turned, "eb")))
    return a.join(b, key, "full").select(key, F.coalesce(F.col("ea") > F.col("eb"), F.lit(True)).alias("flipped"))


def reading_method(words: DataFrame, key: str, length: str, few: int = 10, short: int = 2) -> DataFrame:
    """(key, method): 1 for streets with few words or mostly short ones, else 2."""
    return words.groupBy(key).agg(F.when((F.count("*") < few) | (2 * F.count_if(F.col(length) <= short) > F.count("*")), 1).otherwise(2).alias("method"))


def best_model(models: DataFrame) -> DataFrame:
    """The model with the highest accuracy, the first name of equal ones."""
    return models.orderBy(F.desc("accuracy"), "model").limit(1)


def compare_models(first: DataFrame, second: DataFrame, key: str = "sample_id") -> DataFrame:
    """(label, n, agree): by the first model's label, the samples that both have predicted and those they agree on."""
    both = first.select(key, F.col("label").alias("label")).join(second.select(key, F.col("label").alias("other")), key)
    return both.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("other")).alias("agree"))
