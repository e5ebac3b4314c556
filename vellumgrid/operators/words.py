"""Letters within words: the narrow letter I, windows of a reader, spacing of components, images joined side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a reader's window and the step of a profile; the widest I and the narrowest letters that may be wider.
WINDOW, PROFILE_STEP, NARROW, WIDEST_I, WIDEST_LETTER = 72, 8, 12, 16, 48
#: The best weight under which a narrow candidate is an I, the least weight of I then, and its confidence.
UNSURE, LEAST_I, I_CONFIDENCE = 0.5, 0.2, 0.93
#: Fixed value: the second model's weight of I that keeps one.
SECOND_I = 0.42


def slot(x1: Column, x2: Column, width: int = WINDOW) -> tuple[Column, Column]:
    """Start and end of a crop x1..x2 in the middle of a window; what is wider is cut at the right."""
    start = F.greatest(F.lit(0), ((width - (x2 - x1)) / 2).cast("int"))
    return start, F.least(start + x2 - x1, F.lit(width)).cast("int")


def letter_choice(weights: Column, width: Column, letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """Struct (letter, p, kept) from one weight a letter: the best, but I in a narrow crop where that is unsure; too wide crops aren't kept."""
    best = F.array_max(weights)
    first = F.substring(F.lit(letters), F.array_position(weights, best).cast("int"), F.lit(1))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    narrow = (width <= NARROW) & ((first == "I") | ((best < UNSURE) & (F.get(weights, F.lit(letters.index("I"))) > LEAST_I)))
    letter = F.when(narrow, F.lit("I")).otherwise(first)
    wide = ((width > WIDEST_LETTER) & ~letter.isin("M", "W")) | ((width > WIDEST_I) & (letter == "I"))
    return F.struct(letter.alias("letter"), F.when(narrow, I_CONFIDENCE).otherwise(best / total).alias("p"), (~wide).alias("kept"))


def without_false_i(letters: DataFrame, key: str = "word_id", least: float = SECOND_I) -> DataFrame:
    """Rows (key, pos, letter, weight of I by a second model) without the letters I that it doesn't see and those right after a kept I.

    A dropped letter doesn't count as one before, so of a stretch of seen ones every second stays.
    """
    seen = (F.col("letter") == "I") & (F.col("weight") >= least)
    order = Window.partitionBy(key).orderBy("pos")
    runs = letters.withColumn("_seen", F.coalesce(seen, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_seen"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.sum(F.col("_seen").cast("int")).over(Window.partitionBy(key, "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("_place", place).where((F.col("letter") != "I") | (F.col("_seen") & (F.col("_place") % 2 == 1))).drop("_seen", "_run", "_place")


def profile_windows(images: DataFrame, width: int = WINDOW, step: int = PROFILE_STEP) -> DataFrame:
    """All columns and x1, x2 of the windows that slide over an image of `width`; an image narrower than a window has one."""
    last = F.greatest(F.lit(0), F.col("width") - width)
    return images.withColumn("x1", F.explode(F.sequence(F.lit(0), last.cast("int"), F.lit(step)))).withColumn("x2", F.least(F.col("x1") + width, F.col("width")).cast("int"))


@dataclass(frozen=True)
class WordCheck:
    """Bounds of one kind of word, in shares of its height (areas, thickness), a sine, and pixels."""

    least_area: float
    most_area: float
    most_thickness: float
    most_slant: float
    least_space: float
    most_space: float
    dots: int


#: Fixed values of words on houses and of street names, whose components up to some area are dots and don't count.
PLAIN_WORD, STREET_WORD = WordCheck(0.5, 2.2, 0.2, 0.2, 6, 26, 0), WordCheck(0.5, 4.5, 0.5, 0.13, 12, 50, 5)


def check_words(parts: DataFrame, check: WordCheck, key: str = "word_id") -> DataFrame:
    """(key, parts, passes): whether the components (key, x, y, area, rows: height of the word) of a word stand like letters.

    At least two, of fitting area, in a thin and level row with even spaces. The row is the main axis of the whole centroids.
    """
    c = F.col
    big = parts.where(c("area") > check.dots).select(key, c("x").cast("int").alias("x"), c("y").cast("int").alias("y"), "area", "rows")
    axis = big.groupBy(key).agg(F.count("*").alias("parts"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("turn"), F.bool_and((c("area") >= check.least_area * c("rows")) & (c("area") <= check.most_area * c("rows"))).alias("fit"), F.max("rows").alias("high"))
    placed = big.join(axis, key).withColumns({"along": (c("x") - c("mx")) * F.cos("turn") + (c("y") - c("my")) * F.sin("turn"), "across": (c("y") - c("my")) * F.cos("turn") - (c("x") - c("mx")) * F.sin("turn")})
    space = c("along") - F.lag("along").over(Window.partitionBy(key).orderBy("along"))
    rows = placed.withColumn("space", space).groupBy(key, "parts", "fit", "turn", "high").agg((F.max("across") - F.min("across")).alias("thick"), F.min("space").alias("near"), F.max("space").alias("far"))
    good = (c("parts") >= 2) & c("fit") & (c("thick") <= check.most_thickness * c("high")) & (F.abs(F.sin("turn")) <= check.most_slant) & (c("near") >= check.least_space) & (c("far") <= check.most_space)
    found = rows.select(key, "parts", good.alias("passes"))
    return parts.select(key).distinct().join(found, key, "left").select(key, F.coalesce("parts", F.lit(0)).cast("long").alias("parts"), F.coalesce("passes", F.lit(False)).alias("passes"))


def touching_overlap(left: DataFrame, right: DataFrame, pixels: int = 1, most: int = 7, key: str = "pair", widths: DataFrame | None = None) -> DataFrame:
    """(key, overlap): by how many columns the right image must slide over the left one until `pixels` cells coincide; not over most + 1,
    nor as far as a whole image, and 1 if the bound of the images comes first.

    left: key, r, c, width; right: the same. widths: (key, wa, wb) of all pairs; without it pairs are those with a set cell, and an image
    without one is as wide as the other. An empty image touches nothing. Cells coincide at one slide each, so the slides of all pairs of cells of a row are counted.
    """
    a = left.select(key, "r", F.col("c").alias("ca"), F.col("width").alias("wa"))
    b = right.select(key, "r", F.col("c").alias("cb"), F.col("width").alias("wb"))
    if widths is None:
        widths = a.groupBy(key).agg(F.max("wa").alias("wa")).join(b.groupBy(key).agg(F.max("wb").alias("wb")), key, "full").select(key, F.coalesce("wa", "wb").alias("wa"), F.coalesce("wb", "wa").alias("wb"))
    slide = F.col("wa") - F.col("ca") + F.col("cb")
    met = a.join(b, (a[key] == b[key]) & (a["r"] == b["r"]) & slide.between(1, most + 1)).groupBy(a[key].alias(key), slide.alias("slide")).agg(F.count("*").alias("n")).where(F.col("n") >= pixels)
    first = met.groupBy(key).agg(F.min("slide").alias("slide"))
    bound = F.least("wa", "wb") - 1
    chosen = F.least(F.coalesce("slide", F.lit(most + 1)), F.lit(most + 1))
    return widths.join(first, key, "left").select(key, F.when(chosen <= bound, chosen).otherwise(1).cast("int").alias("overlap"))
