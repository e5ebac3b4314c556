"""Characters, words and components: adjacency, spacing, extents and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions.geometry import outside
from vellumgrid.operators.components import connected_components
from vellumgrid.params import CharacterPairs

_PARTS = ("char_id", "x", "y", "width", "height", "area", "from_curb", "from_middle", "ux", "uy")


def character_filter(chars: DataFrame) -> DataFrame:
    """Large enough, neither too wide nor too high, not too flat, with a known direction (15, 120, 100, 7)."""
    return chars.where("area >= 15 and width <= 120 and height <= 100 and width <= 7 * height and ux is not null")


def adjacent(p: CharacterPairs, a: str = "a_", b: str = "b_") -> Column:
    """Whether two characters belong to one word."""
    c = lambda k, n: F.col(f"{k}{n}")
    dx, dy = c(a, "x") - c(b, "x"), c(a, "y") - c(b, "y")
    near = dx * dx + dy * dy <= p.reach * p.reach
    large = (c(a, "area") >= p.least_area) & (c(b, "area") >= p.least_area)
    high = F.greatest(F.floor(c(a, "height")), F.floor(c(b, "height")))
    wide = F.greatest(F.floor(c(a, "width")), F.floor(c(b, "width")))
    middle = c(a, "from_curb") + c(b, "from_curb") > c(a, "from_middle") + c(b, "from_middle")
    dash = (2.5 * c(a, "height") < c(a, "width")) | (2.5 * c(b, "height") < c(b, "width"))
    up_a, up_b = c(a, "height") > p.upright * c(a, "width"), c(b, "height") > p.upright * c(b, "width")
    first = c(a, "area") > c(b, "area")
    ux, uy = F.when(first, c(a, "ux")).otherwise(c(b, "ux")), F.when(first, c(a, "uy")).otherwise(c(b, "uy"))
    ahead, across = F.abs(dx * ux + dy * uy), F.abs(-dx * uy + dy * ux)
    part = F.when(middle, p.middle_height).otherwise(p.edge_height)
    space = F.when(middle, p.middle_spacing).otherwise(p.edge_spacing)
    in_line = (up_a | up_b) & (across < high * part) & (ahead < (c(a, "width") + c(b, "width")) * space) & ~(middle & dash & (ahead > wide * 0.3))
    stacked = ~up_a & ~up_b & ~middle & (ahead < wide * part) & (across < (c(a, "height") + c(b, "height")) * space)
    return near & large & (in_line | stacked)


def character_pairs(chars: DataFrame, p: CharacterPairs = CharacterPairs()) -> DataFrame:
    """(u, v), u < v: adjacent characters in the same or a neighbouring grid cell.

    Cells compared are the same, right, below, and below to the right; the remaining diagonal only if p.whole_neighbourhood.
    """
    placed = chars.select(*_PARTS).withColumns({"cx": F.floor(F.col("x") / p.cell).cast("int"), "cy": F.floor(F.col("y") / p.cell).cast("int")})
    offsets = [(0, 0), (1, 0), (0, 1), (1, 1)] + [(1, -1)] * p.whole_neighbourhood
    a = placed.select(*(F.col(n).alias(f"a_{n}") for n in _PARTS), F.col("cx"), F.col("cy"), F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in offsets))).alias("o"))
    a = a.select(*(f"a_{n}" for n in _PARTS), (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("same"))
    b = placed.select(*(F.col(n).alias(f"b_{n}") for n in _PARTS), "cx", "cy")
    pairs = a.join(b, ["cx", "cy"]).where((~F.col("same") & (F.col("a_char_id") != F.col("b_char_id"))) | (F.col("a_char_id") < F.col("b_char_id"))).where(adjacent(p))
    return pairs.select(F.least("a_char_id", "b_char_id").alias("u"), F.greatest("a_char_id", "b_char_id").alias("v"))


def words(chars: DataFrame, p: CharacterPairs = CharacterPairs()) -> DataFrame:
    """(char_id, word_id): characters joined by adjacency; the word is named by its smallest character."""
    found = connected_components(character_pairs(chars, p), "words")
    return chars.select("char_id").join(found, F.col("char_id") == F.col("node"), "left").select("char_id", F.coalesce("component", "char_id").alias("word_id"))


def extents(points: DataFrame, key: str = "group_id") -> DataFrame:
    """Per group of points (x, y): extents and mean squares along x and y about the mean.

    The divisor of mean squares is one more than the number of points.
    """
    mean = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for name, f in (("low", F.min), ("high", F.max)) for c in ("x", "y")), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    spread = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}{c}") - F.col("n") * F.col(f"m{c}") * F.col(f"m{c}")) / (F.col("n") + 1)
    return mean.select(key, F.col("n").alias("points"), (F.col("high_x") - F.col("low_x")).alias("width"), (F.col("high_y") - F.col("low_y")).alias("height"), spread("x").alias("spread_w"), spread("y").alias("spread_h"), ((F.col("low_x") + F.col("high_x")) / 2).alias("center_x"), ((F.col("low_y") + F.col("high_y")) / 2).alias("center_y"))


def line_fit(points: DataFrame, key: str = "group_id") -> DataFrame:
    """(key, angle): direction of the least-squares line through each group of points, by second moments."""
    return points.groupBy(key).agg((0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("angle"))


def component_class(parts: DataFrame) -> DataFrame:
    """Adds is_marking, is_line and is_dash to rows with area, width, height, spread_w, spread_h; a dash is both of the others.

    Beyond an area of 3500 all is line; under 6 nothing is kept.
    """
    density = F.try_divide(F.col("area") * F.col("area").cast("double"), F.col("spread_w") * F.col("spread_h"))
    aspect = F.try_divide(F.col("width"), F.col("height"))
    fits = F.coalesce((F.col("width") < 140) & (F.col("height") < 105) & (density > 0.35) & (aspect < 13), F.lit(False))
    large, tiny = F.col("area") > 3500, F.col("area") < 6
    marking = ~large & ~tiny & fits
    dash = marking & F.coalesce((aspect > 4) & (F.col("width") > 10) & ((F.col("spread_h") < 2.4) | (F.col("height") < 8)), F.lit(False))
    return parts.withColumns({"is_marking": marking, "is_line": large | (~tiny & (~fits | dash)), "is_dash": dash})


def street_class(parts: DataFrame, scale: float = 0.1) -> DataFrame:
    """Adds is_street to rows with area, width, height, spread_w, spread_h; bounds are in pixels of the full map times scale."""
    square = scale * scale
    density = F.try_divide(F.col("area") * F.col("area").cast("double"), 256 * F.col("spread_w") * F.col("spread_h"))
    aspect = F.try_divide(F.col("spread_w"), F.col("spread_h"))
    large = F.col("area") > 1_500_000 * square
    small = (F.col("area") > 100_000 * square) & (density > 0.4) & (F.col("width") > 1200 * scale) & (F.col("spread_h") < 600 * scale) & (F.col("height") > 100 * scale) & (aspect > 10)
    return parts.withColumn("is_street", F.coalesce((large & (density < 0.8)) | (~large & small), F.lit(False)))


def spacing(chars: DataFrame, key: str = "group_id") -> DataFrame:
    """(key, gaps, street_penalty, number_penalty): distances of neighbours by x over their mean width, outside of what names and
    numbers have, as a mean of 100 a unit."""
    w = Window.partitionBy(key).orderBy("x", "char_id")
    after = chars.select(key, "x", "width", F.lead("x").over(w).alias("x2"), F.lead("width").over(w).alias("w2")).where("x2 is not null")
    ratio = (F.col("x2") - F.col("x")) / ((F.col("width") + F.col("w2")) / 2)
    return after.groupBy(key).agg(F.count("*").alias("gaps"), (100 * F.avg(outside(0.87, 2.3, 2, ratio))).alias("street_penalty"), (100 * F.avg(outside(0.37, 1.7, 2, ratio))).alias("number_penalty"))


def word_type(chars: DataFrame, key: str = "word_id") -> DataFrame:
    """Per word of two or more characters: penalties for heights, spacing and areas, and the kinds that follow."""
    tallest = Window.partitionBy(key)
    c = chars.withColumns({"hmax": F.max("height").over(tallest), "n": F.count("*").over(tallest), "word_area": F.sum("area").over(tallest)}).where("n >= 2")
    ratio, density = F.col("height") / F.col("hmax"), F.col("area") / F.col("height")
    bands = F.when(F.col("hmax") > 57, outside(10.0, 36.0, 0.35, density)).when(F.col("hmax") > 45, outside(8.0, 30.0, 0.35, density)).otherwise(outside(7.0, 21.0, 0.35, density))
    facts = c.groupBy(key).agg(
        F.sum(F.when(ratio > 0.4, 100.0 / (F.col("n") - 1) * outside(0.75, 1.0, 2, ratio)).otherwise(0.0)).alias("heights"),
        F.sum(F.when(ratio > 0.4, 0.0).otherwise(100.0)).alias("connected"),
        F.sum(100.0 / F.col("n") * outside(2.5, 12.0, 0.35, density)).alias("number_areas"),
        F.sum(F.when(2 * F.col("width") < F.col("height"), 0.0).otherwise(100.0 / F.col("n") * bands)).alias("street_areas"),
        (F.sum("from_curb") > F.sum("from_middle")).alias("middle"), F.first("word_area").alias("word_area"), F.first("n").alias("chars"),
    )
    gaps = spacing(c.where(F.col("height") > 0.5 * F.col("hmax")), key)
    j = facts.join(gaps, key, "left")
    street = F.coalesce("street_penalty", F.lit(0.0)) + F.when(F.col("middle"), 0).otherwise(30) + F.when(F.col("word_area") < 250, 40).otherwise(0)
    number = F.coalesce("number_penalty", F.lit(0.0)) + F.when(F.col("middle"), 20).otherwise(0) + F.when(F.col("word_area") < 95, 40).otherwise(0)
    j = j.withColumns({"street_score": street, "number_score": number})
    s, n, h = F.col("street_score"), F.col("number_score"), F.col("heights")
    j = j.withColumns({"is_street_name": (s < n) & (s < 35) & (h < 35), "is_house_number": (n < s) & (n < 35) & (h < 45)})
    perfect = (h < 1) & (F.col("connected") < 1) & ((F.col("is_street_name") & (s < 1) & (F.col("street_areas") < 1)) | (F.col("is_house_number") & (n < 1) & (F.col("number_areas") < 1)))
    return j.select(key, "chars", "heights", "street_score", "number_score", "street_areas", "number_areas", "is_street_name", "is_house_number", perfect.alias("connected_pass"), (h > 50).alias("not_a_word"))


def single_word_type(chars: DataFrame) -> DataFrame:
    """Adds kind (street name, house number or none) to characters that are words of their own."""
    middle = F.col("from_curb") > F.col("from_middle")
    inside = lambda c, low, high: (F.col(c) > low) & (F.col(c) < high)
    name = middle & inside("width", 30, 200) & inside("height", 20, 85) & (F.col("area") > 150)
    number = ~middle & inside("width", 30, 200) & inside("height", 15, 45) & (F.col("area") > 95)
    return chars.withColumn("kind", F.when(name, "street name").when(number, "house number").otherwise("none"))


def owners(points: DataFrame, grid: DataFrame, reach: int = 2) -> DataFrame:
    """(id, owner): the owner of a point's cell, else the first owner in the square of cells around it, x before y; null if none.

    points: id, r, c; grid: r, c, owner (one a cell).
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = F.flatten(F.transform(steps, lambda dx: F.transform(steps, lambda dy: F.struct(dx.alias("dx"), dy.alias("dy")))))
    tried = points.select("id", "r", "c", F.explode(around).alias("o")).select("id", (F.col("r") + F.col("o.dy")).alias("r"), (F.col("c") + F.col("o.dx")).alias("c"), F.when((F.col("o.dx") == 0) & (F.col("o.dy") == 0), F.struct(F.lit(-9).alias("dx"), F.lit(-9).alias("dy"))).otherwise(F.col("o")).alias("o"))
    found = tried.join(grid, ["r", "c"]).groupBy("id").agg(F.min_by("owner", "o").alias("owner"))
    return points.select("id").join(found, "id", "left")
