"""Lines joined end to end to long lines: passes at vertices, then over gaps.

Every end of a line is joined once at most. A pass scores pairs of free ends, lower is better, with the state of the long lines that the
last pass left: from a free end, a long line points to its other free end. Within a pass pairs are taken by local
dominance: each round takes the pairs that are the best for both of their ends, which is what taking the best pair again and again
comes to, but all over the map at once. No map, group or vertex is a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as g
from vellumgrid.operators import streets
from vellumgrid.operators.components import connected_components
from vellumgrid.operators.linking import rank_lists
from vellumgrid.storage import dealt, write_table

#: Width of the cells in which ends over a gap are looked for.
CELLS = {"lines": 25.0, "extended streets": 1000.0}
#: Cells that a cell is compared with: itself, right, below, below and right. The other diagonal is compared on request.
HALF, OTHER_DIAGONAL = ((0, 0), (1, 0), (0, 1), (1, 1)), (-1, 1)


def line_ends(lines: DataFrame, key: str = "map_id") -> DataFrame:
    """Two rows (key, e, x, y, dx, dy, far, fx, fy) for each line: e is twice the line and 0 or 1, (dx, dy) points along the line, far is the
    end at the other end of the long line, here of the line itself, at (fx, fy)."""
    rows = [
        F.struct((F.col("line_id") * 2 + k).cast("long").alias("e"), *(F.col(f"{c}{k + 1}").cast("double").alias(c) for c in "xy"), *((F.col(f"{c}{2 - k}") - F.col(f"{c}{k + 1}")).cast("double").alias(f"d{c}") for c in "xy"),
                 (F.col("line_id") * 2 + 1 - k).cast("long").alias("far"), *(F.col(f"{c}{2 - k}").cast("double").alias(f"f{c}") for c in "xy"))
        for k in (0, 1)
    ]
    return lines.select(F.col(key).cast("long").alias(key), F.inline(F.array(*rows)))


def _sides(ends: DataFrame, key: str, *more: str) -> tuple[DataFrame, DataFrame]:
    names = ("e", "x", "y", "dx", "dy", "far", "fx", "fy", *more)
    return tuple(ends.select(key, *(F.col(c).alias(f"{side}_{c}") for c in names)) for side in "ab")


def _cosines() -> tuple[Column, Column]:
    """Of the two lines, and of the two long lines as seen from their ends; null where one has no length."""
    c = F.col
    long_line = lambda s: (c(f"{s}_fx") - c(f"{s}_x"), c(f"{s}_fy") - c(f"{s}_y"))
    return g.cosine(c("a_dx"), c("a_dy"), c("b_dx"), c("b_dy")), g.cosine(*long_line("a"), *long_line("b"))


def vertex_candidates(ends: DataFrame, way: str, key: str = "map_id") -> DataFrame:
    """(a, b, score): free ends of two lines at one vertex (equal whole coordinates), a under b."""
    at = ends.withColumns({"vx": g.truncated(F.col("x")), "vy": g.truncated(F.col("y"))})
    a, b = _sides(at, key, "vx", "vy")
    pairs = a.join(dealt(b), (a[key] == b[key]) & (F.col("a_vx") == F.col("b_vx")) & (F.col("a_vy") == F.col("b_vy")) & (F.col("a_e") < F.col("b_e")) & (F.floor(F.col("a_e") / 2) < F.floor(F.col("b_e") / 2)))
    return pairs.select(F.col("a_e").alias("a"), F.col("b_e").alias("b"), streets.vertex_score(way, *_cosines()).alias("score")).where("score is not null")


def gap_candidates(ends: DataFrame, way: str, key: str = "map_id", whole: bool = False) -> DataFrame:
    """(a, b, score): free ends of two long lines in neighbouring cells that may be joined over the gap between them, a under b.

    As only half of the neighbours are looked at, ends in cells that touch up to the right have no pair unless `whole`.
    """
    cell = CELLS[way]
    at = ends.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    a, b = _sides(at, key, "cx", "cy")
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in (*HALF, OTHER_DIAGONAL)[: 5 if whole else 4]))
    a = a.withColumn("step", F.explode(near)).withColumns({"tx": F.col("a_cx") + F.col("step.i"), "ty": F.col("a_cy") + F.col("step.j")})
    here = (F.col("step.i") == 0) & (F.col("step.j") == 0)
    met = a.join(dealt(b), (a[key] == b[key]) & (F.col("tx") == F.col("b_cx")) & (F.col("ty") == F.col("b_cy")) & (~here | (F.col("a_e") < F.col("b_e"))) & (F.col("a_e") != F.col("b_e")) & (F.col("a_far") != F.col("b_e")))
    # step by step, as each is used more than once; all of it is the same for (b, a)
    line, long_line = _cosines()
    pairs = met.withColumns({"gx": F.col("b_x") - F.col("a_x"), "gy": F.col("b_y") - F.col("a_y")})
    pairs = pairs.withColumns({"line": line, "long_line": long_line, "across_a": g.cosine(F.col("gx"), F.col("gy"), F.col("a_dx"), F.col("a_dy")), "across_b": g.cosine(-F.col("gx"), -F.col("gy"), F.col("b_dx"), F.col("b_dy"))})
    score = streets.gap_score(way, F.hypot("gx", "gy"), *(F.col(c) for c in ("line", "long_line", "across_a", "across_b")))
    return pairs.select(F.least("a_e", "b_e").alias("a"), F.greatest("a_e", "b_e").alias("b"), score.alias("score")).where("score is not null")


def dominant(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, score) that are the best for both ends; ties go to the smaller (a, b)."""
    order = F.struct("score", "a", "b")
    best = pairs.select(F.explode(F.array("a", "b")).alias("e"), order.alias("pair")).groupBy("e").agg(F.min("pair").alias("pair"))
    return best.groupBy("pair").agg(F.count("*").alias("n")).where("n = 2").select("pair.a", "pair.b", "pair.score")


def _partners(taken: DataFrame) -> DataFrame:
    return taken.select(F.inline(F.array(F.struct(F.col("a").alias("e"), F.col("b").alias("partner")), F.struct(F.col("b").alias("e"), F.col("a").alias("partner")))))


def _walk(ends: DataFrame, taken: DataFrame) -> DataFrame:
    """From every free end along its long line and the pairs taken, as lists: (node, head, steps, ring)."""
    next_ = _partners(taken).select(F.col("e").alias("_e"), "partner")
    return rank_lists(ends.join(dealt(next_), F.col("far") == F.col("_e"), "left").select(F.col("e").alias("node"), F.col("partner").alias("next")), "long-lines")


def rejoined(ends: DataFrame, taken: DataFrame, key: str = "map_id") -> DataFrame:
    """Free ends after pairs were taken: each points to the end that its longer line has now; ends that are taken, and rings, go."""
    lists = _walk(ends, taken).where("not ring").select(F.col("node").alias("_n"), F.col("head").alias("_head"))
    # the head is where the last long line is entered: the new far end is that line's own
    last = ends.select(F.col("e").alias("_h"), F.col("far").alias("_far"), F.col("fx").alias("_fx"), F.col("fy").alias("_fy"))
    moved = ends.join(dealt(lists), F.col("e") == F.col("_n")).join(dealt(last), F.col("_head") == F.col("_h"))
    gone = _partners(taken).select("e")
    return write_table(moved.join(dealt(gone), "e", "left_anti").select(key, "e", "x", "y", "dx", "dy", F.col("_far").alias("far"), F.col("_fx").alias("fx"), F.col("_fy").alias("fy")), "free-ends")


def open_rings(ends: DataFrame, taken: DataFrame) -> DataFrame:
    """The pairs taken, but of each ring that they would close the worst."""
    ring = _walk(ends, taken).where("ring").select("node", "head")
    one, two = (ring.select(F.col("node").alias(side), F.col("head").alias(f"head_{side}")) for side in "ab")
    # a ring is walked both ways, which its pairs enter at one end each
    rings = taken.join(dealt(one), "a").join(dealt(two), "b").select(F.least("head_a", "head_b").alias("ring"), F.struct("score", "a", "b").alias("pair"))
    worst = rings.groupBy("ring").agg(F.max("pair").alias("w")).select("w.a", "w.b")
    return taken.join(dealt(worst), ["a", "b"], "left_anti")


def _vertex_pass(ends: DataFrame, way: str, key: str) -> DataFrame:
    """All pairs that one pass at the vertices takes. Scores are those at its start."""
    left = write_table(vertex_candidates(ends, way, key), "vertex-candidates")
    taken = None
    while left.limit(1).count():
        now = write_table(dominant(left), "vertex-pairs")
        used = _partners(now).select("e")
        taken = now if taken is None else taken.unionByName(now)
        left = write_table(left.join(dealt(used.withColumnRenamed("e", "a")), "a", "left_anti").join(dealt(used.withColumnRenamed("e", "b")), "b", "left_anti"), "vertex-candidates")
    return taken


def merge_polylines(lines: DataFrame, way: str = "lines", vertex_passes: int = 2, gap_way: str | None = "lines", whole: bool = False, key: str = "map_id") -> DataFrame:
    """(key, line_id, group_id, gaps): lines of each map grouped to long lines; a group is called after its smallest line, gaps are its
    pairs over a gap.

    lines: key, line_id (unique over all maps), x1, y1, x2, y2; a null coordinate leaves its line alone. way, gap_way: kinds of scores, see
    `streets.vertex_score` and `streets.gap_score`. At vertices a pass joins free ends whose long lines, as the last pass left them, run on;
    it may close a ring. Over gaps, rounds follow each other with new scores until none takes a pair; none joins a long line to itself, and of
    a ring that several pairs would close at once the worst pair stays out. An empty table gives none.
    """
    lines = lines.select(key, "line_id", "x1", "y1", "x2", "y2")
    ends = write_table(line_ends(lines.where("x1 + y1 + x2 + y2 is not null"), key), "free-ends")
    edges: list[DataFrame] = []
    for _ in range(vertex_passes):
        taken = _vertex_pass(ends, way, key)
        if taken is None:
            break
        edges.append(taken.withColumn("gap", F.lit(0)))
        ends = rejoined(ends, taken, key)
    while gap_way:
        taken = write_table(dominant(gap_candidates(ends, gap_way, key, whole)), "gap-pairs")
        if not taken.limit(1).count():
            break
        taken = write_table(open_rings(ends, taken), "gap-pairs")
        edges.append(taken.withColumn("gap", F.lit(1)))
        ends = rejoined(ends, taken, key)
    if not edges:
        return lines.select(F.col(key).cast("long").alias(key), F.col("line_id").cast("long").alias("line_id"), F.col("line_id").cast("long").alias("group_id"), F.lit(0).cast("long").alias("gaps"))
    joined = edges[0]
    for more in edges[1:]:
        joined = joined.unionByName(more)
    joined = joined.select(F.floor(F.col("a") / 2).alias("u"), F.floor(F.col("b") / 2).alias("v"), "gap")
    group = connected_components(joined.select("u", "v"), "long-lines")
    gaps = joined.where("gap = 1").join(dealt(group), F.col("u") == F.col("node")).groupBy(F.col("component").alias("_g")).agg(F.count("*").alias("gaps"))
    group_id = F.coalesce("component", "line_id").cast("long")
    found = lines.join(dealt(group), F.col("line_id") == F.col("node"), "left").select(F.col(key).cast("long").alias(key), F.col("line_id").cast("long").alias("line_id"), group_id.alias("group_id"))
    return found.join(dealt(gaps), F.col("group_id") == F.col("_g"), "left").select(key, "line_id", "group_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))
