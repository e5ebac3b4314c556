"""Matching of streets and evidence for curbs, as distance joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellumgrid.functions import geometry as g
from vellumgrid.operators.folds import _whole_groups
from vellumgrid.operators.gridjoin import box_names, grid_join, with_box
from vellumgrid.operators.packed import AT_ONCE, pack, unpack
from vellumgrid.operators.tiles import BLOCK, coordinates, near_distances, near_pairs, runs, tile_pairs
from vellumgrid.params import CurbWeights, MarkingEvidence, ParallelEvidence, SideEvidence, StreetMatch
from vellumgrid.storage import dealt, write_table


def match_cost(a: g.Segment, b: g.Segment, p: StreetMatch = StreetMatch()) -> Column:
    """Square of the angle, and for each segment by its share of both lengths: distance and overshoot.

    Overshoot on either is priced by the first segment's length. Null if a segment has no length.
    """
    d = p.distance_weight * g.distance(a, b)
    share = F.try_divide(a.length, a.length + b.length)
    price = p.overshoot_weight * a.length
    return g.angle(a, b) * g.angle(a, b) + share * (d + price * g.overshoot(a, b)) + (1 - share) * (d + price * g.overshoot(b, a))


def extended_cost(a: g.Segment, b: g.Segment) -> Column:
    share = F.try_divide(a.length, a.length + b.length)
    return g.angle(a, b) * g.angle(a, b) + g.extended_distance(a, b) * share + g.extended_distance(b, a) * (1 - share)


def _matched(old: DataFrame, present: DataFrame, p: StreetMatch, schema: str, made: Callable[[np.ndarray, np.ndarray], list[pa.Array]], block: int) -> DataFrame:
    """made(ids of old streets, ids of present ones) for the pairs that cost less than the limit; an old street's pairs of a tile are in one call.

    A cost under the limit needs a distance under limit / weight, and bounds angle and overshoot as well.
    """
    reach, most = p.most_cost / p.distance_weight, p.most_cost
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = to_arrow_schema(StructType.fromDDL(schema))

    def kernel(cell: tuple[int, int], width: float, h: pa.Table, m: pa.Table) -> pa.Table:
        length = lambda t: np.hypot(t.column("x2").to_numpy() - t.column("x1").to_numpy(), t.column("y2").to_numpy() - t.column("y1").to_numpy())
        n, k, h_id, p_id = length(h), length(m), h.column("h_id").to_numpy(), m.column("p_id").to_numpy()
        bound = lambda a, b, c: most * (a + b) / (p.overshoot_weight * a * c)
        found = []
        for x in near_pairs(h, m, cell, width, reach, angle=most**0.5, over_ab=lambda a, b: bound(a, b, a), over_ba=lambda a, b: bound(a, b, b)):
            a, b = n[x.i], k[x.j]
            share = a / (a + b)
            cost = x.angle * x.angle + p.distance_weight * x.distance + p.overshoot_weight * a * (share * x.over_ab + (1 - share) * x.over_ba)
            good = cost < most
            if good.any():
                found.append(pa.RecordBatch.from_arrays(made(h_id[x.i[good]], p_id[x.j[good]]), names=names))
        return pa.Table.from_batches(found) if found else types.empty_table()

    end = ("x1", "y1", "x2", "y2")
    return tile_pairs(old.where("h_id is not null").select(F.col("h_id").cast("long"), *end), present.where("p_id is not null").select(F.col("p_id").cast("long"), *end), reach, kernel, schema, block)


def match_streets(old: DataFrame, present: DataFrame, p: StreetMatch = StreetMatch()) -> DataFrame:
    """(h_id, matches): for every old street (h_id, x1..y2) the sorted ids of the present ones (p_id, x1..y2) that cost less than
    the limit; an empty list if none does."""

    def lists(h_id: np.ndarray, p_id: np.ndarray) -> list[pa.Array]:
        order = np.lexsort((p_id, h_id))
        ids, starts = np.unique(h_id[order], return_index=True)
        return [pa.array(ids), pa.array([pack(x) for x in np.split(p_id[order], starts[1:])], pa.binary())]

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, parts = table.column("h_id").combine_chunks(), table.column("part").to_pylist()
        places, made, held = [], [], 0
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(parts)]):
            found = np.sort(np.concatenate([np.zeros(0, np.int64), *(unpack(x) for x in parts[a:b] if x is not None)]))
            for _ in range(parts[a:b].count(None)):  # a row without a part for each old street of the id
                places.append(a)
                made.append(found)
                held += len(found)
                if held > AT_ONCE:
                    yield batch(ids, places, made)
                    places, made, held = [], [], 0
        if places:
            yield batch(ids, places, made)

    def batch(ids: pa.Array, places: list[int], made: list[np.ndarray]) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *map(len, made)]), pa.int32())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made)))], names=["h_id", "matches"])

    # lists are held by a tile, so its blocks are small; they go to their street as packed bytes and are whole only there
    parts = _matched(old, present, p, "h_id long, part binary", lists, BLOCK // 2)
    rows = parts.unionByName(old.select(F.col("h_id").cast("long"), F.lit(None).cast("binary").alias("part")))
    found = _whole_groups(rows, "h_id", (), run, "h_id long, matches array<long>")
    return found.select(F.col("h_id").cast(old.schema["h_id"].dataType), "matches")


def match_counts(old: DataFrame, present: DataFrame, p: StreetMatch = StreetMatch()) -> DataFrame:
    """(h_id, n_matches): how many present streets `match_streets` finds for every old one, without lists."""

    def counts(h_id: np.ndarray, p_id: np.ndarray) -> list[pa.Array]:
        return [pa.array(x) for x in np.unique(h_id, return_counts=True)]

    found = _matched(old, present, p, "h_id long, n long", counts, BLOCK).groupBy("h_id").agg(F.sum("n").alias("n"))
    return old.select("h_id").join(found, "h_id", "left").select("h_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"))


def modern_evidence(lines: DataFrame, present: DataFrame, p: SideEvidence = SideEvidence()) -> DataFrame:
    """(group_id, modern_p, modern_n): for each long line, the share of its length whose lines have a present street beside them.

    lines: line_id, group_id, x1..y2. A line counts once for each side, however many streets are there. The side is the one of the
    street's middle, seen from the line's middle, by the normal of the line.
    """

    def kernel(cell: tuple[int, int], width: float, two: pa.Table, one: pa.Table) -> pa.Table:
        street, line = coordinates(two), coordinates(one)
        # halves of whole coordinates are dropped toward zero
        sx, sy = np.trunc((street[0] + street[2]) / 2), np.trunc((street[1] + street[3]) / 2)
        lx, ly, dx, dy = (line[0] + line[2]) / 2, (line[1] + line[3]) / 2, line[2] - line[0], line[3] - line[1]
        sides = np.zeros((2, line.shape[1]), bool)
        over = lambda a, b: p.most_overshoot
        left = np.arange(line.shape[1])  # lines that lack a side
        for run in runs(street.shape[1]):
            for x in near_pairs(two.take(pa.array(run)), one.take(pa.array(left)), cell, width, p.most_distance, angle=p.most_angle, over_ab=over):
                good = (x.angle < p.most_angle) & (x.distance < p.most_distance) & (x.over_ab < p.most_overshoot)
                i, j = run[x.i[good]], left[x.j[good]]
                positive = dx[j] * (sy[i] - ly[j]) - dy[j] * (sx[i] - lx[j]) >= 0
                sides[0, j[positive]] = True
                sides[1, j[~positive]] = True
            left = left[~sides[:, left].all(axis=0)]
            if not len(left):
                break
        seen = pa.array(np.flatnonzero(sides.any(axis=0)))
        return pa.table([*(one.column(c).take(seen) for c in ("line_id", "group_id", "w")), *(pa.array(np.where(x, np.sqrt(dx * dx + dy * dy), 0.0)).take(seen) for x in sides)], names=["line_id", "group_id", "w", "p", "n"])

    end = ("x1", "y1", "x2", "y2")
    group = lines.select("group_id").schema[0].dataType.simpleString()
    schema = f"line_id long, group_id {group}, w double, p double, n double"
    streets_, ours = present.select(*end).distinct(), lines.select(F.col("line_id").cast("long"), "group_id", *end, g.Segment.named().length.alias("w"))
    # one block of streets shows both sides of most lines; only the others meet all streets
    first = write_table(tile_pairs(streets_, ours, p.most_distance, kernel, schema, left_blocks="first"), "sides")
    own = ["line_id", "group_id", "w"]
    both = first.groupBy(*own).agg(F.max("p").alias("p"), F.max("n").alias("n")).where("p > 0 and n > 0").select(*own)
    seen = first.unionByName(tile_pairs(streets_, ours.join(dealt(both), own, "left_anti").select(*ours.columns), p.most_distance, kernel, schema, left_blocks="rest"))
    by_line = seen.groupBy("line_id", "group_id").agg(F.max("p").alias("p"), F.max("n").alias("n"))
    sums = by_line.groupBy("group_id").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = lines.groupBy("group_id").agg(F.sum(g.Segment.named().length).alias("length"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("length")), F.lit(0.0))
    return total.join(sums, "group_id", "left").select("group_id", share("p").alias("modern_p"), share("n").alias("modern_n"))


def parallel_evidence(lines: DataFrame, p: ParallelEvidence = ParallelEvidence()) -> DataFrame:
    """(group_id, parallel): share of a long line's length that runs beside lines of another long line, summed over those, at most 1."""
    total = lines.groupBy("group_id").agg(F.sum(g.Segment.named().length).alias("length"))

    def kernel(cell: tuple[int, int], width: float, one: pa.Table, two: pa.Table) -> pa.Table:
        groups = pa.concat_tables([one.select(["group_id"]), two.select(["group_id"])]).column(0).combine_chunks().dictionary_encode()
        code, names = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64), groups.dictionary
        own, other, enough = code[: one.num_rows], code[one.num_rows :], one.column("enough").to_numpy()
        over = lambda a, b: p.most_overshoot
        held, left = np.zeros(0, np.int64), np.arange(len(own))  # line and group in one number; lines that lack groups
        for run in runs(len(other)):
            found = [held]
            for x in near_pairs(one.take(pa.array(left)), two.take(pa.array(run)), cell, width, p.most_distance, angle=p.most_angle, over_ab=over, over_ba=over):
                a, b = left[x.i], other[run[x.j]]
                good = (own[a] != b) & (x.angle < p.most_angle) & (x.distance > p.least_distance) & (x.distance < p.most_distance) & (x.over_ab + x.over_ba < p.most_overshoot)
                found.append(np.unique(a[good] * len(names) + b[good]))
            held = np.unique(np.concatenate(found))
            left = left[np.bincount(held // max(1, len(names)), minlength=len(own))[left] < enough[left]]
            if not len(left):
                break
        i, group = np.divmod(held, max(1, len(names)))
        few = np.arange(len(i)) - np.searchsorted(i, i) < enough[i]
        i, group = pa.array(i[few]), pa.array(group[few])
        return pa.table([one.column("line_id").take(i), one.column("group_id").take(i), names.take(group), one.column("w").take(i)], names=["a_id", "a_group", "b_group", "w"])

    end = ("x1", "y1", "x2", "y2")
    group = lines.select("group_id").schema[0].dataType.simpleString()
    known = lines.where("group_id is not null")
    # so many other long lines beside one line alone make the share 1, whichever they are, and there are no more than all others
    enough = F.least(F.coalesce(F.ceil(F.try_divide(F.col("length"), F.col("w"))) + 1, F.lit(1)).cast("long"), F.col("others"))
    others = known.agg((F.greatest(F.count_distinct("group_id"), F.lit(2)) - 1).alias("others"))
    sized = known.withColumn("w", g.Segment.named().length).join(total, "group_id").crossJoin(F.broadcast(others)).select(F.col("line_id").cast("long"), "group_id", *end, "w", enough.alias("enough"))
    all_, schema = known.select(F.col("line_id").cast("long"), "group_id", *end), f"a_id long, a_group {group}, b_group {group}, w double"
    # one block of other lines shows most lines enough; only the rest meet all of them
    first = write_table(tile_pairs(sized, all_, p.most_distance, kernel, schema, right_blocks="first"), "beside")
    own = ["line_id", "group_id", "w"]
    have = first.groupBy(F.col("a_id").alias("line_id"), F.col("a_group").alias("group_id"), "w").agg(F.count_distinct("b_group").alias("have"))
    rest = sized.join(dealt(have), own, "left").where(F.coalesce("have", F.lit(0)) < F.col("enough")).select(*sized.columns)
    seen = first.unionByName(tile_pairs(rest, all_, p.most_distance, kernel, schema, right_blocks="rest"))
    flags = seen.groupBy("a_id", "a_group", "b_group").agg(F.max("w").alias("w"))
    sums = flags.groupBy(F.col("a_group").alias("group_id")).agg(F.sum("w").alias("w"))
    return total.join(sums, "group_id", "left").select("group_id", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("w"), F.col("length")), F.lit(0.0))).alias("parallel"))


def marking_evidence(lines: DataFrame, marks: DataFrame, p: MarkingEvidence = MarkingEvidence()) -> DataFrame:
    """(line_id, marking_p, marking_n): markings (x, y, size) near each side of a line, close ones and far ones, each up to a number."""
    one = with_box(lines.select("line_id", *(F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2"))), "l_")
    two = marks.select(F.col("x").alias("mx"), F.col("y").alias("my"), F.col("size").alias("msize"))
    line = g.Segment.named("l_")
    pairs = grid_join(one, two, box_names("l_"), ("mx", "my", "mx", "my"), p.far, p.cell)
    n = F.greatest(line.length, F.lit(1e-300))
    gx, gy = F.col("mx") - (line.x1 + line.x2) / 2, F.col("my") - (line.y1 + line.y2) / 2
    ahead, off = (gx * line.dx + gy * line.dy) / n, F.abs(-gx * line.dy + gy * line.dx) / n
    near = pairs.withColumns({"off": off, "side": g.beside(line, gx, gy)}).where((F.abs(ahead) <= line.length / 2) & (F.col("off") <= p.far))

    def evidence(positive: bool) -> Column:
        here = F.col("side") == positive
        close, far = (F.least(F.lit(p.most_counted), F.count_if(here & x)) for x in (F.col("off") <= p.close, F.col("off") > p.close))
        return (close * p.close_weight + F.sum(F.when(here, F.col("msize")).otherwise(0)) * p.size_weight + far * p.far_weight) / p.most_counted

    found = near.groupBy("line_id").agg(evidence(True).alias("p"), evidence(False).alias("n"))
    return lines.select("line_id").join(found, "line_id", "left").select("line_id", F.coalesce("p", F.lit(0.0)).alias("marking_p"), F.coalesce("n", F.lit(0.0)).alias("marking_n"))


def branch_evidence(lines: DataFrame, most_length: float = 600.0, bonus: float = 0.08) -> DataFrame:
    """(line_id, branches_p, branches_n, score_p, score_n): other lines that leave from an end of a line, by side.

    Ends meet where their whole coordinates are equal. A side's score is `bonus` a branch and the lengths there, each up to
    most_length, over ten times most_length.
    """
    end = lambda k: lines.select(
        F.col("line_id"), g.truncated(F.col(f"x{k}")).alias("vx"), g.truncated(F.col(f"y{k}")).alias("vy"), F.col(f"x{3 - k}").alias("ox"), F.col(f"y{3 - k}").alias("oy"), F.lit(k).alias("end")
    )
    ends = end(1).unionByName(end(2))
    own = ends.join(lines, "line_id")
    other = ends.join(lines.select("line_id", g.Segment.named().length.alias("other_length")), "line_id").select(F.col("line_id").alias("other"), "vx", "vy", F.col("ox").alias("bx"), F.col("oy").alias("by"), "other_length")
    pairs = own.join(other, ["vx", "vy"]).where("line_id <> other")
    side = g.beside(g.Segment.named(), F.col("bx") - F.col("vx"), F.col("by") - F.col("vy"))
    length = F.least(F.lit(most_length), F.col("other_length"))
    found = pairs.withColumn("side", side).groupBy("line_id").agg(
        F.count_if("side").alias("p"), F.count_if(~F.col("side")).alias("n"), F.sum(F.when(F.col("side"), length).otherwise(0.0)).alias("lp"), F.sum(F.when(~F.col("side"), length).otherwise(0.0)).alias("ln")
    )
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    score = lambda n, s: F.least(F.lit(1.0), F.coalesce(bonus * F.col(n) + F.col(s) / (10 * most_length), F.lit(0.0)))
    return lines.select("line_id").join(found, "line_id", "left").select("line_id", number("p").alias("branches_p"), number("n").alias("branches_n"), score("p", "lp").alias("score_p"), score("n", "ln").alias("score_n"))


def curb_decision(evidence: DataFrame, w: CurbWeights = CurbWeights()) -> DataFrame:
    """Adds curb_score_<side> and curb_<side> for sides p and n to rows with length, gaps and, for each side, evidence columns
    modern, branch, end, flood, marking and parallel (null counts as 0)."""
    out = {}
    for s in ("p", "n"):
        parts = sum((getattr(w, k) * F.coalesce(F.col(f"{k}_{s}"), F.lit(0.0)) for k in ("modern", "branch", "end", "flood", "marking", "parallel")), F.lit(0.0))
        score = parts + w.length * F.col("length") / (F.col("gaps") + 1)
        out |= {f"curb_score_{s}": score, f"curb_{s}": score > w.threshold}
    return evidence.withColumns(out)


def curb_to_street_distance(curbs: DataFrame, most_distance: float, default: float) -> DataFrame:
    """(line_id, distance): mean distance of a curb line to the others within reach, or a default if none is."""

    def kernel(cell: tuple[int, int], width: float, one: pa.Table, two: pa.Table) -> pa.Table:
        one, two = one.sort_by("line_id"), two.sort_by("line_id")
        ids = [t.column("line_id").to_numpy() for t in (one, two)]
        n, total = ([np.zeros(len(x), kind) for x in ids] for kind in (np.int64, np.float64))
        for i, j, there, back in near_distances(one, two, "line_id", cell, width, most_distance):
            for side, at, d in ((0, i, there), (1, j, back)):
                good = d < most_distance
                n[side] += np.bincount(at[good], minlength=len(n[side]))
                total[side] += np.bincount(at[good], d[good], len(n[side]))
        seen = [x > 0 for x in n]
        return pa.table([np.concatenate([x[s] for x, s in zip(v, seen)]) for v in (ids, total, n)], names=["line_id", "total", "n"])

    known = curbs.where("line_id is not null").select(F.col("line_id").cast("long"), "x1", "y1", "x2", "y2")
    sums = tile_pairs(known, known, most_distance, kernel, "line_id long, total double, n long")
    near = sums.groupBy("line_id").agg((F.sum("total") / F.sum("n")).alias("distance"))
    return curbs.select("line_id").join(near, "line_id", "left").select("line_id", F.coalesce("distance", F.lit(default)).alias("distance"))


def greedy_one_to_one(pairs: DataFrame, key: str = "vertex", most: float | None = None) -> DataFrame:
    """(key, a, b, score) of the pairs taken: within a key, the best pair of unmatched members again and again, ties to smaller (a, b).

    pairs: key, a, b, score; a key is a vertex, so its group is as small as the lines that meet there. Only pairs under `most`.
    """
    schema = f"{key} long, a long, b long, score double"

    def take(rows):
        used: set[int] = set()
        keep = []
        for i in rows.sort_values(["score", "a", "b"]).itertuples(index=False):
            if i.a not in used and i.b not in used:
                used |= {i.a, i.b}
                keep.append((getattr(i, key), i.a, i.b, i.score))
        return type(rows)(keep, columns=[key, "a", "b", "score"])

    good = pairs if most is None else pairs.where(F.col("score") < most)
    return good.select(F.col(key).cast("long"), F.col("a").cast("long"), F.col("b").cast("long"), F.col("score").cast("double")).groupBy(key).applyInPandas(take, schema)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: For each way of joining lines at a vertex, the greatest cosine of lines and of long lines; sums over -1.1 don't join.
VERTEX_BOUNDS = {"lines": (-0.80, -(3**0.5) / 2), "character lines": (-0.73, -0.8), "extended streets": (-(3**0.5) / 2, -(3**0.5) / 2)}
MOST_VERTEX_SCORE = -1.1


def vertex_score(way: str, line_cosine: Column, long_cosine: Column) -> Column:
    """Score of joining two lines at a vertex, lower is better: cosine of the lines and half that of their long lines. Null if they
    don't join."""
    a, b = VERTEX_BOUNDS[way]
    score = line_cosine + 0.5 * long_cosine
    return F.when((line_cosine <= a) & (long_cosine <= b) & (score <= MOST_VERTEX_SCORE), score)


def gap_score(way: str, gap: Column, line_cosine: Column, long_cosine: Column, gap_cosine_1: Column, gap_cosine_2: Column) -> Column:
    """Score of joining two lines over a gap: the gap with the cosines; null if they don't join."""
    across, most = {"lines": (-0.95, 10.0), "extended streets": (0.5, 250.0)}[way]
    score = gap + line_cosine + 0.5 * long_cosine
    fits = (line_cosine <= -0.95) & (long_cosine <= -(3**0.5) / 2) & (gap_cosine_1 <= across) & (gap_cosine_2 <= across)
    return F.when(fits & (score <= most), score)


def vertex_pairs(lines: DataFrame, way: str = "lines") -> DataFrame:
    """(vertex, a, b, score): pairs of lines that join where their ends have equal whole coordinates; a long line is the line alone."""
    end = lambda k: lines.select(F.col("line_id"), g.truncated(F.col(f"x{k}")).alias("vx"), g.truncated(F.col(f"y{k}")).alias("vy"), (F.col(f"x{3 - k}") - F.col(f"x{k}")).alias("dx"), (F.col(f"y{3 - k}") - F.col(f"y{k}")).alias("dy"))
    ends = end(1).unionByName(end(2))
    a, b = (ends.select("vx", "vy", *(F.col(c).alias(f"{k}_{c}") for c in ("line_id", "dx", "dy"))) for k in "ab")
    cosine = g.cosine(*(F.col(c) for c in ("a_dx", "a_dy", "b_dx", "b_dy")))
    pairs = a.join(b, ["vx", "vy"]).where("a_line_id < b_line_id").withColumn("score", vertex_score(way, cosine, cosine)).where("score is not null")
    return pairs.select("vx", "vy", F.col("a_line_id").alias("a"), F.col("b_line_id").alias("b"), "score")


def flood_evidence(lines: DataFrame, flood: DataFrame, mask: DataFrame, short: float = 5.0, long: float = 15.0) -> DataFrame:
    """(line_id, flood_p, flood_n): four probes across the middle of each line, near and far on both sides.

    flood: cells (r, c) of large open areas; mask: cells (r, c) of the map. A probe in the open or off the map counts for its side, one
    in the open far on the other side against it.
    """
    s = g.Segment.named()
    probe = lambda name, d: F.struct(F.lit(name).alias("name"), *(v.cast("int").alias(k) for k, v in zip(("c", "r"), g.from_end(s, s.length / 2, F.lit(d)))))
    probes = lines.select("line_id", F.explode(F.array(probe("pl", long), probe("ps", short), probe("ns", -short), probe("nl", -long))).alias("p")).select("line_id", "p.name", "p.r", "p.c")
    seen = probes.join(flood.select("r", "c", F.lit(1).alias("f")).distinct(), ["r", "c"], "left").join(mask.select("r", "c", F.lit(1).alias("m")).distinct(), ["r", "c"], "left")
    f = lambda name: F.max(F.when((F.col("name") == name) & F.col("f").isNotNull(), 1).otherwise(0))
    m = lambda name: F.max(F.when((F.col("name") == name) & F.col("m").isNull(), 1).otherwise(0))
    side = lambda x, y: 0.5 * f(f"{x}l") + 0.5 * f(f"{x}s") + 0.4 * m(f"{x}l") + 0.4 * m(f"{x}s") - 0.5 * f(f"{y}l") + 0.3 * m(f"{y}l")
    return seen.groupBy("line_id").agg(side("p", "n").alias("flood_p"), side("n", "p").alias("flood_n"))


def long_lines(lines: DataFrame, least: float, key: str = "group_id") -> DataFrame:
    """(key, length): long lines that take part: none of their lines is to be ignored (column ignore), and all together are long enough."""
    return lines.groupBy(key).agg(F.sum(g.Segment.named().length).alias("length"), F.max(F.coalesce("ignore", F.lit(False))).alias("_out")).where(~F.col("_out") & (F.col("length") >= least)).drop("_out")


#: Fixed value: the sum of branch, end and modern evidence up to which a side isn't worth a try.
LEAST_SIDE_SCORE = 0.3


def facing(pairs: DataFrame, a: str = "a_", b: str = "b_", least: float = LEAST_SIDE_SCORE) -> DataFrame:
    """Pairs of long lines that may have a street between them: the side of each that faces the other has evidence over `least`.

    pairs: for both prefixes x1..y2, score_p, score_n (sums of evidence). The side is the one of the other's middle seen from its own.
    """
    s, t = g.Segment.named(a), g.Segment.named(b)
    (sx, sy), (tx, ty) = g.midpoint(s), g.midpoint(t)
    side = lambda line, k, dx, dy: F.when(g.beside(line, dx, dy), F.col(f"{k}score_p")).otherwise(F.col(f"{k}score_n")) > least
    return pairs.where(side(s, a, tx - sx, ty - sy) & side(t, b, sx - tx, sy - ty))


#: The length from which a street may lie askew, how far its direction may be from the map's at its place, the least length.
LONG_STREET, LEAST_ALIGNMENT, LEAST_STREET = 600, 0.8, 100


def carvable(width: Column, ux: Column, uy: Column, local_x: Column, local_y: Column) -> Column:
    """Whether a street is carved: long enough, and long or along the direction that the map has at its place."""
    aligned = F.abs(ux * local_x + uy * local_y)
    return ~(((width < LONG_STREET) & (aligned < LEAST_ALIGNMENT)) | (width < LEAST_STREET))
