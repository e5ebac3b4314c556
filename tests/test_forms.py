"""Linked lists, contours, skeleton graphs, growth and long lines against plain Python."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from vellumgrid.operators import contours, growth, linking, polylines, skeletons, streets
from vellumgrid.plans import fixtures as fx
from vellumgrid.plans import form_queries

SF = "/root/testdata/sf0.001"


# lists


def plain_ranks(follows: dict) -> set:
    out = set()
    for node in follows:
        walk, at = [node], node
        while follows[at] is not None and follows[at] in follows and follows[at] != node:
            at = follows[at]
            walk.append(at)
        ring = follows[at] == node
        head = min(walk) if ring else walk[-1]
        out.add((node, head, walk.index(head), ring))
    return out


def test_rank_lists(spark):
    rnd = random.Random(2)
    nodes = list(range(1, 161))
    rnd.shuffle(nodes)
    follows, at = {}, 0
    for size, ring in [(1, False), (1, True), (2, True), (37, False), (2, False), (40, True), (5, True), (64, False), (7, True)]:
        part, at = nodes[at : at + size], at + size
        follows |= dict(zip(part, [*part[1:], part[0] if ring else None]))
    last = nodes[at]
    follows[last] = 999_999  # no node: the list ends here
    found = linking.rank_lists(spark.createDataFrame(list(follows.items()), "node long, next long"))
    assert {tuple(r) for r in found.collect()} == plain_ranks(follows)
    assert found.count() == len(follows)
    assert linking.rank_lists(spark.createDataFrame([], "node long, next long")).count() == 0


# contours


def plain_contours(cells: set[tuple[int, int]], diagonal: bool) -> list[list[tuple[int, int, int]]]:
    """Contours as lists of (r, c, side) from the smallest edge on, by walking."""
    edges = {(r, c, s) for r, c in cells for s, (dr, dc) in enumerate([(-1, 0), (0, 1), (1, 0), (0, -1)]) if (r + dr, c + dc) not in cells}
    out = []
    while edges:
        first = e = min(edges)
        walk = []
        while True:
            edges.remove(e)
            walk.append(e)
            r, c, s = e
            ahead = [(0, 1), (1, 0), (0, -1), (-1, 0)][s]
            left = [(-1, 0), (0, 1), (1, 0), (0, -1)][s]
            right_cell = (r + ahead[0], c + ahead[1])
            left_cell = (right_cell[0] + left[0], right_cell[1] + left[1])
            if left_cell in cells and (diagonal or right_cell in cells):
                e = (*left_cell, (s - 1) % 4)
            elif right_cell in cells:
                e = (*right_cell, s)
            else:
                e = (r, c, (s + 1) % 4)
            if e == first:
                break
        out.append(walk)
    return out


def figures_of(rows) -> dict:
    out = collections.defaultdict(set)
    for img, r, c in rows:
        out[img].add((r, c))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_contours_of_random_figures(spark, diagonal):
    rnd = random.Random(4)
    rows = [(img, r, c) for img in "ab" for r in range(12) for c in range(12) if rnd.random() < 0.55] + [("one", 5, 5), ("ring", 0, 0), ("ring", 0, 1), ("ring", 1, 0), ("ring", 1, 2), ("ring", 2, 1), ("ring", 2, 2), ("ring", 0, 2), ("ring", 2, 0)]
    df = spark.createDataFrame([*rows, rows[0], (None, 1, 1), ("a", None, 2)], "img string, r int, c int")
    traced = contours.trace_contours(df, diagonal)
    found = collections.defaultdict(list)
    for t in sorted(traced.collect(), key=lambda t: (t["img"], t["contour_id"], t["pos"])):
        found[t["img"], t["contour_id"]].append((t["r"], t["c"]))
    want = {(img, k): [(r, c) for r, c, _ in walk] for img, cells in figures_of(rows).items() for k, walk in enumerate(plain_contours(cells, diagonal))}
    assert found == want
    areas = collections.Counter()
    for a in contours.contour_areas(traced).collect():
        areas[a["img"]] += a["area"]
        assert a["hole"] == (a["area"] < 0) and a["n"] == len(want[a["img"], a["contour_id"]])
    assert areas == {img: len(cells) for img, cells in figures_of(rows).items()}
    assert contours.trace_contours(df.limit(0)).count() == 0


def test_contour_queries_equal_walks(spark):
    cells = figures_of(tuple(r) for r in fx.figures(spark, SF).collect())
    want = {(img, k, pos, r, c) for img, own in cells.items() for k, walk in enumerate(plain_contours(own, True)) for pos, (r, c, _) in enumerate(walk)}
    got = [(t["img"], t["contour_id"], t["pos"], t["r"], t["c"]) for t in form_queries.contour_list(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    shapes = collections.Counter((t["img"], t["n"]) for t in form_queries.contour_shapes(spark, SF).collect())
    assert shapes == collections.Counter((img, len(walk)) for img, own in cells.items() for walk in plain_contours(own, False))


# skeleton graphs


def plain_merged(chains: dict) -> dict:
    chains = dict(chains)
    while True:
        at = collections.defaultdict(list)
        for k, (u, v, _) in chains.items():
            at[u].append(k)
            at[v].append(k)
        pair = next((sorted(ks) for _, ks in sorted(at.items()) if len(ks) == 2 and ks[0] != ks[1]), None)
        if pair is None:
            return chains
        a, b = pair
        ends = collections.Counter([*chains[a][:2], *chains[b][:2]])
        joint = next(x for x, ks in at.items() if sorted(ks) == pair)
        ends[joint] -= 2
        rest = sorted(ends.elements())
        chains[a] = (*rest, chains[a][2] + chains.pop(b)[2])


def plain_rings(chains: dict, before: dict) -> dict:
    """A ring made of whole rings of two-ended vertices starts at its smallest vertex; plain_merged leaves it at any."""
    out = {}
    for k, (u, v, n) in chains.items():
        if u == v and before[k][:2] != (u, v):
            at, seen = {k}, set()
            grew = True
            while grew:
                grew = False
                seen = {x for j in at for x in before[j][:2]}
                for j, (a, b, _) in before.items():
                    if j not in at and (a in seen or b in seen) and sum(x[2] for i, x in before.items() if i in at) < n:
                        at.add(j)
                        grew = True
            degree = collections.Counter(x for a, b, _ in before.values() for x in (a, b))
            if all(degree[x] == 2 for x in seen):
                u = v = min(seen)
        out[k] = (min(u, v), max(u, v), n)
    return out


def free(chains: dict, vertices: dict) -> list:
    degree = collections.Counter(x for u, v, _ in chains.values() for x in (u, v))
    out = []
    for k, (u, v, _) in chains.items():
        if min(degree[u], degree[v]) == 1 and max(degree[u], degree[v]) >= 3:
            branch = u if degree[u] >= 3 else v
            (x1, y1, _), (x2, y2, _) = vertices[u], vertices[v]
            out.append((branch, math.hypot(x1 - x2, y1 - y2), k, math.sqrt(vertices[branch][2]), degree[branch]))
    return sorted(out)


def plain_prune(chains: dict, vertices: dict, factor: float) -> tuple[dict, int]:
    merge = lambda c: plain_rings(plain_merged(c), c)
    now, rounds = merge(chains), 0
    while True:
        short = [x for x in free(now, vertices) if math.floor(x[1]) <= math.ceil(x[3] * (factor if rounds == 0 else 1.0))]
        cut = set()
        for branch in {x[0] for x in short}:
            own = [x for x in short if x[0] == branch]
            cut |= {x[2] for x in own[: own[0][4] - 2]}
        if not cut:
            return now, rounds
        now, rounds = merge({k: x for k, x in now.items() if k not in cut}), rounds + 1


def random_graph(seed: int) -> tuple[dict, dict]:
    rnd = random.Random(seed)
    vertices = {k: (rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(1, 300)) for k in range(60)}
    chains = {}
    for k in range(1, 50):  # a tree with some rings
        chains[len(chains)] = (rnd.randint(max(0, k - 4), k - 1), k, rnd.randint(2, 9))
    for _ in range(4):
        chains[len(chains)] = (rnd.randint(0, 49), rnd.randint(0, 49), rnd.randint(2, 9))
    chains |= {len(chains): (50, 51, 3), len(chains) + 1: (51, 52, 4), len(chains) + 2: (52, 50, 5), len(chains) + 3: (53, 53, 2), len(chains) + 4: (54, 55, 2)}
    return chains, vertices


def tables(spark, chains: dict, vertices: dict):
    return spark.createDataFrame([(k, *x) for k, x in chains.items()], "chain_id long, u long, v long, n long"), spark.createDataFrame([(k, *x) for k, x in vertices.items()], "vertex long, x int, y int, d2 int")


def as_dict(df) -> dict:
    return {r["chain_id"]: (r["u"], r["v"], r["n"]) for r in df.collect()}


def test_pruning_to_a_fixed_point(spark):
    chains, vertices = random_graph(5)
    want, rounds = plain_prune(chains, vertices, 1.3)
    found = [tuple(r) for r in skeletons.prune(*tables(spark, chains, vertices), 1.3).select("chain_id", "u", "v", "n", "rounds").collect()]
    assert {r[0]: r[1:4] for r in found} == want and {r[4] for r in found} == {rounds} and rounds > 1


def test_twins(spark):
    chains, vertices = random_graph(3)
    c, v = tables(spark, chains, vertices)
    cut = set()
    by_branch = collections.defaultdict(list)
    for branch, span, k, radius, _ in free(chains, vertices):
        by_branch[branch].append((k, span, radius))
    for own in by_branch.values():
        own = sorted(own)[:2]
        if len(own) == 2 and abs(math.ceil(own[0][1]) - math.ceil(own[1][1])) <= 7 and any(math.floor(s) <= math.ceil(r * 1.4) for _, s, r in own):
            cut |= {k for k, _, _ in own}
    left = {k: x for k, x in chains.items() if k not in cut}
    assert cut and as_dict(skeletons.prune_twins(c, v)) == plain_rings(plain_merged(left), left)


def test_pruning_queries(spark):
    chains, vertices = form_queries._skeleton_graph(spark, SF)
    c, v = as_dict(chains), {r["vertex"]: (r["x"], r["y"], r["d2"]) for r in vertices.collect()}
    assert len(c) > 50
    assert as_dict(skeletons.prune(chains, vertices, 1.2)) == plain_prune(c, v, 1.2)[0]


# growth


def plain_growth(seeds: list, mask: set, layers: int) -> dict:
    """One queue, as long as its marker hasn't come round."""
    queue = collections.deque((s, (r, c), 0) for s, _, r, c in sorted(seeds))
    owned = {}
    while queue:
        s, (r, c), layer = queue.popleft()
        if layer >= layers or (r, c) not in mask or (r, c) in owned:
            continue
        owned[r, c] = (s, layer)
        queue.extend((s, (r + dr, c + dc), layer + 1) for dr, dc in [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, 1), (1, -1), (-1, -1)])
    return owned


def test_growth_in_queue_order(spark):
    rnd = random.Random(9)
    mask = {(r, c) for r in range(20) for c in range(20) if rnd.random() < 0.8}
    seeds = [(s, p, rnd.randint(0, 19), rnd.randint(0, 19)) for s in range(5) for p in range(3)]
    df = growth.queue_growth(spark.createDataFrame([("a", *x) for x in seeds], "img string, source int, pos int, r int, c int"), spark.createDataFrame([("a", *x) for x in mask], "img string, r int, c int"), 5)
    assert {(r["r"], r["c"]): (r["source"], r["layer"]) for r in df.collect()} == plain_growth(seeds, mask, 5)


def test_growth_query(spark):
    cells = figures_of(tuple(r) for r in fx.figures(spark, SF).collect())
    want = {(img, *at, *x) for img, own in cells.items() for at, x in plain_growth([(c, r, r, c) for r, c in own if c % 8 == 0 and r % 2 == 0], own, 6).items()}
    got = [tuple(r) for r in form_queries.queue_growth(spark, SF).select("img", "r", "c", "source", "layer").collect()]
    assert len(got) == len(want) and set(got) == want


# long lines


class Map:
    """Lines of one map joined by the rules of polylines, one pair at a time."""

    def __init__(self, lines: list[tuple]):
        self.at, self.far = {}, {}
        for k, x1, y1, x2, y2 in lines:
            self.at[2 * k], self.at[2 * k + 1] = (x1, y1, x2 - x1, y2 - y1), (x2, y2, x1 - x2, y1 - y2)
            self.far[2 * k], self.far[2 * k + 1] = 2 * k + 1, 2 * k
        self.free = set(self.at)
        self.group = {k: k for k, *_ in lines}
        self.edges, self.gaps = [], collections.Counter()

    @staticmethod
    def cosine(ax, ay, bx, by):
        n = math.sqrt(ax * ax + ay * ay) * math.sqrt(bx * bx + by * by)
        return (ax * bx + ay * by) / n if n else None

    def cosines(self, a: int, b: int):
        long_line = lambda e: (self.at[self.far[e]][0] - self.at[e][0], self.at[self.far[e]][1] - self.at[e][1])
        return self.cosine(*self.at[a][2:], *self.at[b][2:]), self.cosine(*long_line(a), *long_line(b))

    def vertex_score(self, a: int, b: int, way: str):
        c, d = self.cosines(a, b)
        if a // 2 == b // 2 or c is None or d is None or tuple(map(int, self.at[a][:2])) != tuple(map(int, self.at[b][:2])):
            return None
        most, long_most = streets.VERTEX_BOUNDS[way]
        return c + 0.5 * d if c <= most and d <= long_most and c + 0.5 * d <= -1.1 else None

    def gap_score(self, a: int, b: int, way: str, whole: bool):
        if self.far[a] == b:
            return None
        cell = polylines.CELLS[way]
        step = tuple(math.floor(self.at[b][k] / cell) - math.floor(self.at[a][k] / cell) for k in (0, 1))
        near = {(0, 0), (1, 0), (0, 1), (1, 1), (-1, 0), (0, -1), (-1, -1)} | ({(-1, 1), (1, -1)} if whole else set())
        gx, gy = self.at[b][0] - self.at[a][0], self.at[b][1] - self.at[a][1]
        c, d = self.cosines(a, b)
        e, f = self.cosine(gx, gy, *self.at[a][2:]), self.cosine(-gx, -gy, *self.at[b][2:])
        if step not in near or None in (c, d, e, f):
            return None
        across, most = {"lines": (-0.95, 10.0), "extended streets": (0.5, 250.0)}[way]
        score = math.hypot(gx, gy) + c + 0.5 * d
        return score if c <= -0.95 and d <= -(3**0.5) / 2 and e <= across and f <= across and score <= most else None

    def take(self, pairs: list, gap: int) -> None:
        for _, a, b in pairs:
            self.edges.append((a // 2, b // 2))
            self.free -= {a, b}
            p, q = self.far[a], self.far[b]
            self.far[p], self.far[q] = q, p
            old, new = self.group[b // 2], self.group[a // 2]
            self.group = {k: new if g == old else g for k, g in self.group.items()}
            self.gaps[a // 2] += gap

    def scored(self, score) -> list:
        free = sorted(self.free)
        return sorted((s, a, b) for i, a in enumerate(free) for b in free[i + 1 :] if (s := score(a, b)) is not None)

    def run(self, way: str, passes: int, gap_way: str, whole: bool) -> set:
        for _ in range(passes):
            chosen, used = [], set()
            for s, a, b in self.scored(lambda a, b: self.vertex_score(a, b, way)):  # best first, a pass at a time
                if a not in used and b not in used:
                    used |= {a, b}
                    chosen.append((s, a, b))
            self.take(chosen, 0)
        while True:
            pairs = self.scored(lambda a, b: self.gap_score(a, b, gap_way, whole))
            best = {}
            for p in pairs:
                for e in p[1:]:
                    best.setdefault(e, p)
            chosen = [p for p in pairs if best[p[1]] == p == best[p[2]]]
            if not chosen:
                break
            # the pairs of a round are taken best first: the one that would close a ring is the worst of it
            for p in chosen:
                if self.far[p[1]] != p[2]:
                    self.take([p], 1)
        least = {}
        for k, g in self.group.items():
            least[g] = min(k, least.get(g, k))
        gaps = collections.Counter()
        for k, n in self.gaps.items():
            gaps[least[self.group[k]]] += n
        return {(k, least[g], gaps[least[g]]) for k, g in self.group.items()}


def random_lines(seed: int, n: int) -> list[tuple]:
    """Streets cut into pieces, some of which touch and some not quite, with some rings and some noise."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        x, y, turn = rnd.uniform(0, 120), rnd.uniform(0, 120), rnd.uniform(0, 7)
        bend = rnd.choice([0, 0, 0.25, 0.45])
        for _ in range(rnd.randint(1, 9)):
            size = rnd.uniform(4, 12)
            nx, ny = x + size * math.cos(turn), y + size * math.sin(turn)
            ends = [x, y, nx, ny]
            out.append((len(out), *(ends if rnd.random() < 0.5 else ends[2:] + ends[:2])))
            gap = rnd.choice([0, 0, 2, 5])
            x, y, turn = nx + gap * math.cos(turn), ny + gap * math.sin(turn), turn + rnd.uniform(-0.1, 0.1) + bend
    return out + [(len(out), 5.0, 5.0, 5.0, 5.0)]


@pytest.mark.parametrize(("seed", "way", "passes", "gap_way", "whole"), [(1, "lines", 2, "lines", False), (3, "extended streets", 1, "extended streets", True)])
def test_long_lines_equal_one_at_a_time(spark, seed, way, passes, gap_way, whole):
    lines = random_lines(seed, 20)
    df = spark.createDataFrame([(7, *x) for x in lines] + [(7, 5000, None, 1.0, 2.0, 3.0)], "map_id long, line_id long, x1 double, y1 double, x2 double, y2 double")
    found = polylines.merge_polylines(df, way, passes, gap_way, whole)
    got = {(r["line_id"], r["group_id"], r["gaps"]) for r in found.collect()}
    want = Map(lines).run(way, passes, gap_way, whole) | {(5000, 5000, 0)}
    assert got == want
    assert len({g for _, g, _ in want}) < len(want) - 8 and any(n for _, _, n in want)
    assert polylines.merge_polylines(df.limit(0)).count() == 0


@pytest.mark.parametrize(("query", "settings"), [(form_queries.polyline_merge, ("lines", 2, "lines", False)), (form_queries.polyline_streets, ("extended streets", 1, "extended streets", True))])
def test_long_line_queries(spark, query, settings):
    maps = collections.defaultdict(list)
    for r in form_queries._snapped(spark, SF).collect():
        maps[r["map_id"]].append(tuple(r)[1:])
    want = {(m, *x) for m, lines in maps.items() for x in Map(sorted(lines)).run(*settings)}
    assert {tuple(r) for r in query(spark, SF).select("map_id", "line_id", "group_id", "gaps").collect()} == want
