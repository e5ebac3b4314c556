"""Queries that SQL doesn't express, against plain Python on the whole small tables."""

import itertools
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vellumgrid.operators import streets, text
from vellumgrid.plans import catalogue
from vellumgrid.plans import fixtures as fx

FOLDER = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER).collect()


def chains(spark):
    found = defaultdict(list)
    for e in sorted(fx.table(spark, FOLDER, "events").select("user_id", "event_id", "value").collect(), key=lambda e: e.event_id):
        found[e.user_id * 1_000_000 + e.event_id // 20_000].append((e.event_id / 20.0, e.value % 40))
    return found


def test_split_lines_are_within_the_tolerance(spark):
    """Lines of a chain follow each other from end to end; each is short or has its points within the tolerance, and none could be left whole."""
    points, lines = chains(spark), defaultdict(list)
    for r in rows(spark, "q_chain_split"):
        lines[r.chain_id].append((r.first, r.last))
        assert (r.x1, r.y1, r.x2, r.y2) == pytest.approx((*points[r.chain_id][r.first], *points[r.chain_id][r.last]))
    assert set(lines) == set(points)

    def spread(p):
        (ax, ay), (bx, by) = p[0], p[-1]
        n = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        u = ((bx - ax) / n, (by - ay) / n) if n else (1.0, 0.0)
        off = [(y - ay) * u[0] - (x - ax) * u[1] for x, y in p]
        return max(off) - min(off)

    for k, parts in lines.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == len(points[k]) - 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(b - a < 3 or spread(points[k][a : b + 1]) <= 6.0 + 1e-9 for a, b in parts)
        assert len(parts) == 1 or spread(points[k]) > 6.0


def test_seams_have_the_least_energy(spark):
    cells = defaultdict(set)
    for r in fx.cells(spark, FOLDER).where(fx.THICK).collect():
        cells[r.kind].add((r.r, r.c))
    path = defaultdict(dict)
    for r in rows(spark, "q_seam"):
        path[r.street_id][r.c] = r.r
    assert len(path) >= len(cells) > 0
    for img, p in path.items():
        best = {r: float((r, 0) in cells[img]) for r in range(48)}
        for c in range(1, 48):
            best = {r: min(best[q] + 0.1 * (q != r) for q in (r - 1, r, r + 1) if q in best) + ((r, c) in cells[img]) for r in range(48)}
        assert sorted(p) == list(range(48)) and all(abs(p[c] - p[c - 1]) <= 1 for c in range(1, 48))
        assert sum(((p[c], c) in cells[img]) for c in p) + 0.1 * sum(p[c] != p[c - 1] for c in range(1, 48)) == pytest.approx(min(best.values()))


def test_vertex_matches_are_greedy(spark):
    pairs = defaultdict(list)
    lines = fx.lines(spark, FOLDER).select("line_id", *(F.round(F.col(c) / 40).alias(c) for c in ("x1", "y1", "x2", "y2")))
    for r in streets.vertex_pairs(lines).collect():
        pairs[r.vx * 1_000_000 + r.vy].append((r.score, r.a, r.b))
    want = set()
    for vertex, found in pairs.items():
        used = set()
        for _, a, b in sorted(found):
            if not used & {a, b}:
                used |= {a, b}
                want.add((vertex, a, b))
    assert {tuple(r) for r in rows(spark, "q_vertex_match")} == want and want


def test_decoded_words_are_the_best_paths(spark):
    """All ways through the candidates of an image, by a search from each end that a letter can follow."""
    import json

    c = defaultdict(list)
    for e in fx.table(spark, FOLDER, "events").select("user_id", "event_id", "props").collect():
        x1, w, letter = json.loads(e.props)["k"] % 25 * 4, e.event_id % 9 * 4 + 8, chr(65 + e.event_id % 26)
        if not (w > 48 and letter not in "MW" or w > 16 and letter == "I"):
            c[e.user_id * 1_000_000 + e.event_id // 20_000].append((x1, x1 + w, (e.event_id % 97 + 1) / 98.0))
    got = {r.image_id: r.confidence for r in rows(spark, "q_decode_words")}
    for image, found in c.items():
        best = {}
        for x1, x2, p in sorted(found, key=lambda x: (x[1], x[0])):
            before = 1.0 if x1 == 0 else max((best[x] for x in range(max(0, x1 - 8), x1) if x in best), default=None)
            if before is not None:
                best[x2] = max(best.get(x2, 0.0), p * before)
        assert got[image] == pytest.approx(best.get(140, -1.0))


def test_tallies_follow_from_least_alignments(spark):
    """Each alignment spells both words at the price of their edit distance; the query counts its steps."""
    from vellumgrid.plans.text_queries import _pairs

    pairs = _pairs(spark, FOLDER).collect()
    seen = Counter()
    for r in pairs:
        cost, steps = text.align(r.observed or "", r.intended or "")
        a, b = r.observed or "", r.intended or ""
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
        assert cost == row[-1] and "".join(o for o, _ in steps if o != text.EMPTY) == a and "".join(i for _, i in steps if i != text.EMPTY) == b
        seen.update(steps)
    assert {(r.o, r.i): r.n for r in rows(spark, "q_align_tally")} == dict(seen)
    total = Counter()
    for (_, i), n in seen.items():
        total[i] += n
    sums = Counter()
    for r in rows(spark, "q_cost_model"):
        sums[r.i] += r.p
    assert all(s == pytest.approx(1) for s in sums.values()) and set(sums) == set(total)


def test_chains_cover_the_skeleton(spark):
    """Neighbours follow each other on a chain, each cell is on one, and the skeleton is what thinning leaves."""
    cells, on = defaultdict(set), defaultdict(set)
    for r in rows(spark, "q_skeleton"):
        cells[r.img].add((r.r, r.c))
    by_chain = defaultdict(list)
    for r in rows(spark, "q_skeleton_chains"):
        by_chain[r.img, r.chain_id].append((r.pos, r.r, r.c))
        on[r.img].add((r.r, r.c))
    assert on == cells
    for p in by_chain.values():
        p.sort()
        assert all(max(abs(a[1] - b[1]), abs(a[2] - b[2])) == 1 for a, b in zip(p, p[1:]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_reruns_agree(spark, name):
    a, b = (sorted(map(repr, rows(spark, name))) for _ in range(2))
    assert a == b and a
