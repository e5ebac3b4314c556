import hashlib
import random

import pytest
import xxhash

from tests.llm import cases
from vellumgrid.llm import simhash, substrings


def fingerprint(text):
    w = cases.words(cases.lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: dict):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for f, ids in fps.items():
        known = [i for i in ids if i is not None]
        if known:
            least[find(f)] = min(least.get(find(f), known[0]), *known)
    return {f: least.get(find(f)) for f in fps}


def test_near_duplicates(spark):
    rows = cases.rows()
    fps = {}
    for r in rows:
        fps.setdefault(fingerprint(r[1]), []).append(r[0])
    want = components(fps)
    got = simhash.near_duplicates(cases.docs(spark)).collect()
    assert cases.multiset(tuple(r) for r in got) == cases.multiset((r[0], f"{fingerprint(r[1]):016x}", want[fingerprint(r[1])]) for r in rows)


def test_links_equal_brute_force(spark):
    rnd = random.Random(1)
    fps = set()
    for _ in range(60):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {(r.u, r.v) for r in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a & mask) ^ (b & mask)).bit_count() <= 4}


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert substrings.remove_repeats(cases.empty(spark)).count() == 0


def removed(rows):
    first = {}
    order = sorted({(i if i is not None else float("-inf"), t) for i, t in rows}, key=lambda x: x[0])
    for i, t in order:
        w = cases.words(t)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, t in rows:
        w = cases.words(t)
        me = i if i is not None else float("-inf")
        gone = {j for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (me, s) for j in range(s, s + 20)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def test_substrings(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    got = substrings.remove_repeats(cases.docs(spark)).collect()
    assert cases.multiset(tuple(r) for r in got) == cases.multiset(removed(rows))


@pytest.mark.parametrize("seed", range(2))
def test_substrings_of_few_words(spark, seed):
    """Few words make many repeats that overlap, within and across documents."""
    rnd = random.Random(seed)
    parts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(5, 40))) for _ in range(5)]
    rows = [(k, "\n".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6)))) for k in range(40)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert cases.multiset(tuple(r) for r in got) == cases.multiset(removed(rows))
