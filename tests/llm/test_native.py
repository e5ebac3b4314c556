import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from vellumgrid.llm import mixing, quality, secret_scan

#: Base kinds, patterns, measured group, least length.
BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def base_spans(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, r, g, least) in enumerate(BASE) for m in r.finditer(text or "") if len(m[g]) >= least)


def test_secrets_equal_brute_force(spark):
    df = cases.docs(spark)
    got = secret_scan.scan(df).withColumn("s", secret_scan.joined(F.col("found"))).select("doc_id", "text", "s").collect()
    assert cases.multiset((r.doc_id, ",".join(x for x in r.s.split(",") if not x.startswith("random"))) for r in got) == cases.multiset((r[0], ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(r[1]))) for r in cases.rows())


def test_random_runs_are_found_and_words_are_not(spark):
    import random

    rnd = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(k, "key " + "".join(rnd.choice(letters) for _ in range(44)) + " end") for k in range(30)]
    rows += [(100 + k, "file " + "".join(rnd.choice(["alpha", "Beta", "user", "Version", "release", "note"]) for _ in range(7)) + "2024 x") for k in range(60)]
    rows += [(200, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaZ1"), (201, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), (202, None), (203, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(df).select("doc_id", F.size("found").alias("n"), secret_scan.redact(F.col("text"), F.col("found")).alias("t")).collect()}
    assert sum(got[k].n for k in range(30)) >= 25 and sum(r.n for k, r in got.items() if k >= 100) <= 1
    assert got[202].t is None and got[203].t == ""
    assert any(r.t == "key [SECRET] end" for k, r in got.items() if k < 30)


def test_overlapping_spans_are_masked_once(spark):
    df = spark.createDataFrame([(1, 'é token = "0123456789abcdef0123" x')], "doc_id long, text string")
    assert secret_scan.scan(df).select(secret_scan.redact(F.col("text"), F.col("found")).alias("t")).first().t == 'é [SECRET]" x'


def counts(text):
    w = cases.words(text)
    n = len(w)
    seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if cases.WORD.search(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_counts(spark):
    got = quality.judge(cases.docs(spark), quality.rules()).collect()
    assert cases.multiset((r[0], *r[1:7]) for r in got) == cases.multiset((r[0], *counts(r[1])) for r in cases.rows())
    assert all(not r.kept for r in got if r.base_failed)


def test_order_of_rules_changes_no_verdict(spark):
    df = cases.docs(spark)
    a, b = (quality.judge(df, rules).select("doc_id", "kept").collect() for rules in (quality.rules(), quality.rules()[::-1]))
    assert cases.multiset(a) == cases.multiset(b)
    found = quality.estimate(df)
    ratios = [-share / cost for _, cost, share in found]
    assert ratios == sorted(ratios) and {r.name for r, *_ in found} == {r.name for r in quality.rules()}


def test_slow_rules_go_last(spark):
    """Two rules that reject alike, one of which takes far longer, and a rule that rejects nothing."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fast = F.col("n_words") < 100
    slow = F.aggregate(F.sequence(F.lit(1), F.lit(3000)), F.lit(0).cast("long"), lambda a, x: a + F.pmod(x * F.col("n_words"), F.lit(7))) < 0
    for _ in range(3):
        order = [r.name for r, *_ in quality.estimate(df, [quality.Rule("a_slow", fast | slow), quality.Rule("b_slow_and_idle", slow), quality.Rule("c_fast", fast), quality.Rule("d_idle", F.lit(False))])]
        assert order == ["c_fast", "a_slow", "d_idle", "b_slow_and_idle"]


def targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing_meets_targets(spark):
    df = cases.docs(spark)
    got = mixing.mix(df).collect()
    assert len(got) == len(cases.rows())
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) < 1 + 1e-6
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert cases.multiset(mixing.mix(df.repartition(3)).collect()) == cases.multiset(got)


def test_empty_tables(spark):
    df = cases.empty(spark)
    assert secret_scan.scan(df).count() == 0 and quality.judge(df).count() == 0 and mixing.mix(df).count() == 0


def test_digest_of_no_span(spark):
    assert secret_scan.scan(cases.docs(spark)).where("doc_id = 4").select(F.sha2(secret_scan.joined(F.col("found")).cast("binary"), 256)).first()[0] == hashlib.sha256(b"").hexdigest()
