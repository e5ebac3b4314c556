"""The randomness battery against plain Python, its recall by encoding and length, and very long texts."""

import math
import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from vellumgrid.llm import secret_scan as ss


def tail(z):
    x = abs(z)
    upper = math.exp(-x * x / 2) / (math.sqrt(2 * math.pi) * (0.661 * x + 0.339 * math.sqrt(x * x + 5.51)))
    return upper if z >= 0 else 1 - upper


def kind(c):
    return "U" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else "-"


def p_of(core):
    for _, pattern, alphabet, agree, change in ss.ENCODINGS:
        if re.search(pattern, core):
            break
    else:
        return 1.0
    n, k = len(core), len(alphabet)
    codes = [alphabet.index(c) for c in core]
    chi = sum((codes.count(j) - n / k) ** 2 / (n / k) for j in range(k)) - (k - 1)
    shares = [sum(kind(c) == x for c in alphabet) / k for x in "Ul0-"]
    q = 1 - sum(s * s for s in shares)
    changes = len(list(groupby(map(kind, core)))) - 1
    mean = sum(codes) / n
    variance = max(sum((c - mean) ** 2 for c in codes), 1e-9)
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / variance * math.sqrt(n)
    runs = (changes - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q))
    if tail(chi / math.sqrt(2 * (k - 1))) < 0.001 or 2 * tail(abs(runs)) < 0.001 or 2 * tail(abs(serial)) < 0.001:
        return 1.0
    shift = n * (k * agree - 1)
    p = tail((shift - chi) / math.sqrt(2 * (k - 1) + 4 * shift)) * tail((changes - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
    p = max(p, 1e-45)
    return p * (1 - math.log(p))


def runs_of(text):
    """(start, end, length class, p) of the key-like runs that reach past base spans which begin no later."""
    base = [m.span() for _, pattern, group, least in ss.BASE for m in re.finditer(pattern.replace("((?i:", "((?i:"), text) if len(m[group]) >= least]
    out = []
    for m in re.finditer(ss.CANDIDATE, text):
        if re.search(r"[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) or re.search("[a-z][A-Z]", m[0]):
            if all(b > m.start() or e < m.end() for b, e in base):
                core = re.sub(ss.PREFIX, "", m[0]).rstrip("=")
                out.append((*m.span(), max(k for k, low in enumerate(ss.LENGTHS) if len(core) >= low), p_of(core)))
    return out


def planted(seed):
    rnd = random.Random(seed)
    alphabets = [a for _, _, a, *_ in ss.ENCODINGS]
    words = "alpha Beta user Version release note Client server index cache".split()
    made = []
    for k in range(160):
        parts = [rnd.choice(["é see", "日本", "token=", "x", "sk_live_"])]
        for _ in range(rnd.randint(0, 3)):
            parts.append("".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randint(12, 60))) if rnd.random() < 0.2 else "".join(rnd.choice(a) for a in [rnd.choice(alphabets)] for _ in range(rnd.randint(12, 60))))
            parts.append(rnd.choice(["_", "/", "-", ""]).join(rnd.choice(words) for _ in range(rnd.randint(2, 6))) + rnd.choice(["", "7", "=="]))
        made.append((k, rnd.choice([" ", "", "\n"]).join(parts)))
    return made


@pytest.mark.parametrize("seed", range(2))
def test_battery_and_control_equal_brute_force(spark, seed):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ss._with_candidates(df.withColumn("body", F.col("text"))).select("doc_id", "runs").collect()
    want = {k: runs_of(t) for k, t in rows}
    for r in got:
        assert [tuple(x)[:3] for x in r.runs] == [x[:3] for x in want[r.doc_id]]
        assert [x.p for x in r.runs] == pytest.approx([x[3] for x in want[r.doc_id]], rel=1e-6)
    bin_of = lambda p: min(int(-math.log10(max(p, 1e-40)) * ss.BINS), ss.BINS * ss.DECADES)
    taken = set()
    for size in range(len(ss.LENGTHS)):
        family = sorted((-bin_of(x[3]), k, x) for k, found in want.items() for x in found if x[2] == size)
        last = max((j for j, (b, *_) in enumerate(family, 1) if 10 ** (b / ss.BINS) * len(family) <= ss.DISCOVERY_RATE * j), default=0)
        level = family[last - 1][0] if last else None
        taken |= {(k, x[0], x[1]) for b, k, x in family if last and b <= level}
    found = {(r.doc_id, s.start, s.end) for r in ss.scan(df).select("doc_id", "found").collect() for s in r.found if s.kind == ss.RANDOM}
    assert found == taken and len(taken) > 50


def test_recall_by_encoding_and_length(spark):
    """Nine of ten from 24 characters on, four of five at 20; names of code and paths stay."""
    rnd = random.Random(1)
    rows, truth = [], {}
    for name, _, alphabet, *_ in ss.ENCODINGS[1:]:
        for n in (20, 24, 32, 40):
            for _ in range(40):
                truth[len(rows)] = (name, n)
                rows.append((len(rows), "key " + "".join(rnd.choice(alphabet) for _ in range(n)) + " end"))
    words = "alpha beta user version release note document history config server client build index cache error handler".split()
    for k in range(1500):
        w = [rnd.choice(words) for _ in range(rnd.randint(3, 7))]
        name = ["_".join(w) + "2024", "".join(x.title() for x in w), "/".join(w) + "/v7", "-".join(w) + "-2024-01-11"][k % 4]
        rows.append((len(rows), f"see {name} here"))
    got = {r.doc_id: r.n for r in ss.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", F.expr("size(filter(found, x -> x.kind = 'random'))").alias("n")).collect()}
    share = {}
    for k, key in truth.items():
        share.setdefault(key, []).append(got[k] > 0)
    assert all(sum(v) / len(v) >= (0.85 if n > 20 else 0.75) for (_, n), v in share.items()), share
    late = [x for (_, n), v in share.items() if n >= 24 for x in v]
    assert sum(late) / len(late) >= 0.9
    assert sum(n > 0 for k, n in got.items() if k not in truth) <= 0.02 * sum(n > 0 for n in got.values())


def test_prefixed_keys_are_masked_whole(spark):
    rnd = random.Random(2)
    keys = ["sk_live_" + "".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame([(k, f"use {x} now") for k, x in enumerate(keys)], "doc_id long, text string")
    texts = [r.t for r in ss.scan(df).select(ss.redact(F.col("text"), F.col("found")).alias("t")).collect()]
    assert sum(t == "use [SECRET] now" for t in texts) >= 25 and all("[SECRET] now" in t for t in texts)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "Z" * 1_000_000, "aB3" * 330_000, " ".join(f"{k * 0x9E3779B97F4A7C15 % 2**64:016x}" for k in range(1, 50_000))])
def test_very_long_texts(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = ss.scan(df).select(ss.joined(F.col("found")).alias("s"), ss.redact(F.col("text"), F.col("found")).alias("t")).first()
    spans = [m.span() for m in re.finditer("[0-9a-f]{16,}", text)]
    assert r.s == ",".join(f"hex:{a}:{b}" for a, b in spans)
    assert r.t == re.sub("[0-9a-f]{16,}", "[SECRET]", text)


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a token=abcdefabcdef0123 b", "own", "own", "own", 3, "own")], "doc_id long, text string, base string, runs string, body string, row int, `a.b` string")
    r = ss.scan(df).first()
    assert (r.base, r.runs, r.body, r.row, r["a.b"]) == ("own", "own", "own", 3, "own") and [s.kind for s in r.found] == ["assign", "hex"]
