"""Filters in every order, tokens of two tokenizers side by side, and languages, each against a plain version."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, same
from tests.llm import cases
from vellumgrid.llm import alignment, filter_audit, language_id

SF = "/root/testdata/sf0.001"


# filter audit


def test_plain_changes_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for k in filter_audit.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def brute_audit(rows: list[tuple[str, set[str], int, int]], letters: str) -> set[tuple]:
    """rows: part, failed letters, good, toxic. Each order is gone through document by document."""
    out, sums = [], collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations(letters):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[part, f] += len(gone)
                fails = sum(f in r[1] for r in own)
                out.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
    return {(*r[:-1], sums[r[0], r[-1]]) for r in out}


def test_audit_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "", "é"]), {f for f in "PQRS" if rnd.random() < 0.4}, rnd.randint(0, 1), rnd.randint(0, 1)) for _ in range(300)]
    cells = spark.createDataFrame([(p, sum(1 << "PQRS".index(f) for f in failed), 1, g, t) for p, failed, g, t in rows], "part string, mask int, n long, good long, toxic long")
    assert {tuple(r) for r in filter_audit.audit(cells, "PQRS").collect()} == brute_audit(rows, "PQRS")
    assert filter_audit.audit(cells.limit(0), "PQRS").count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "PP")


def failures(rows: list[tuple]) -> list[tuple[str, set[str], int]]:
    """Source, failed letters and id of cases.rows()."""
    least: dict[str, int] = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    out = []
    for r in rows:
        text, words = r[1] or "", cases.words(r[1])
        failed = {
            k
            for k, x in {
                "A": len(words) < 50,
                "B": 100 * len(set(words)) < 65 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                "D": any(c in "#$%&*|" for c in text),
                "E": r[0] is not None and text in least and least[text] < r[0],
            }.items()
            if x
        }
        out.append((r[3] or "", failed, r[0]))
    return out


def audited(docs, labels):
    rules = filter_audit.contract_rules()
    return filter_audit.audit(filter_audit.failure_cells(docs.withColumn("words", filter_audit.words_of()), labels, rules, copies="E"), "ABCDE")


def test_audit_of_awkward_documents(spark):
    rows = cases.rows() + [(20, cases.rows()[0][1], "en", None, None, 0.1, "x", "y", False), (None, cases.rows()[0][1], "en", "", None, 0.1, "x", "y", False)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "x"), (2, 1, None, "y"), (None, 1, 1, "z"), (12, None, None, "t"), (20, 1, 1, "u")], "doc_id long, quality int, toxic int, text string")
    good, toxic = {1, 2, 20}, {2, 20}
    want = brute_audit([(p, failed, int(i in good), int(i in toxic)) for p, failed, i in failures(rows)], "ABCDE")
    assert {tuple(r) for r in audited(docs, labels).collect()} == want
    assert audited(cases.empty(spark), labels).count() == 0
    assert {tuple(r) for r in audited(docs, labels.limit(0)).collect()} == {(*r[:7], 0, 0, r[9]) for r in want}


def test_audit_query_equals_sql(spark):
    same(filter_audit.op11_filter_audit(spark, SF), connect(SF), filter_audit.OP11_SQL)


# alignment


@pytest.fixture(scope="module")
def encoders():
    return alignment._encoders(alignment.public_pair())


def brute_alignment(rows: list[tuple[int | None, str | None]], e: alignment.Encoders) -> list[tuple]:
    """Whole texts by both libraries, every link in a dictionary."""
    found, count = [], collections.Counter()
    for i, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = e.whole.encode(" " + text, add_special_tokens=False).ids, e.other.encode(text)
            own = (" " + text).encode()
            if b"".join(e.first[x] for x in a) != own or b"".join(e.second[x] for x in b) != own:
                a, b = [], []
        end_a, end_b = (list(itertools.accumulate(len(t[x]) for x in ids)) for ids, t in ((a, e.first), (b, e.second)))
        place = {x: k for k, x in enumerate(end_b)}
        from_a = from_b = 0
        for k, x in enumerate(end_a):
            if x in place:
                m = place[x]
                links.append((a[k], b[m]))
                groups.append(f"{','.join(map(str, a[from_a : k + 1]))}|{','.join(map(str, b[from_b : m + 1]))}")
                from_a, from_b = k + 1, m + 1
        count.update(links)
        found.append((i, len(a), len(b), links, groups))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""
    return [(i, a, b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha(";".join(groups))) for i, a, b, links, groups in found]


AWKWARD = ["", None, " ", "  lead", "tail ", "tail \n ", "a  b", "a \n b", "x\n\n y", "\n", "c▁d e", "c d▁", "<s> </s> <unk> <0x0A>", "<|endoftext|> 's it's", "zero\x00byte \x1c x", "é ü ñ ß", "日本語 テキスト 😀", "ünder score   wide", "᠎ x", "​ zero", "A" * 3000 + " end", "é combined", "ﬁ ligature Å", "7777 1234567 3.14", "don't we'll I'd"]


def test_alignment_equals_brute_force(spark, encoders):
    rows = [(r[0], r[1]) for r in cases.rows()] + list(enumerate(AWKWARD, 100)) + [(100, AWKWARD[3])]
    docs = spark.createDataFrame([(i, t, "k", 1, b"n", 2) for i, t in rows], "doc_id long, text string, key string, n_a int, n binary, count_sum int").repartition(3)
    found = alignment.align(docs, alignment.public_pair())
    assert cases.multiset(tuple(r) for r in found.collect()) == cases.multiset(brute_alignment(rows, encoders))
    assert alignment.align(cases.empty(spark), alignment.public_pair()).count() == 0


def test_alignment_query_equals_brute_force(spark, encoders):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert cases.multiset(tuple(r) for r in alignment.op12_alignment(spark, SF).collect()) == cases.multiset(brute_alignment(rows, encoders))


def test_long_texts_are_cut_where_pieces_end(spark, encoders, monkeypatch):
    rnd = random.Random(3)
    texts = [cases.prose(rnd, 200), cases.prose(rnd, 90) + "  \n  " + cases.prose(rnd, 90), "x" * 500, cases.prose(rnd, 100) + " ▁ " + cases.prose(rnd, 100), " " * 300 + "end "]
    monkeypatch.setattr(alignment, "CHUNK", 64)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    for text in texts:
        joined = " ".join(alignment.chunks_of(text, 64))
        assert joined == text
    tally = alignment.Tally(alignment.Pieces(encoders))
    for text in texts:
        tally.long(text)
    sent = tally.sent()
    want = collections.Counter()
    for text in texts:
        if "▁" in text:
            continue
        a, b = encoders.whole.encode(" " + text, add_special_tokens=False).ids, encoders.other.encode(text)
        place = {x: b[k] for k, x in enumerate(itertools.accumulate(len(encoders.second[x]) for x in b))}
        want.update(place[x] << 32 | a[k] for k, x in enumerate(itertools.accumulate(len(encoders.first[x]) for x in a)) if x in place)
    assert dict(zip(sent.column(0).to_pylist(), sent.column(1).to_pylist())) == want


def test_shards_are_sorted_and_summed(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 40) << 32 | rnd.randint(0, 50), rnd.randint(1, 9)) for _ in range(5000)]
    shards = alignment.write_shards(spark.createDataFrame(rows, "key long, n long").repartition(5))
    want = collections.Counter()
    for k, n in rows:
        want[k] += n
    keys = np.array(sorted(want), np.int64)
    count, best = alignment.Lookup(shards)(keys)
    assert count.tolist() == [want[k] for k in keys.tolist()]
    highest = {b: max(n for k, n in want.items() if k >> 32 == b) for b in range(41)}
    assert best.tolist() == [want[k] == highest[k >> 32] for k in keys.tolist()]
    assert (np.diff(shards.first) > 0).all() and shards.best.tolist() == [highest[b] for b in range(41)]


# languages


def test_codewords_are_far_apart():
    assert language_id.codewords(1).tolist() == [[1.0]]
    for n in (2, 3, 4, 7, 8, 9, 31, 100):
        code = language_id.codewords(n)
        assert len(code) == n and set(np.unique(code)) <= {-1.0, 1.0}
        apart = [(a != b).sum() for a, b in itertools.combinations(code, 2)]
        assert min(apart) >= code.shape[1] / 2 - 0.5
        assert (np.abs(code.sum(axis=0)) < n).all()  # no bit is the same for all


def test_grams_equal_plain_counting():
    text = "Où est-ce  l'É 42 ét? " * 3
    words = "".join(c if language_id.kinds()[ord(c)] else " " for c in text.lower()).split()
    spaced = "\x00" + "\x00".join(words) + "\x00"
    grams = [spaced[k : k + n] for n in range(1, 5) for k in range(len(spaced) - n + 1)]
    grams = [g for g in grams if "\x00" not in g[1:-1] and g != "\x00"]

    def bucket(gram: str) -> int:
        value = 0
        for n, c in enumerate(gram, 1):
            value = (value * 0x100000001B3 + ord(c) + n) % (1 << 64)
        return (value * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48

    want = collections.Counter(map(bucket, grams))
    at, value = language_id.count_grams(text)
    norm = math.sqrt(sum(want.values()))
    assert dict(zip(at.tolist(), value.round(9).tolist())) == {k: round(math.sqrt(n) / norm, 9) for k, n in want.items()}
    assert language_id.count_grams("42 ́ ...") is None and language_id.count_grams("") is None


def test_chunks_cut_between_words(monkeypatch):
    text = "ein Wort und noch eines " * 50
    whole = language_id.count_grams(text)
    monkeypatch.setattr(language_id, "chunks", lambda t, f=language_id.chunks: f(t, 40))
    parts = language_id.count_grams(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_gradient_equals_differences():
    rnd = np.random.default_rng(2)
    code = language_id.codewords(4)
    language, begin = np.array([0, 1, 2, 3, 1]), np.array([0, 3, 5, 9, 12])
    at, value = rnd.integers(0, 10, 15), rnd.random(15).astype(np.float32)
    share, x = np.full(4, 0.25), rnd.normal(size=(11, code.shape[1])).astype(np.float32)

    def loss(x: np.ndarray) -> float:
        m = np.add.reduceat(x[:-1][at] * value[:, None], begin, axis=0) + x[-1]
        return float((np.logaddexp(0, -m * code[language]) * share[language][:, None]).sum())

    g = language_id.gradient(language, begin, at, value, x, code, share)
    x = x.astype(np.float64)
    for k, b in [(0, 0), (3, 2), (9, 6), (10, 1), (10, 5)]:
        step = np.zeros_like(x)
        step[k, b] = 1e-5
        assert abs((loss(x + step) - loss(x - step)) / 2e-5 - g[k, b]) < 1e-4


def test_decoding_equals_plain_loops():
    rnd = np.random.default_rng(4)
    code = language_id.codewords(5)
    reliable = rnd.random(code.shape)
    c = language_id.Classifier(list("abcde"), code, None, None, reliable)
    margins = rnd.normal(size=(20, code.shape[1])) * 3
    first, score, second, near = c.decide(margins)
    for k, m in enumerate(margins):
        d = [sum(w * math.log1p(math.exp(-b * f)) for b, f, w in zip(word, m, r)) for word, r in zip(code, reliable)]
        order = sorted(range(5), key=lambda j: (d[j], j))
        assert (first[k], second[k]) == (order[0], order[1])
        assert math.isclose(score[k], 1 / sum(math.exp(-code.shape[1] * (x - d[order[0]])) for x in d), rel_tol=1e-9)
        assert near[k] == (d[order[1]] - d[order[0]] < language_id.AMBIGUITY * math.log(2))


def test_language_query_on_held_out_documents(spark):
    found = language_id.op13_language_id(spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")), "doc_id").collect()
    assert len(rows) == 200 and all(r["held_out"] == (r["c"] % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_language_of_awkward_documents(spark):
    rnd = random.Random(6)
    alphabets = {"xx": "abcdefg", "yy": "hijklmn", "zz": "opqrstu"}
    make = lambda k: " ".join("".join(rnd.choice(alphabets[k]) for _ in range(5)) for _ in range(30))
    rows = [(n, make(k), k, "c", 1.0) for n, k in enumerate(["xx", "yy", "zz"] * 20)]
    rows += [(None, make("xx"), "xx", "c", 1.0), (500, None, "xx", "c", 1.0), (501, "", None, "c", 1.0), (502, "12 . 3", "yy", "c", 1.0), (503, make("zz"), None, "c", 1.0), (503, make("zz"), None, "c", 1.0), (504, "áb" * 20000, None, "c", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    classifier = language_id.fit(docs, ~language_id.held_out("doc_id"), sample=15)
    found = language_id.predict(docs, classifier)
    assert sorted(found.columns) == sorted(["doc_id", "text", "lang", "lang_pred", "score", "runner_up", "ambiguous"])
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (500, 501, 502):
            assert (r["lang_pred"], r["score"], r["runner_up"], r["ambiguous"]) == ("und", 0.0, None, False)
        elif r["doc_id"] in (503, 504):
            assert r["lang_pred"] == {503: "zz", 504: "xx"}[r["doc_id"]]
        else:
            assert r["lang_pred"] == r["lang"]
    for nothing in (cases.empty(spark), docs.where("lang is null")):
        assert language_id.fit(nothing, F.lit(True)) is None
        assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'xx'"), F.lit(True))
    assert {(r["lang_pred"], r["runner_up"]) for r in language_id.predict(docs.where("doc_id < 20"), one).collect()} == {("xx", None)}
    with pytest.raises(ValueError):
        language_id.fit(docs, F.lit(True), most_languages=2)
    assert language_id.predict(cases.empty(spark), classifier).count() == 0
