import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from vellumgrid.llm import html_text, language_model, toxicity
from vellumgrid.llm.common import bucket_of


def held(i, modulus, rest):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == rest


def test_base_score_is_exact(spark):
    rows = cases.rows()
    s = language_model.Settings(frequent=40, rounds=2, symbols=256, inner_rows=256)
    got = language_model.score_documents(cases.docs(spark), bucket_of("doc_id", 7) == 2, s).collect()
    c = Counter()
    toks = lambda t: cases.words(cases.lowered(t)) + ["\n"]
    for r in rows:
        if not held(r[0], 7, 2):
            c.update(toks(r[1]))
    n, v = sum(c.values()), len(c)
    want = [(r[0], held(r[0], 7, 2), len(toks(r[1])), sum(c[w] > 0 for w in toks(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(r[1])), 5)) for r in rows]
    assert cases.multiset((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == cases.multiset(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_learns_order(spark):
    """Where each word follows from the one before, the model beats the frequencies on documents it hasn't seen."""
    rnd = random.Random(4)
    ring = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(400):
        at = rnd.randrange(40)
        rows.append((k, " ".join(ring[(at + j) % 40] for j in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = language_model.score_documents(df, bucket_of("doc_id", 7) == 2, language_model.Settings(batch=512)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_distributions_sum_to_one():
    s = language_model.Settings(head_classes=3, class_words=4, spelling_classes=2, symbols=64, inner_rows=64)
    m = language_model.Model.started(np.arange(1, 13, dtype=float), np.ones(2), s)
    rnd = np.random.default_rng(0)
    m.outer += rnd.normal(size=m.outer.shape).astype(np.float32)
    m.inner += rnd.normal(size=m.inner.shape).astype(np.float32)
    features = np.array([[5], [70], [150]])
    total = sum(np.exp(m.predict(features, np.array([r // 4]), np.array([r]))[0][0]) for r in range(12))
    total += sum(np.exp(m.predict(features, np.array([c]), np.array([0]))[0][0]) for c in (3, 4))
    assert total == pytest.approx(1, abs=1e-5)


def test_gradient_equals_differences(monkeypatch):
    s = language_model.Settings(head_classes=2, class_words=3, spelling_classes=2, symbols=8, inner_rows=16)
    m = language_model.Model.started(np.arange(1, 7, dtype=float), np.ones(2), s)
    rnd = np.random.default_rng(2)
    m.outer[:] = rnd.normal(size=m.outer.shape)
    m.inner[:] = rnd.normal(size=m.inner.shape)
    m.outer, m.inner, m.bias, m.inner_bias = (x.astype(np.float64) for x in (m.outer, m.inner, m.bias, m.inner_bias))
    features = np.stack([rnd.integers(0, 8, 40), 8 + rnd.integers(0, 8, 40), 16 + rnd.integers(0, 16, 40)])
    cls = rnd.integers(0, 4, 40)
    rank = np.where(cls < 2, cls * 3 + rnd.integers(0, 3, 40), language_model.Lexicon.NONE)
    found = {id(m.outer): np.zeros(m.outer.shape), id(m.inner): np.zeros(m.inner.shape)}
    monkeypatch.setattr(language_model, "_step", lambda weights, sums, met, row, gradient, rate: np.add.at(found[id(weights)], row, gradient))
    m.learn(features, cls, rank, (None, None))
    loss = lambda: -m.predict(features, cls, rank)[0].sum()
    for weights in (m.outer, m.inner):
        for at in np.ndindex(*weights.shape):
            old = weights[at]
            weights[at] = old + 1e-5
            high = loss()
            weights[at] = old - 1e-5
            low = loss()
            weights[at] = old
            assert found[id(weights)][at] == pytest.approx((high - low) / 2e-5, abs=1e-5)


def test_held_out_documents_beat_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = language_model.score_documents(docs.repartition(4, "doc_id"), bucket_of("doc_id", 7) == 2).where("held_out").collect()
    assert sum(r.score > r.base_score for r in got) >= 0.9 * len(got)
    assert sum(r.score for r in got) > 0.97 * sum(r.base_score for r in got)


def test_no_documents(spark):
    assert language_model.score_documents(cases.empty(spark), F.lit(False), language_model.Settings(rounds=1)).count() == 0


def test_marginals_equal_enumeration():
    import itertools

    rnd = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(1), 0, 0, np.array([-1.0, 0.5, 0.3]), 0.2)
    u, count = rnd.normal(size=9), np.array([4, 0, 5])
    p, _, pair = toxicity.forward_backward(u, count, field)
    for a, b in ((0, 4), (4, 9)):
        z, sums = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            s = sum(i * x for i, x in zip(y, u[a:b])) + field.start * y[0] + sum([[0, field.pairs[0]], [field.pairs[1], field.pairs[2]]][i][j] for i, j in zip(y, y[1:]))
            z += math.exp(s)
            sums += math.exp(s) * np.array(y)
        assert np.allclose(p[a:b], sums / z)
    assert np.allclose(pair.sum(axis=(0, 1))[[1, 2, 3, 5, 6, 7, 8]], 1)


def test_long_chain_equals_steps():
    rnd = np.random.default_rng(2)
    m = rnd.random((2, 2, 5000)) + 0.01
    v = np.array([0.3, 0.7])
    found = toxicity._scan(m, (0.3, 0.7))
    for t in range(5000):
        v = v @ m[:, :, t]
        v /= v.sum()
    assert np.allclose(found[:, -1], v)


def test_gradient_of_the_field_equals_differences():
    """The likelihood by forward-backward normalisers against its gradient."""
    rnd = np.random.default_rng(3)
    field = toxicity.Field(rnd.normal(size=6), 0.3, -0.5, rnd.normal(size=3), 0.2)
    rows, toxic = [(5, [1, 2], [(1, 4), (2,)]), (0, [], []), (4, [0, 3], [(3, 5), (1,)])], [1, 0, 0]

    def likelihood(x):
        import itertools

        f = toxicity.Field(x[:6], x[6], x[7], x[8:11], x[11])
        count, at, found = toxicity._joined(rows)
        u = f.scores(count, at, found)
        total, begin = 0.0, 0
        for (n, a, _), bad in zip(rows, toxic):
            mine, labels = u[begin : begin + n], [int(bad and k in a) for k in range(n)]
            begin += n
            value = lambda y: sum(i * v for i, v in zip(y, mine)) + (f.start * y[0] if n else 0) + sum([[0, f.pairs[0]], [f.pairs[1], f.pairs[2]]][i][j] for i, j in zip(y, y[1:]))
            total += value(labels) - math.log(sum(math.exp(value(y)) for y in itertools.product((0, 1), repeat=n)))
        return total

    x = np.concatenate([field.weights, [field.side, field.bias], field.pairs, [field.start]])
    step = 1e-5 * np.eye(len(x))
    want = [(likelihood(x + e) - likelihood(x - e)) / 2e-5 for e in step]
    assert np.allclose(toxicity._gradient(rows, toxic, field)[:-1], want, atol=1e-6)


def test_context_tells_uses_of_a_word_apart(spark):
    """The same word after `you` is toxic, after `the` it isn't; both kinds of documents hold it."""
    rnd = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        w = cases.prose(rnd, rnd.randint(8, 40)).split()
        toxic = k % 3 == 0
        for _ in range(2):
            w[rnd.randrange(1, len(w) - 1) : 0] = []
            at = rnd.randrange(len(w))
            w[at:at] = ["you" if toxic else "the", "rotten"] if toxic or rnd.random() < 0.15 else []
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    scorer = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.trains)
    probe = spark.createDataFrame([(k, f"{rows[3 * k + 1][1]} {'you' if k % 2 else 'the'} rotten one") for k in range(200) if "rotten" not in rows[3 * k + 1][1]], "doc_id long, text string")
    got = [(r.doc_id % 2, r.score) for r in toxicity.score(probe, scorer).collect()]
    mean = lambda x: sum(s for k, s in got if k == x) / sum(k == x for k, _ in got)
    assert mean(1) > mean(0) + 0.3


def test_long_words_have_features():
    assert toxicity.features_of(b"x" * 5000)[0] == b"w" + b"x" * 5000


def labelled(spark):
    rnd = random.Random(8)
    bad, rows, labels = ["vile", "rotten", "scoundrel"], [], []
    for k in range(600):
        w = cases.prose(rnd, rnd.randint(5, 60)).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad) + rnd.choice(["", ",", "!"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxic_documents_and_spans(spark):
    docs, labels, truth = labelled(spark)
    scorer = toxicity.fit(docs, labels, toxicity.trains)
    got = toxicity.score(docs, scorer).collect()
    wrong = [r.doc_id for r in got if held(r.doc_id, 5, 0) and (r.score >= 0.5) != bool(truth[r.doc_id])]
    assert len(wrong) <= 2 and all(0 <= r.score <= 1 for r in got)
    spans = [r.text[s.start : s.end].strip(",!") for r in got if truth[r.doc_id] for s in r.spans]
    assert spans and sum(set(s.replace(",", "").replace("!", "").split()) <= {"vile", "rotten", "scoundrel"} for s in spans) / len(spans) > 0.95
    extra = toxicity.score(cases.docs(spark), scorer)
    assert extra.count() == len(cases.rows()) and extra.columns.count("score") == 1


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(cases.docs(spark), none, toxicity.trains) is None
    assert {r.score for r in toxicity.score(cases.docs(spark), None).collect()} == {0.0}
    assert toxicity.score(cases.empty(spark), None).count() == 0


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a>menu one</a></nav><article><h1>Head &amp; line</h1><p>one  two\n three<p>four<br>five</article><footer>foot words</footer></body></html>", "Head & line\none two three\nfour five"),
    ("<body><header>Site</header><div id='cookie-notice'>We use cookies here</div><div class=content><p>a b c d e f</p><p>g <i>h</i>i</p></div><aside>side</aside><section class=\"comments\"><p>bad reader</p></section></body>", "a b c d e f\ng hi"),
    ("<article><p>x y z</p><form><input><label>mail</label></form><div class='ad'>buy</div><p>u v w</p></article>", "x y z\nu v w"),
    ("<article><p>1 &lt; 2 &#233; &nbsp; a<b></p><script>var t='</p>';</script><p>end</p></article>", "1 < 2 é a\nend"),
    ("<!-- c --><p>only text", "only text"),
    ("", ""),
    (None, ""),
]


def test_main_text(spark):
    df = spark.createDataFrame([(k, "u", h, "clash") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, main_text string")
    got = {r.page_id: r.main_text for r in html_text.main_text(df).collect()}
    assert got == {k: t for k, (_, t) in enumerate(PAGES)}
    assert html_text.main_text(df.limit(0)).count() == 0


def test_weights_keep_their_sign():
    w = html_text.Weights(html_text.table_of({html_text.bucket("<p>"): (1000, 1), html_text.bucket("p p"): (1, 1000)}))
    assert w.of_kind("<p>") < 0 < w.of_kind("p p")


def test_softmax_of_rows_near_and_far_apart():
    """One shift for all rows gives what a maximum of each row gives, also where rows lie so far apart that it would lose some."""
    import numpy as np

    from vellumgrid.llm import language_model as lm

    rnd = np.random.default_rng(7)
    for spread in (0, 1, 30, 79, 200, 1e4):
        z = (rnd.random((50, 20)) + spread * rnd.random((50, 1))).astype(np.float32)
        want = np.exp(z.astype(float) - z.max(axis=1, keepdims=True))
        want /= want.sum(axis=1, keepdims=True)
        lm._softmax(z)
        assert np.allclose(z, want, rtol=2e-3 if spread > 1e3 else 1e-4) and np.allclose(z.sum(axis=1), 1, atol=1e-5)
    lm._softmax(np.zeros((0, 20), np.float32))
