import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages_on_awkward_rows(spark):
    docs = cases.docs(spark).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == COLUMNS
    assert corpus_pipeline.encoded(spark, docs, FOLDER).count() == docs.count() > 0


def test_empty_documents(spark):
    docs = cases.empty(spark).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_mixed_gives_the_words_of_the_mix(spark):
    from vellumgrid.llm import mixing

    docs = cases.docs(spark).select(*COLUMNS).dropDuplicates(["doc_id"])
    got = corpus_pipeline.mixed(spark, docs, FOLDER).select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    want = {r.doc_id: r.taken for r in mixing.mix(docs).where("taken > 0").collect()}
    assert {r.doc_id: r.n for r in got} == want


def test_secrets_are_gone(spark):
    docs = cases.docs(spark).select(*COLUMNS).where("doc_id = 14")
    text = corpus_pipeline.secrets_masked(spark, docs, FOLDER).first().text
    assert "AKIA" not in text and "0123456789abcdef" not in text and "'short'" in text


def test_whole_pipeline(spark):
    df = corpus_pipeline.run(spark, FOLDER)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and df.count() > 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (cases.words(cases.lowered(t)) for t in (a, b)))
    return len(x & y) / len(x | y)


def test_near_duplicates_equal_brute_force(spark):
    """Copies with a similarity from under 0.8 to 0.95; links join over a third text."""
    rnd = random.Random(3)
    texts = []
    for _ in range(12):
        base = cases.prose(rnd, 200).split()
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5, 6):
            copy = list(base)
            for at in rnd.sample(range(5, 195), edits):
                copy[at] = f"edit{at}"
            texts.append(" ".join(copy))
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    near = [(a, b, j) for a in range(len(texts)) for b in range(a) if (j := jaccard(texts[a], texts[b])) >= 0.8]
    assert sum(j < 0.85 for *_, j in near) > 10 and sum(j > 0.9 for *_, j in near) > 10
    for a, b, _ in near:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates_out(spark, docs, FOLDER).collect()]
    assert sorted(got) == sorted({find(k) for k in range(len(texts))})


def test_near_duplicates_cross_the_ends_of_a_bucket():
    """Two sets that differ in 11 of 100 shingles have a similarity just above 0.8, 12 just under it."""
    import numpy as np

    from vellumgrid.llm import near_copies

    a = np.arange(100, dtype="<u8")
    assert near_copies.similarity(a.tobytes(), (a + 11).tobytes()) == 89 / 111 >= 0.8 > near_copies.similarity(a.tobytes(), (a + 12).tobytes())


def test_near_duplicates_keep_rows_of_repeated_and_missing_ids(spark):
    rnd = random.Random(4)
    a, b, c, d, e = (cases.prose(rnd, 40) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (0, d + " more"), (None, e), (7, e), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates_out(spark, docs, FOLDER).select("doc_id", "text").collect()
    assert cases.multiset(map(tuple, got)) == cases.multiset([(None, a), (None, b), (1, c), (0, d + " more"), (7, e), (None, "")])


def test_sketches_rule_out_no_pair_that_reaches_the_similarity(spark):
    """Pairs from 0.3 to 1 of sets of 1 to 3,000 hashes: a bound that is exact, and that tells half-alike texts apart."""
    import numpy as np

    from vellumgrid.llm import near_copies

    rnd = np.random.default_rng(5)
    rows = []
    for n in (1, 2, 9, 100, 150, 600, 3000):
        for share in np.linspace(0.3, 1, 29):
            x = rnd.integers(0, (1 << 64) - 1, n, np.uint64)
            y = x.copy()
            other = n - round(n * 2 * share / (1 + share))
            y[:other] = rnd.integers(0, (1 << 64) - 1, other, np.uint64)
            a, b = np.unique(x), np.unique(y)
            j = near_copies.similarity(a.tobytes(), b.tobytes())
            rows.append((n, j, len(a), len(b), near_copies.sketch(a).tolist(), near_copies.sketch(b).tolist()))
    pairs = spark.createDataFrame(rows, "size int, j double, n int, m int, x array<long>, y array<long>")
    got = pairs.withColumn("may", near_copies.may_reach(F.col("x"), F.col("y"), F.col("n"), F.col("m"), 0.8)).collect()
    assert all(r.may for r in got if r.j >= 0.8) and sum(r.j >= 0.8 for r in got) > 50
    assert not any(r.may for r in got if 100 <= r.size <= 600 and r.j < 0.65)


def test_half_alike_texts_do_not_make_all_their_pairs(spark, monkeypatch):
    """120 texts with the passages of one, none of them linked: their pairs meet bounds before anything is written or read again."""
    from vellumgrid.llm import near_copies

    made, write = {}, near_copies.write_table

    def counted(df, name):
        written = write(df, name)
        made[name] = made.get(name, 0) + written.count() if name in ("tried", "rest") else 0
        return written

    monkeypatch.setattr(near_copies, "write_table", counted)
    rnd = random.Random(6)
    base, texts = cases.prose(rnd, 150).split(), []
    for k in range(120):
        copy = list(base)
        for at in rnd.sample(range(5, 145), 7):
            copy[at] = f"edit{k}x{at}"
        texts.append(" ".join(copy))
    assert max(jaccard(a, b) for a, b in zip(texts, texts[1:])) < 0.8
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert near_copies.one_of_each(docs).count() == 120
    assert made["tried"] + made["rest"] < 120
