"""Toxic spans by a linear-chain conditional random field, and documents scored by its marginals.

Labels mark whole documents, so token labels come first. On a bounded sample of labelled training documents, the features of
a token (its word and its beginnings) are counted by document in each class; those with a strong and significant excess
in toxic documents are kept, and in toxic documents the tokens that have one are labelled toxic. A field with two states is
fitted to these labels by distributed gradients. Its features are the kept ones, whether a neighbour has one, and what the labelling
doesn't use: which words stand right before and after a token with a kept feature (hashed) and how far into the text it stands.
So the same word can be toxic in one place and not in another.
Forward-backward marginals then give a probability for each token. A document is scored from their sum and maximum by
a logistic function fitted on the same documents; tokens over one half make the offending spans.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.common import WORD, bucket_of, raw, slices, table, text_of
from vellumgrid.storage import write_table

#: Labelled documents of each class that the classifier is fitted on, at most: the first by a hash of the id.
SAMPLE_OF_CLASS = 8000
#: Least documents, excess and significance of a kept feature. The bounded sample bounds their number.
LEAST_DOCUMENTS, LEAST_EXCESS, LEAST_G = 4, 6.0, 24.0
#: Hash buckets of the word before, and as many of the word after; classes of place in a text.
CONTEXT, PLACES = 1 << 13, 8
#: Pull to 0 of kept features and of context.
PULL, CONTEXT_PULL = 0.02, 0.5
#: Tasks that sum a gradient, at most.
GRADIENT_TASKS = 16
STEPS = 40
_TRIM = b".,;:!?\"'()[]{}<>*%#$&|-_"
_CHUNK = 64


def features_of(word: bytes) -> list[bytes]:
    """Of a lower-cased word: itself without punctuation around it, and its first 4 and 6 characters."""
    word = word.strip(_TRIM)
    if not word:
        return []
    letters = word.decode("utf-8", "ignore")
    return [b"w" + word, *(b"p" + letters[:k].encode() for k in (4, 6) if len(letters) > k)]


def count_features(docs: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each class that hold it, from columns body and toxic."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([seen[k][x] for x in keys], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "clean"])

        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(raw(batch, "body"), batch.column(1).to_pylist()):
                seen[toxic].update({f for w in set(text.lower().split()) for f in features_of(w)})
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield sent()
                    seen = {0: Counter(), 1: Counter()}
        yield sent()

    return docs.select("body", "toxic").mapInArrow(kernel, "feature binary, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def select_features(counts: DataFrame, toxic: int, clean: int) -> list[bytes]:
    """Features with an excess in toxic documents, most significant (log-likelihood ratio) first."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    excess = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
    share, n = toxic / max(1, toxic + clean), a + b
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (term(a, n * share) + term(b, n * (1 - share)))
    kept = counts.where((a >= LEAST_DOCUMENTS) & (excess > LEAST_EXCESS)).withColumn("g", g).where(F.col("g") > LEAST_G)
    return [bytes(r["feature"]) for r in kept.orderBy(F.desc("g"), "feature").collect()]


class Tagger(dict):
    """Word -> numbers of its kept features, from 1; a word without any has (). Remembers a bounded number of words."""

    def __init__(self, features: list[bytes]):
        super().__init__()
        self.number = {f: k for k, f in enumerate(features, 1)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(k for f in features_of(word) if (k := self.number.get(f)))
        if len(word) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[word] = found
        return found

    @property
    def width(self) -> int:
        """Weights of a field over these features: one unused, the kept ones, words before and after, places."""
        return 1 + len(self.number) + 2 * CONTEXT + PLACES

    def marked(self, text: bytes) -> tuple[int, list[int], list[tuple[int, ...]]]:
        """Number of words, places of those with a kept feature, and their features with those of their context."""
        words = text.lower().split()
        found = list(map(self.__getitem__, words))
        at = [k for k, x in enumerate(found) if x]
        before, n, low = [b"", *words], len(words), 1 + len(self.number)
        hashed = lambda word: zlib.crc32(word.strip(_TRIM)) % CONTEXT
        context = lambda k: (low + hashed(before[k]), low + CONTEXT + hashed(words[k + 1] if k + 1 < n else b""), low + 2 * CONTEXT + min(PLACES - 1, k.bit_length()))
        return n, at, [found[k] + context(k) for k in at]


@dataclass
class Field:
    """Scores of state 1 against state 0: each feature, a feature on a side word, bias; and of pairs of states."""

    weights: np.ndarray
    side: float = 0.0
    bias: float = -4.0
    pairs: np.ndarray = None  # (0, 1), (1, 0), (1, 1); (0, 0) is 0
    start: float = 0.0

    def scores(self, count: np.ndarray, at: np.ndarray, features: list[tuple[int, ...]]) -> np.ndarray:
        """Score of state 1 for each token of texts in a row; at: places in that row of the tokens with features."""
        n = int(count.sum())
        u = np.full(n, self.bias)
        if len(at):
            many = np.array([len(x) for x in features])
            flat = np.fromiter((f for x in features for f in x), np.int64, many.sum())
            np.add.at(u, np.repeat(at, many), self.weights[flat])
            owner = np.repeat(np.arange(len(count)), count)
            for step in (-1, 1):
                near = at + step
                ok = (near >= 0) & (near < n)
                ok[ok] = owner[near[ok]] == owner[at[ok]]
                np.add.at(u, near[ok], self.side)
        return np.clip(u, -40, 40)


def _arcs(u: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """(2, 2, n): weight of going from a state to another at each token; a text's first token forgets what was before."""
    e = np.exp(u)
    p = np.exp(field.pairs)
    m = np.empty((2, 2, len(u)))
    m[0, 0], m[0, 1], m[1, 0], m[1, 1] = 1, e * p[0], p[1], e * p[2]
    for i in (0, 1):
        m[i, 0, first], m[i, 1, first] = 1, e[first] * math.exp(field.start)
    return m


def _scan(m: np.ndarray, initial: tuple[float, float]) -> np.ndarray:
    """(2, n): the row vector after each matrix, from the initial one, each of sum 1. By chunks: products of whole chunks, the vectors
    between chunks by the same scan, then all chunks in step."""
    n = m.shape[2]
    if n <= _CHUNK:
        out, v = np.empty((2, n)), np.array(initial)
        for t in range(n):
            v = v @ m[:, :, t]
            v = v / v.sum()
            out[:, t] = v
        return out
    rows = -(-n // _CHUNK)
    padded = np.zeros((2, 2, rows * _CHUNK))
    padded[0, 0], padded[1, 1] = 1, 1
    padded[:, :, :n] = m
    padded = padded.reshape(2, 2, rows, _CHUNK)
    whole = padded[:, :, :, 0].copy()
    for t in range(1, _CHUNK):
        a = padded[:, :, :, t]
        whole = np.stack([np.stack([whole[i, 0] * a[0, j] + whole[i, 1] * a[1, j] for j in (0, 1)]) for i in (0, 1)])
        whole /= whole.sum(axis=(0, 1))
    begin = np.empty((2, rows))
    begin[:, 0] = initial
    begin[:, 1:] = _scan(whole[:, :, :-1], initial)
    out = np.empty((2, rows, _CHUNK))
    v = begin
    for t in range(_CHUNK):
        a = padded[:, :, :, t]
        v = np.stack([v[0] * a[0, 0] + v[1] * a[1, 0], v[0] * a[0, 1] + v[1] * a[1, 1]])
        v /= v.sum(axis=0)
        out[:, :, t] = v
    return out.reshape(2, -1)[:, :n]


def forward_backward(u: np.ndarray, count: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(state 1) of each token, the arcs, and P(states of two neighbours) (2, 2, n) where the first of a text has no neighbour."""
    n = len(u)
    if not n:
        return np.empty(0), np.empty((2, 2, 0)), np.empty((2, 2, 0))
    begin = (np.cumsum(count) - count)[count > 0]
    first = np.zeros(n, bool)
    first[begin] = True
    m = _arcs(u, first, field)
    alpha = _scan(m, (0.5, 0.5))
    beta = np.full((2, n), 0.5)
    if n > 1:
        beta[:, :-1] = _scan(m.transpose(1, 0, 2)[:, :, :0:-1], (0.5, 0.5))[:, ::-1]
    both = alpha * beta
    p = both[1] / both.sum(axis=0)
    pair = np.zeros((2, 2, n))
    pair[:, :, 1:] = alpha[:, None, :-1] * m[:, :, 1:] * beta[None, :, 1:]
    pair[:, :, first] = 0
    total = pair.sum(axis=(0, 1))
    pair /= np.where(total > 0, total, 1)
    return p, m, pair


def _joined(rows: list[tuple[int, list[int], list[tuple[int, ...]]]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    count = np.array([r[0] for r in rows], np.int64)
    begin = np.cumsum(count) - count
    at = np.concatenate([np.array(r[1], np.int64) + b for r, b in zip(rows, begin)]) if rows else np.empty(0, np.int64)
    return count, at, [f for r in rows for f in r[2]]


def _gradient(rows, toxic: list[int], field: Field) -> np.ndarray:
    """Of the log-likelihood: features, side, bias, three pairs, start; then the number of documents."""
    count, at, features = _joined(rows)
    u = field.scores(count, at, features)
    p, _, pair = forward_backward(u, count, field)
    y = np.zeros(len(u))
    owner = np.repeat(np.arange(len(count)), count)
    y[at] = np.array(toxic, float)[owner[at]] if len(at) else 0
    d = y - p
    size = len(field.weights)
    g = np.zeros(size + 6)
    if len(at):
        many = np.array([len(x) for x in features])
        flat = np.fromiter((f for x in features for f in x), np.int64, many.sum())
        g[:size] = np.bincount(flat, np.repeat(d[at], many), size)
        for step in (-1, 1):
            near = at + step
            ok = (near >= 0) & (near < len(u))
            ok[ok] = owner[near[ok]] == owner[at[ok]]
            g[size] += d[near[ok]].sum()
    g[size + 1] = d.sum()
    first = np.zeros(len(u), bool)
    first[(np.cumsum(count) - count)[count > 0]] = True
    before = np.concatenate([[0], y[:-1]]) if len(y) else y
    inner = ~first
    g[size + 2] = ((1 - before) * y)[inner].sum() - pair[0, 1].sum()
    g[size + 3] = (before * (1 - y))[inner].sum() - pair[1, 0].sum()
    g[size + 4] = (before * y)[inner].sum() - pair[1, 1].sum()
    g[size + 5] = d[first].sum()
    return np.append(g, len(rows))


def fit_field(encoded: DataFrame, kept: int, width: int, steps: int = STEPS) -> Field:
    """encoded: (n, at, features, toxic) of the bounded sample; of `width` weights the first are of `kept` features. Gradients are summed
    by tasks; the driver takes resilient steps (sign and own step size of each weight), with a weak pull to 0."""
    context = encoded.sparkSession.sparkContext
    x = np.zeros(width + 6)
    x[: kept + 1], x[width + 1] = 1.0, -5.0
    pull = np.concatenate([np.full(kept + 1, PULL), np.full(width - kept - 1, CONTEXT_PULL), np.zeros(6)])
    rate, last = np.full(len(x), 0.5), np.zeros(len(x))
    dealt = encoded.coalesce(GRADIENT_TASKS)

    def as_field(x: np.ndarray) -> Field:
        return Field(x[:width], x[width], x[width + 1], x[width + 2 : width + 5], x[width + 5])

    for _ in range(steps):
        shared = context.broadcast(as_field(x))

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                for part in slices(batch, 512):
                    r = part.to_pydict()
                    total = total + _gradient([(n, a, [tuple(x) for x in f]) for n, a, f in zip(r["n"], r["at"], r["features"])], r["toxic"], shared.value)
            if not isinstance(total, int):
                yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

        parts = [np.frombuffer(r["g"]) for r in dealt.mapInArrow(kernel, "g binary").collect()]
        shared.unpersist()
        if not parts:
            break
        g = sum(parts)[:-1] - pull * x
        turn = np.sign(g) * np.sign(last)
        rate = np.clip(np.where(turn > 0, rate * 1.2, np.where(turn < 0, rate * 0.5, rate)), 1e-4, 2.0)
        g = np.where(turn < 0, 0, g)
        x = np.clip(x + np.sign(g) * rate, -12, 12)
        last = g
    return as_field(x)


@dataclass
class Scorer:
    features: list[bytes]
    field: Field
    logistic: np.ndarray

    def score(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(facts @ self.logistic, -40, 40)))


def _facts(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each text: 1, log of 1 + expected toxic tokens, greatest probability, its logit."""
    out = np.zeros((len(count), 4))
    out[:, 0], out[:, 3] = 1, -12
    full = np.flatnonzero(count > 0)
    if len(full):
        begin = (np.cumsum(count) - count)[full]
        top = np.maximum.reduceat(p, begin)
        out[full, 1], out[full, 2] = np.log1p(np.add.reduceat(p, begin)), top
        top = np.clip(top, 1e-6, 1 - 1e-6)
        out[full, 3] = np.log(top / (1 - top))
    out[:, 3] /= 4
    return out


def _fit_logistic(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Newton steps with a ridge; classes weigh as in all labels, `prior` of which are toxic."""
    share = y.mean()
    weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w), -2, 2)
    return w


def fit(docs: DataFrame, labels: DataFrame, trains, sample: int = SAMPLE_OF_CLASS) -> Scorer | None:
    """docs: doc_id, text; labels: doc_id, toxic; trains(name): a boolean column that says which doc_ids may be learned from.

    At most `sample` labelled documents of each class. A null label is none; a doc_id labelled twice is toxic if it is once.
    None if either class has no document.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(trains("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    chosen = [own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows of two numbers
    rows = write_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text").cast("string")).alias("body")).join(ids, "doc_id"), "labelled")
    have = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not have.get(0) or not have.get(1):
        return None
    features = select_features(count_features(rows), have[1], have[0])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(features)
        for batch in batches:
            for part in slices(batch):
                n, at, found = zip(*map(tagger.marked, raw(part, "body")))
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.list_(pa.int32()))), part.column(1).cast(pa.int32())], names=["n", "at", "features", "toxic"])

    encoded = write_table(rows.select("body", "toxic").mapInArrow(encode, "n int, at array<int>, features array<array<int>>, toxic int"), "encoded")
    field = fit_field(encoded, len(features), Tagger(features).width)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                r = part.to_pydict()
                count, at, found = _joined([(n, a, [tuple(x) for x in f]) for n, a, f in zip(r["n"], r["at"], r["features"])])
                p, _, _ = forward_backward(field.scores(count, at, found), count, field)
                x = _facts(p, count)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(4)), part.column(3)], names=["a", "b", "c", "d", "toxic"])

    facts = encoded.mapInArrow(measure, "a double, b double, c double, d double, toxic int").toPandas().to_numpy(float)
    return Scorer(features, field, _fit_logistic(facts[:, :4], facts[:, 4], n[1] / (n[0] + n[1])))


def score(docs: DataFrame, scorer: Scorer | None, prior: float = 0.0) -> DataFrame:
    """All input columns with score (0 to 1) and spans (start, end: code points of runs of toxic tokens, end exclusive).

    A null or empty text has the score of a text without a toxic token. Without a scorer every score is `prior`. Rows that repeat
    stay repeated, a null doc_id stays null. Only input columns named score or spans are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "spans")]
    spans_type = "array<struct<start:int,end:int>>"
    if scorer is None:
        return docs.select(*kept, F.lit(prior).cast("double").alias("score"), F.array().cast(spans_type).alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    base = docs.select(*kept)
    schema = base.withColumns({"score": F.lit(0.0), "spans": F.array().cast(spans_type)}).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        tagger, word = Tagger(s.features), regex.compile(WORD)
        for batch in batches:
            for part in slices(batch):
                texts = raw(part)
                rows = [tagger.marked(x) for x in texts]
                count, at, found = _joined(rows)
                p, _, _ = forward_backward(s.field.scores(count, at, found), count, s.field)
                scores = s.score(_facts(p, count))
                spans: list[list[dict[str, int]]] = [[] for _ in texts]
                owner, begin = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
                hot = np.flatnonzero(p >= 0.5)
                for k in np.unique(owner[hot]):
                    places = [m.span() for m in word.finditer(texts[k].decode())]
                    last = None
                    for t in hot[owner[hot] == k] - begin[k]:
                        if last is not None and t == last + 1:
                            spans[k][-1]["end"] = places[t][1]
                        else:
                            spans[k].append({"start": places[t][0], "end": places[t][1]})
                        last = t
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[*part.schema.names, "score", "spans"])

    return base.mapInArrow(kernel, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and offending spans (start:end in code points, comma-joined) of every document; see `fit` and `score`."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scorer = fit(docs, table(spark, sf_dir, "labels"), trains)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return score(docs, scorer).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


def held_out(name: str) -> Column:
    return F.coalesce(bucket_of(name, 5) == 0, F.lit(False))


def trains(name: str) -> Column:
    return ~held_out(name)
