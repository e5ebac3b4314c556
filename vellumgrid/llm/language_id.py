"""Language of a text by error-correcting output codes.

Every language has a codeword of bits, far from the others. One binary classifier for each bit is a logistic function of a
text's hashed letter n-grams; all are fitted together by distributed gradients on a bounded sample of labelled rows. A text has
the language whose codeword is nearest, where a bit's distance is the logistic loss of its margin, weighted by how often that
bit is right for that language in sample rows kept out of the fit. Where the second codeword is about as near, the text is
flagged as ambiguous.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.llm.common import bucket_of, slices, table
from vellumgrid.storage import write_table

#: Labelled documents of each language that the classifiers are fitted on, at most, chosen by a hash; a fifth only weighs bits.
SAMPLE_OF_LANGUAGE, KEPT_OUT = 1000, 5
MOST_LANGUAGES = 256
#: Longest n-gram of letters, and hash buckets of n-grams.
LONGEST, BUCKETS = 4, 1 << 16
#: Code points that are counted at a time.
CHUNK = 1 << 20
ROUNDS, PULL = 30, 1e-4
#: Tasks that sum a gradient, and parts of it that merge in a task each.
GRADIENT_TASKS, SLOTS = 16, 8
#: Difference of distances, in losses of an undecided bit, below which two languages are taken as equally near.
AMBIGUITY = 0.25
NO_LANGUAGE = "und"
_SPACE, _MARK, _LETTER = 0, 1, 2
_KIND: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind of every code point: letter, mark (kept inside words), or what words end at."""
    if not _KIND:
        first = "".join(unicodedata.category(chr(k))[0] for k in range(sys.maxunicode + 1))
        codes = np.frombuffer(first.encode(), np.uint8)
        _KIND.append(np.where(codes == ord("L"), _LETTER, np.where(codes == ord("M"), _MARK, _SPACE)).astype(np.uint8))
    return _KIND[0]


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text in parts of at most `size` code points, each cut after a space where there is one."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(" ", at, at + size) + 1 or at + size
        yield text[at:end]
        at = end
    yield text[at:]


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of a text's n-grams, and their values: square roots of counts, of length 1. None for a text without a letter.

    Texts are lower-cased; runs of what is neither letter nor mark are one space. An n-gram has a space at its ends only.
    """
    total, letters = None, False
    for part in chunks(text):
        codes = np.frombuffer(part.lower().encode("utf-32-le", "replace"), "<u4")
        kind = kinds()[codes]
        letters = letters or bool((kind == _LETTER).any())
        codes = np.concatenate([[0], np.where(kind == _SPACE, 0, codes), [0]]).astype(np.uint64)
        gap = codes == 0
        kept = ~(gap & np.concatenate([[False], gap[:-1]]))
        codes, gap = codes[kept], gap[kept]
        found, value, inner = [], np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
        for n in range(1, LONGEST + 1):
            if len(codes) < n:
                break
            end = len(codes) - n + 1
            value = value[:end] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            inner = inner[:end] | gap[n - 2 : n - 2 + end] if n > 2 else np.zeros(end, bool) if n == 2 else gap
            found.append(((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))[~inner])
        more = np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
        total = more if total is None else total + more
    if not letters:
        return None
    at = np.flatnonzero(total)
    value = np.sqrt(total[at])
    return at, value / np.linalg.norm(value)


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages, bits as -1 and 1: every split of the languages for up to 7, else rows of a Hadamard matrix.

    Of the matrix's order m, any two differ in m / 2 bits; the constant column is left out.
    """
    if n <= 2:
        return np.array([[1.0], [-1.0]])[:n]
    if n <= 7:
        split = np.arange(1, 1 << (n - 1))
        return np.array([np.ones(len(split)), *(1.0 - 2.0 * (split >> k & 1) for k in range(n - 1))])
    m = 1 << (n - 1).bit_length()
    rows, columns = np.arange(n)[:, None], np.arange(1, m)[None, :]
    odd = np.zeros((n, m - 1), np.int64)
    for k in range(m.bit_length()):
        odd ^= (rows & columns) >> k & 1
    return 1.0 - 2.0 * odd


@dataclass
class Classifier:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    """Of each bucket and bit."""
    bias: np.ndarray
    reliable: np.ndarray
    """Weight of each bit for each language; of a language they sum to 1."""

    def margins(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.bias

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Of each text to each codeword: weighted logistic losses."""
        return np.stack([np.logaddexp(0, -margins * word) @ w for word, w in zip(self.code, self.reliable)], axis=1)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its share of the likelihood, the second (-1 if there is one language only), and whether both are about as near.

        Of languages equally near, the first by code point.
        """
        d = self.distances(margins)
        order = np.argsort(d, axis=1, kind="stable")
        rows = np.arange(len(d))
        first = order[:, 0]
        like = np.exp(-(d - d[rows, first][:, None]) * self.code.shape[1])
        second = order[:, 1] if d.shape[1] > 1 else np.full(len(d), -1)
        near = d[rows, second] - d[rows, first] < AMBIGUITY * np.log(2) if d.shape[1] > 1 else np.zeros(len(d), bool)
        return first, 1 / like.sum(axis=1), second, near


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language of each row, and begin, bucket and value of all features."""
    at = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
    value = [np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()]
    return batch.column(0).to_numpy(), np.cumsum([0, *map(len, at)])[:-1], np.concatenate(at), np.concatenate(value)


def _margins(weights: np.ndarray, begin: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[at] * value[:, None], begin, axis=0)


def gradient(language: np.ndarray, begin: np.ndarray, at: np.ndarray, value: np.ndarray, x: np.ndarray, code: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of the weighted logistic losses of all bits, by bucket and bit, the last row by bias. x: weights, and the bias as last row."""
    truth = code[language]
    m = _margins(x[:-1], begin, at, value) + x[-1]
    slope = -truth / (1 + np.exp(np.clip(truth * m, -60, 60))) * share[language][:, None]
    each = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))
    out = np.empty_like(x, dtype=np.float32)
    for bit in range(code.shape[1]):
        out[:-1, bit] = np.bincount(at, value * slope[each, bit], len(x) - 1)
    out[-1] = slope.sum(axis=0)
    return out


def fit_bits(features: DataFrame, code: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights and bias of each bit by accelerated gradient steps. features: (language, at, value) of the bounded sample.

    Tasks sum gradients over their rows in parts that merge in a task each, so the driver receives one model a round.
    """
    context = features.sparkSession.sparkContext
    bits = code.shape[1]
    x = np.zeros((BUCKETS + 1, bits), np.float32)
    ahead, pace = x, 1.0
    dealt = features.coalesce(GRADIENT_TASKS)
    edges = np.linspace(0, BUCKETS + 1, SLOTS + 1).astype(int)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[slot] = total.get(slot, 0) + np.frombuffer(g, np.float32)
        for slot, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([g.tobytes()], pa.binary())], names=["slot", "g"])

    for _ in range(rounds):
        shared = context.broadcast(ahead)

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for part in slices(batch):
                    g = gradient(*_unpacked(part), shared.value, code, share)
                    total = g if total is None else total + g
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([total[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())], names=["slot", "g"])

        sums = dealt.mapInArrow(kernel, "slot int, g binary").repartition(SLOTS, "slot").mapInArrow(merged, "slot int, g binary").collect()
        shared.unpersist()
        if not sums:
            break
        g = np.concatenate([np.frombuffer(r["g"], np.float32) for r in sorted(sums, key=lambda r: r["slot"])]).reshape(x.shape)
        # features have length 1 and shares sum to 1: a step of 2 is within the bound of the curvature, bias included
        new = ahead - 2.0 * (g + PULL * ahead)
        later = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = (new + (pace - 1) / later * (new - x)).astype(np.float32)
        x, pace = new, later
    return x


def fit(docs: DataFrame, trains: Column, sample: int = SAMPLE_OF_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Classifier | None:
    """docs: doc_id, text, lang; trains: a boolean column over docs, null counts as false.

    At most `sample` rows of each language. Rows without a language or without a letter teach nothing. None where no row is left.
    Raises if there are more than most_languages languages, as the model grows with them.
    """
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("string").alias("id"), trains.alias("trains"))
    own = own.where(F.col("trains") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().limit(most_languages + 1).collect()}
    if not counts:
        return None
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    languages = sorted(counts)
    number = {x: k for k, x in enumerate(languages)}
    code = codewords(len(languages))
    # about twice the sample by a hash, of which the first stay: no language is ever sorted whole
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / float(1 << 40)
    known = F.broadcast(docs.sparkSession.createDataFrame([(x, number[x], 2.0 * sample / counts[x]) for x in languages], "lang string, language int, below double"))
    near = own.withColumn("place", place).join(known, "lang").where(F.col("place") <= F.col("below"))
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy("place", "id"))).where(F.col("k") <= sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [count_grams(x) for x in part.column(2).to_pylist()]
                full = [k for k, x in enumerate(found) if x]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), part.column(1).take(pa.array(full)), *(pa.array([found[k][c].astype(t).tobytes() for k in full], pa.binary()) for c, t in enumerate((np.int32, np.float32)))], names=["language", "k", "at", "value"])

    encoded = write_table(chosen.select("language", "k", "text").mapInArrow(encode, "language int, k int, at binary, value binary"), "language-features")
    fitted = encoded.where(F.col("k") % KEPT_OUT != 0).select("language", "at", "value")
    many = np.zeros(len(languages))
    for r in fitted.groupBy("language").count().collect():
        many[r["language"]] = r["count"]
    share = np.where(many > 0, 1 / np.maximum(many, 1) / max(1, (many > 0).sum()), 0)
    x = fit_bits(fitted, code, share)
    shared = docs.sparkSession.sparkContext.broadcast(x)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                language, begin, at, value = _unpacked(part)
                right = (_margins(shared.value[:-1], begin, at, value) + shared.value[-1]) * code[language] > 0
                yield pa.RecordBatch.from_arrays([pa.array(language), pa.array([[int(b) for b in r] for r in right], pa.list_(pa.int32()))], names=["language", "right"])

    checked = encoded.where(F.col("k") % KEPT_OUT == 0).select("language", "at", "value").mapInArrow(check, "language int, right array<int>")
    right, seen = np.zeros(code.shape), np.zeros(len(languages))
    sums = checked.groupBy("language").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("right")[k]) for k in range(code.shape[1]))).alias("right"))
    for r in sums.collect():
        seen[r["language"]], right[r["language"]] = r["n"], r["right"]
    rate = (right + 1) / (seen[:, None] + 2)
    return Classifier(languages, code, x[:-1], x[-1], rate / rate.sum(axis=1, keepdims=True))


ADDED = "lang_pred string, score double, runner_up string, ambiguous boolean"


def predict(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """All input columns with lang_pred, score (0 to 1), runner_up and ambiguous, from column text alone.

    A text that is null or has no letter is `und` with score 0, and so is every text without a classifier. A runner-up is null where
    there is none. Rows that repeat stay repeated. Only input columns of the names added are replaced.
    """
    added = [x.split(" ")[0] for x in ADDED.split(", ")]
    base = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in added))
    if classifier is None:
        return base.withColumns({"lang_pred": F.lit(NO_LANGUAGE), "score": F.lit(0.0), "runner_up": F.lit(None).cast("string"), "ambiguous": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    place = base.columns.index("text")
    schema = base.withColumns({x: F.lit(None).cast(x_type) for x, x_type in (y.split(" ") for y in ADDED.split(", "))}).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for part in slices(batch):
                lang, score, second, near = ([x] * part.num_rows for x in (NO_LANGUAGE, 0.0, None, False))
                found = [count_grams(x) if x else None for x in part.column(place).cast(pa.string()).to_pylist()]
                full = [k for k, x in enumerate(found) if x]
                if full:
                    for k, a, b, d, e in zip(full, *(x.tolist() for x in c.decide(np.stack([c.margins(*found[k]) for k in full])))):
                        lang[k], score[k], second[k], near[k] = c.languages[a], min(1.0, b), c.languages[d] if d >= 0 else None, e
                more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(near, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *added])

    return base.mapInArrow(kernel, schema)


def held_out(name: str) -> Column:
    """Rows that nothing is learned from; a row without doc_id is none of them."""
    return F.coalesce(bucket_of(name, 4) == 2, F.lit(False))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; see `fit` and `predict`."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs, ~held_out("doc_id")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")
