"""A hashed maximum-entropy language model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class, history). The most frequent words are in classes of 48,
by frequency; all other words, known or not, are in classes by spelling (the last bytes). Both factors of a frequent word are
maximum-entropy models over hashed features of the history: for its class the last word, the one before it (a skip), and both, for
the word in its class the last one. In a class by spelling, a word has its add-one relative frequency, counted over all training documents.

Training is iterative parameter mixing. In each round, tasks take mini-batch gradient steps (Adagrad by feature) over their
part of the training documents from the common parameters; changes are averaged, by how often a task met a feature, in a tree.
Every training document is in exactly one round. Parameters have a fixed size; counts grow with the corpus and stay in tables:
only the most frequent words, of bounded number and length, are broadcast, and the rest meet their counts in a join.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.common import bucket_of, raw, slices, table, text_of
from vellumgrid.storage import write_table

END = b""
LOG10 = float(np.log(10.0))


@dataclass(frozen=True)
class Settings:
    head_classes: int = 16
    class_words: int = 48
    """The most frequent words, 768 of them, are in classes of their own."""
    spelling_classes: int = 4
    spelling_bytes: int = 3
    symbols: int = 8192
    """Buckets of a word as history; as many again for the skip feature, twice as many for the pair."""
    inner_rows: int = 32768
    """Hashed rows (feature, class) of the softmax within a class."""
    frequent: int = 120_000
    frequent_bytes: int = 64
    """Broadcast words: so many at most, none longer; all others are joined."""
    rounds: int = 4
    batch: int = 8192
    rate: float = 0.15
    task_tokens: int = 2_000_000
    """Training tokens of a task in all rounds, at least: each sends parameters, so their sum is bounded by the input."""
    merge_bytes: int = 64 << 20
    """Parameters that a task of the merging tree receives, at most, but for two sets of them."""

    @property
    def parameter_bytes(self) -> int:
        return 4 * (4 * self.symbols * (self.classes + 2) + self.inner_rows * (self.class_words + 2))

    @property
    def fan_in(self) -> int:
        return max(2, self.merge_bytes // self.parameter_bytes)

    @property
    def classes(self) -> int:
        return self.head_classes + self.spelling_classes

    @property
    def head(self) -> int:
        return self.head_classes * self.class_words


def spelling_class(word: bytes, s: Settings) -> int:
    return s.head_classes + zlib.crc32(word[-s.spelling_bytes :]) % s.spelling_classes


def _symbol(word: bytes, rank: int, s: Settings) -> int:
    """History bucket: an own one for the most frequent words, else one of the upper half by spelling."""
    half = s.symbols // 2
    return rank if 0 <= rank < half else half + zlib.crc32(word[-s.spelling_bytes :]) % half


class Lexicon(dict):
    """word -> (rank or -1, class, symbol); other words are worked out when met and remembered up to a number."""

    def __init__(self, words: list[bytes], counts: np.ndarray, s: Settings):
        super().__init__()
        self.s, self.counts, self.known = s, counts, len(words)
        for rank, word in enumerate(words):
            cls = rank // s.class_words if rank < s.head else spelling_class(word, s)
            self[word] = rank | cls << 24 | _symbol(word, rank, s) << 32

    #: Set in place of a rank.
    NONE = 0xFFFFFF

    def __missing__(self, word: bytes) -> int:
        value = self.NONE | spelling_class(word, self.s) << 24 | _symbol(word, -1, self.s) << 32
        if len(self) < self.known + 200_000 and len(word) <= 64:
            self[word] = value
        return value


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _codes(texts: list[list[bytes]], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens in a row, and where each text begins."""
    begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return np.fromiter(map(lexicon.__getitem__, chain.from_iterable(texts)), np.int64, begin[-1]), begin


def _history(symbol: np.ndarray, begin: np.ndarray, s: Settings) -> np.ndarray:
    """Three feature rows for each token. Before the first token of a text stands the end of another."""
    n = len(symbol)
    place = np.arange(n) - np.repeat(begin[:-1], np.diff(begin))
    border = s.symbols - 1
    one, two = np.full(n, border), np.full(n, border)
    one[1:], two[2:] = symbol[:-1], symbol[:-2]
    one[place < 1], two[place < 2] = border, border
    pair = ((one * 0x9E3779B1 + two * 0x85EBCA77) >> 7) % (2 * s.symbols)
    return np.stack([one, s.symbols + two, 2 * s.symbols + pair])


class Model:
    """Parameters in three blocks, each with a row of Adagrad sums."""

    def __init__(self, s: Settings):
        self.s = s
        rows = 4 * s.symbols
        self.outer, self.outer_sums = np.zeros((rows, s.classes), np.float32), np.full(rows, 1e-2, np.float32)
        self.inner, self.inner_sums = np.zeros((s.inner_rows, s.class_words), np.float32), np.full(s.inner_rows, 1e-2, np.float32)
        self.bias, self.inner_bias = np.zeros(s.classes, np.float32), np.zeros((s.head_classes, s.class_words), np.float32)

    @classmethod
    def started(cls, head_counts: np.ndarray, spelling_counts: np.ndarray, s: Settings) -> Model:
        """From the frequencies of classes and of words in them."""
        m = cls(s)
        grid = np.zeros(s.head)
        grid[: len(head_counts)] = head_counts
        grid = grid.reshape(s.head_classes, s.class_words)
        m.bias[:] = np.log(np.concatenate([grid.sum(1), spelling_counts]) + 1.0)
        m.inner_bias[:] = np.log(grid + 1e-3)
        return m

    def inner_rows(self, features: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The last word only: a class's words follow from it most."""
        return ((features[:1] * 0x9E3779B1 + cls * 0x85EBCA77) >> 9) % self.s.inner_rows

    def predict(self, features: np.ndarray, cls: np.ndarray, rank: np.ndarray):
        """Natural log probabilities of class and of word in class (0 in classes by spelling), with what a gradient needs."""
        z = self.outer.take(features[0], axis=0)
        z += self.outer.take(features[1], axis=0)
        z += self.outer.take(features[2], axis=0)
        z += self.bias
        _softmax(z)
        n = len(cls)
        logp = np.log(np.maximum(z[np.arange(n), cls], 1e-30)).astype(np.float64)
        at = np.flatnonzero(cls < self.s.head_classes)
        rows = self.inner_rows(features[:, at], cls[at])
        y = self.inner.take(rows[0], axis=0)
        y += self.inner_bias.take(cls[at], axis=0)
        _softmax(y)
        slot = rank[at] % self.s.class_words
        logp[at] += np.log(np.maximum(y[np.arange(len(at)), slot], 1e-30))
        return logp, (z, y, at, rows, slot)

    def learn(self, features: np.ndarray, cls: np.ndarray, rank: np.ndarray, met: tuple[np.ndarray, np.ndarray]) -> None:
        _, (z, y, at, rows, slot) = self.predict(features, cls, rank)
        z[np.arange(len(cls)), cls] -= 1
        y[np.arange(len(at)), slot] -= 1
        for k in range(3):
            _step(self.outer, self.outer_sums, met[0], features[k], z, self.s.rate)
        _step(self.inner, self.inner_sums, met[1], rows[0], y, self.s.rate)


def _softmax(z: np.ndarray) -> None:
    """Rows of logits to probabilities, in place. One number for all rows keeps exponents within bounds where it can, as a maximum of
    each short row takes longer than all the rest; logits that lie too far apart for that have their own."""
    if z.size:
        top = z.max()
        if not top - z.min() < 80:
            top = z.max(axis=1, keepdims=True)
        z -= top
        np.exp(z, out=z)
        z /= np.einsum("ij->i", z)[:, None]


def _step(weights: np.ndarray, sums: np.ndarray, met: np.ndarray, row: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """Adagrad by row, with one step for the gradients of a row in the batch, over the root of their number."""
    if not len(row):
        return
    if len(weights) <= 1 << 16:
        row = row.astype(np.uint16)  # numpy sorts these by radix
    order = np.argsort(row, kind="stable")
    ordered = row[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    which, many = ordered[first], np.diff(np.append(first, len(row)))
    total = np.add.reduceat(gradient.take(order, axis=0), first, axis=0)
    total /= np.sqrt(many)[:, None].astype(gradient.dtype)
    own = sums[which] + np.einsum("ij,ij->i", total, total) / np.float32(total.shape[1])
    sums[which] = own
    total *= (rate / np.sqrt(own))[:, None]
    weights[which] = weights.take(which, axis=0) - total
    met[which] += many


_SENT = "outer_at binary, outer binary, inner_at binary, inner binary"


def _sum_changes(batches: Iterator[pa.RecordBatch], s: Settings) -> pa.RecordBatch:
    """Sums of changes times counts, and of counts, over all rows of a task; the last column of a row is its count."""
    sizes = {"outer": (4 * s.symbols, s.classes + 2), "inner": (s.inner_rows, s.class_words + 2)}
    total = {k: np.zeros(v, np.float32) for k, v in sizes.items()}
    for batch in batches:
        for row in batch.to_pylist():
            for k in total:
                at = np.frombuffer(row[f"{k}_at"], np.int32)
                total[k][at] += np.frombuffer(row[k], np.float32).reshape(len(at), sizes[k][1])
    return _sent(total)


def _sent(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    out = {}
    for k, v in total.items():
        at = np.flatnonzero(v[:, -1]).astype(np.int32)
        out |= {f"{k}_at": [at.tobytes()], k: [np.ascontiguousarray(v[at]).tobytes()]}
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.binary()) for k in out]))


def train(docs: DataFrame, shared_words, key: str, spelling_counts: np.ndarray, s: Settings, tasks: int) -> Model:
    """docs: (round, body), training rows only; shared_words: a broadcast of frequent words and their counts, and key its name. The driver holds the parameters, whose size is fixed."""
    context = docs.sparkSession.sparkContext
    model = Model.started(shared_words.value[1][: s.head], spelling_counts, s)
    for number in range(s.rounds):
        shared = context.broadcast(model)

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lexicon = _lexicon(shared_words, key, s)
            old = shared.value
            new = Model(s)
            for k in ("outer", "outer_sums", "inner", "inner_sums", "bias", "inner_bias"):
                setattr(new, k, getattr(old, k).copy())
            met = np.zeros(len(new.outer), np.float32), np.zeros(len(new.inner), np.float32)
            for batch in batches:
                for part in slices(batch):
                    codes, begin = _codes([tokens(x) for x in raw(part, "body")], lexicon)
                    rank, cls, symbol = codes & Lexicon.NONE, codes >> 24 & 0xFF, codes >> 32
                    features = _history(symbol, begin, s)
                    for at in range(0, len(codes), s.batch):
                        to = at + s.batch
                        new.learn(features[:, at:to], cls[at:to], rank[at:to], met)
            total = {}
            for k, n in (("outer", met[0]), ("inner", met[1])):
                change = getattr(new, k) - getattr(old, k)
                more = getattr(new, f"{k}_sums") - getattr(old, f"{k}_sums")
                total[k] = np.concatenate([change * n[:, None], (more * n)[:, None], n[:, None]], axis=1).astype(np.float32)
            yield _sent(total)

        sums = docs.where(F.col("round") == number).select("body").coalesce(tasks).mapInArrow(kernel, _SENT)
        parts = sums.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // s.fan_in)
            sums = sums.repartition(parts).mapInArrow(lambda batches: iter([_sum_changes(batches, s)]), _SENT)
        received = _sum_changes(iter([pa.RecordBatch.from_pylist([r.asDict() for r in sums.collect()], schema=pa.schema([(x.split(" ")[0], pa.binary()) for x in _SENT.split(", ")]))]), s)
        row = received.to_pylist()[0]
        for k, width in (("outer", s.classes), ("inner", s.class_words)):
            at = np.frombuffer(row[f"{k}_at"], np.int32)
            data = np.frombuffer(row[k], np.float32).reshape(len(at), width + 2)
            getattr(model, k)[at] += data[:, :width] / data[:, -1:]
            getattr(model, f"{k}_sums")[at] += data[:, width] / data[:, -1]
        shared.unpersist()
    return model


_LEXICON: dict[str, Lexicon] = {}


def _lexicon(shared, key: str, s: Settings) -> Lexicon:
    """A worker's own lexicon, made once for each set of broadcast words."""
    if key not in _LEXICON:
        _LEXICON.clear()
        _LEXICON[key] = Lexicon(*shared.value, s)
    return _LEXICON[key]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c): lower-cased (A-Z) tokens of a column `body`; the end of a text is the empty word. Tasks send partial counts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in raw(batch, "body"):
                seen.update(text.lower().split())
                seen[END] += 1
                if len(seen) > 300_000:
                    yield sent()
                    seen.clear()
        yield sent()

    return docs.select("body").mapInArrow(kernel, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, s: Settings) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words that are not too long, with their counts, most frequent first: all with at least some count.

    That count comes from a histogram of fixed size (by 64ths of powers of two), so that tasks only send words that are kept.
    """
    short = counts.where(F.octet_length("word") <= s.frequent_bytes).withColumn("bin", F.floor(F.log2("c") * 64).cast("int"))
    total, least = 0, 1 << 30
    for at, n in sorted(((r["bin"], r["count"]) for r in short.groupBy("bin").count().collect()), reverse=True):
        if total + n > s.frequent:
            break
        total, least = total + n, at
    found = short.where(F.col("bin") >= least).select("word", "c").toArrow()
    words, many = found.column("word").to_pylist(), found.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-many[k], words[k]))
    return [words[k] for k in order], many[order] if order else np.zeros(0, np.int64)


def score_documents(docs: DataFrame, held_out, settings: Settings | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    held_out: a boolean column over docs; rows where it is true don't train (null counts as false). A null text is empty: one token,
    the end; a null doc_id trains and stays null. Words of equal count rank by their bytes. Rows that repeat each count and each return. Without a training row, every token has base probability 1 and the model
    is uniform over classes. Other columns are ignored.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    ready = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(F.col("text").cast("string")).alias("body"),
        F.coalesce(F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 7), F.lit(s.rounds)), F.lit(0)).alias("round"),
    )
    training = ready.where(~F.col("held_out"))
    counts = write_table(count_tokens(training), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    cls = F.pmod(F.crc32(F.expr(f"substring(word, -{s.spelling_bytes})")), F.lit(s.spelling_classes)).cast("int")
    words, many = frequent_words(counts, s)
    sizes = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy(cls.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    spelled = np.array([sizes.get(k, (0, 0)) for k in range(s.spelling_classes)], np.float64).reshape(-1, 2)
    for word, c in zip(words[: s.head], many[: s.head]):  # these are in classes of their own
        spelled[spelling_class(word, s) - s.head_classes] -= (c, 1)
    below = np.log10(spelled.sum(axis=1) + 1)
    context, key = spark.sparkContext, uuid.uuid4().hex
    shared_words = context.broadcast((words, many))
    model = train(training.select("round", "body"), shared_words, key, spelled[:, 0], s, 1 + int(total) // s.task_tokens)
    shared = context.broadcast(model)
    base_below = float(np.log10(total + distinct + 1))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon, m = _lexicon(shared_words, key, s), shared.value
        known = np.log10(np.append(lexicon.counts, 0) + 1.0)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch):
                texts = [tokens(x) for x in raw(part, "body")]
                codes, begin = _codes(texts, lexicon)
                rank, kind, symbol = codes & Lexicon.NONE, codes >> 24 & 0xFF, codes >> 32
                features = _history(symbol, begin, s)
                score = np.concatenate([m.predict(features[:, at : at + s.batch], kind[at : at + s.batch], rank[at : at + s.batch])[0] for at in range(0, len(codes), s.batch)]) / LOG10
                own = rank < Lexicon.NONE
                log_count = known[np.where(own, rank, len(lexicon.counts))]
                spelled_out = own & (kind >= s.head_classes)
                score += np.where(spelled_out, log_count - below[np.maximum(kind - s.head_classes, 0)], 0.0)
                base = np.where(own, log_count - base_below, 0.0)
                rare = []
                for k, x in enumerate(texts):
                    a, b = begin[k], begin[k + 1]
                    rare.append(list(Counter(x[i] for i in np.flatnonzero(~own[a:b])).items()))
                ids = np.arange(number, number + len(texts))
                number += len(texts)
                add = lambda x: np.add.reduceat(x, begin[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column(0), part.column(1), pa.array(np.diff(begin)), pa.array(add(own.astype(np.int64))), pa.array(add(base)), pa.array(add(score)), pa.array([[{"word": w, "n": n} for w, n in x] for x in rare], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:long>>"
    scored = write_table(ready.select("doc_id", "held_out", "body").mapInArrow(kernel, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    within = F.element_at(F.array(*map(F.lit, below.tolist())), cls + 1)
    more = (
        rare.join(counts, "word", "left")
        .select("row", F.when(c > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * (F.log10(c + 1) - base_below)).alias("base"), (F.col("n") * (F.log10(c + 1) - within)).alias("score"))
        .groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
    )


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document; see `score_documents`."""
    return score_documents(table(spark, sf_dir, "documents"), bucket_of("doc_id", 7) == 2)
