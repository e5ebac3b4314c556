"""Substring dedup by seed and extend.

Seeds are winnowed anchors: in every window of 20 words, the k-word run with the least hash (the last of equals). Equal
windows have equal anchors, so documents that share a window meet in a join on anchors. Around an anchor, the match is
extended both ways to all windows that chose it: their whole extent is hashed once. Occurrences with equal extents after
the first are repeats at full length. Where an anchor has several extents, its windows are compared one by one.
Repeats that touch or overlap form the maximal repeats, whose words are removed.

A kernel keeps the first occurrence of a key in its slice of documents and sends the later ones past the join, spread
evenly, since they are repeats already; so a passage that a third of all rows hold costs its join a row per slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.llm.common import raw, slices, table, text_of
from vellumgrid.storage import write_table

WINDOW_WORDS = 20
ANCHOR_WORDS = 6
#: Words whose hash a worker remembers.
REMEMBERED = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of some texts in one array, and where each text begins."""

    def __init__(self, texts: list[bytes]):
        if len(_HASHES) > REMEMBERED:
            _HASHES.clear()
        split = [x.split() for x in texts]
        self.count = np.array([len(x) for x in split], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.count)])
        get = _HASHES.__getitem__
        self.hash = np.fromiter((h for x in split for h in map(get, x)), np.uint64, self.begin[-1])
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        n = len(self.hash)
        self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _ODD))])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * self.power[:n])])
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse))])

    def extent(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words from start to end, wherever they stand."""
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def anchors(words: Words, window: int = WINDOW_WORDS, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """For each anchor: its hash, position, and the first and last window that chose it, as places in the one array."""
    n = len(words.hash)
    if n < window:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    runs = words.extent(np.arange(n - k + 1), np.arange(k, n + 1))
    width, windows = window - k + 1, n - window + 1
    least, chosen = runs[:windows].copy(), np.arange(windows)
    for j in range(1, width):
        here = runs[j : j + windows]
        lower = here <= least
        np.copyto(least, here, where=lower)
        np.copyto(chosen, np.arange(j, j + windows), where=lower)
    whole = np.flatnonzero(words.owner[:windows] == words.owner[window - 1 :])
    picked = chosen[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (words.owner[whole[1:]] != words.owner[whole[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(whole) - 1]]) if len(first) else first
    return runs[picked[first]], picked[first], whole[first], whole[last]


def _occurrences(key: np.ndarray, detail: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """Rows of a slice; those after the first of their key and detail are marked as repeats and get an own key."""
    order = np.lexsort((start, doc, detail, key))
    k, d = key[order], detail[order]
    same = np.zeros(len(order), bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    group = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    at_first = (doc[order] == doc[order][group]) & (start[order] == start[order][group])
    repeat = np.zeros(len(order), bool)
    repeat[order] = same & ~at_first
    spread = _mix(doc.astype(np.uint64) * _ODD + start.astype(np.uint64))
    cols = [np.where(repeat, spread, key).view(np.int64), detail.view(np.int64), doc, tag, start.astype(np.int32), windows.astype(np.int32), repeat]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "detail", "doc", "tag", "start", "windows", "repeat"])


_OCCURRENCE = "key long, detail long, doc long, tag int, start int, windows int, repeat boolean"


def _find_anchors(window: int, k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                words = Words(raw(part))
                key, at, low, high = anchors(words, window, k)
                if not len(key):
                    continue
                own = words.owner[low]
                extent = words.extent(low, high + window) ^ _mix(((at - low) << 32 | (high - low)).astype(np.uint64))
                doc, tag = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                yield _occurrences(key, extent, doc[own], tag[own], low - words.begin[own], high - low + 1)

    return kernel


def _find_windows(window: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                words = Words(raw(part))
                spots = part.column(3).to_pylist()
                rows = [(k, x["key"], x["start"], x["windows"]) for k, found in enumerate(spots) for x in found]
                if not rows:
                    continue
                own, key, start, many = (np.array(x, np.int64) for x in zip(*rows))
                each = np.repeat(np.arange(len(rows)), many)
                step = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                place = start[each] + step
                low = words.begin[own[each]] + place
                doc, tag = (part.column(c).to_numpy(zero_copy_only=False)[own[each]] for c in (0, 1))
                yield _occurrences(words.extent(low, low + window), key[each].view(np.uint64), doc, tag, place, np.ones(len(place), np.int64))

    return kernel


def _judged(found: DataFrame) -> DataFrame:
    """With `later` (an equal extent begins earlier) and `several` (the key has other extents too; only for first ones)."""
    same = Window.partitionBy("key", "detail").orderBy("doc", "start").rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct("doc", "start")
    first = found.repartition("key").withColumn("first", F.first(here).over(same)).withColumn("later", F.col("repeat") | (here > F.col("first")))
    extents = Window.partitionBy("key")
    return first.withColumn("several", ~F.col("later") & (F.min("detail").over(extents) != F.max("detail").over(extents))).drop("first")


def repeats(docs: DataFrame, window: int = WINDOW_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(doc, tag, start, words): stretches of whole windows, each of which also begins earlier. See `keyed` for doc and tag."""
    own = keyed(docs)
    judged = _judged(own.select("doc", "tag", "body").mapInArrow(_renamed(_find_anchors(window, k)), _OCCURRENCE))
    marked = write_table(judged.where("later or several").select("key", "doc", "tag", "start", "windows", "later"), "anchors")
    spots = marked.where("not later").groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "start", "windows")).alias("spots"))
    again = own.join(spots, ["doc", "tag"]).select("doc", "tag", "body", "spots").mapInArrow(_renamed(_find_windows(window)), _OCCURRENCE)
    same = Window.partitionBy("key", "detail").orderBy("doc", "start").rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct("doc", "start")
    single = again.withColumn("first", F.first(here).over(same)).where(F.col("repeat") | (here > F.col("first")))
    return (
        marked.where("later").select("doc", "tag", "start", "windows")
        .unionByName(single.select("doc", "tag", "start", "windows"))
        .select("doc", "tag", "start", (F.col("windows") + window - 1).alias("words"))
    )


def _renamed(kernel):
    """`raw` reads the column named text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kernel(b.rename_columns(["text" if x == "body" else x for x in b.schema.names]) for b in batches)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, body, and what names a row in joins: doc (doc_id, null as the least) and tag (a hash that tells texts of one doc_id apart)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text").cast("string")).alias("body")).withColumns(
        {"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "tag": F.hash("body")}
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, k: int = ANCHOR_WORDS, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and, if asked for, kept (words joined by one space).

    A word goes if a window that covers it also begins earlier: in a smaller doc_id (null is the least), or earlier in the same
    document. Null texts have no words. Rows alike in doc_id and text count as one document, so neither removes the other;
    rows of one doc_id with other texts are ordered by start alone. Other columns are ignored.
    """
    found = repeats(docs, window, k)
    cuts = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "words")).alias("cuts"))
    joined = keyed(docs).join(cuts, ["doc", "tag"], "left").select("doc_id", "body", "cuts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, texts = [], [], [], []
            for text, cut in zip(raw(batch, "body"), batch.column(2).to_pylist()):
                words = text.split()
                kept = words
                if cut:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [x["start"] for x in cut], 1)
                    np.add.at(edge, [x["start"] + x["words"] for x in cut], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                joined_words = b" ".join(kept)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined_words).hexdigest())
                if keep_text:
                    texts.append(joined_words.decode())
            more = [pa.array(texts, pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *more], names=[x.split(" ")[0] for x in schema.split(", ")])

    return joined.mapInArrow(kernel, schema)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, CAST(i AS BIGINT) AS i, array_to_string(words[i:i + 19], ' ') AS k FROM d, unnest(range(1, CAST(greatest(1, len(words) - 18) AS BIGINT))) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, j FROM rep, unnest(range(i, i + 20)) AS t(j)),
word AS (SELECT doc_id, CAST(j AS BIGINT) AS j, words[j] AS w FROM d, unnest(range(1, CAST(len(words) + 1 AS BIGINT))) AS t(j)),
kept AS (SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.j) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
