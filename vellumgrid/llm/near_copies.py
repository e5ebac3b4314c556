"""The SimHash operator at a Jaccard similarity of word shingles: fingerprints and pigeonring filtering, each link confirmed on whole sets.

At 0.8, fingerprints of 64 bits differ in 10 bits on average and seldom in over 20. A ring that allows so many has no segment that
could be a join key. So links come in two steps. Very near texts are those that `simhash.near_links` finds by its own keys.
For the others, keys are bands of min-hashes, and the distance of fingerprints (at most MOST_DIFFERENCE bits, five standard deviations
above the mean at 0.8) prunes candidates before their texts are read. Chains of the ring would say the same of a pair as its whole
distance, since some start always passes if that is within bounds; they serve to find pairs, not to test them.

Texts with equal words are one node before anything is joined. A node has 40 band keys of five min-hashes each; two nodes of
similarity s share none with a chance of (1 - s^5)^40, which is 1.3e-7 at 0.8 and less above. Nodes that share a key are first
confirmed against the smallest and the largest node of that key, so a group of copies becomes one component without a list of
its pairs; then pairs of a key that are still in different components are confirmed. Pairs inside a component can't change it, and
those of a key's largest component are never made.

Every candidate first meets a bound that is exact: a node's sketch has the parity of its number of shingles in each of 1,024 cells, and
two sketches differ in no more cells than the sets differ in shingles. Texts that are half alike share many keys, so without it their
pairs would grow with the square of their number. It rules out nearly all pairs under 0.75 up to some 1,000 shingles a text, and none
from 2,300 shingles on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm import simhash
from vellumgrid.llm.common import raw, slices
from vellumgrid.operators.components import connected_components
from vellumgrid.storage import dealt as by_key
from vellumgrid.storage import write_table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
#: Bits in which fingerprints of a candidate pair may differ.
MOST_DIFFERENCE = 24
SEED = simhash.SEED
#: Longs of a sketch.
SKETCH = 16
#: Shingles met by all min-hashes at a time.
BLOCK = 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D separate


def shingles(words: list[bytes], words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, an empty one has none."""
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    k = min(words_per_shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - k]]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :])], "<u8"))


def band_keys(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, (found[at : at + BLOCK] * _FACTORS).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of 64 * SKETCH cells, as longs."""
    odd = np.bincount((found & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def may_reach(x: Column, y: Column, n: Column, m: Column, least: float) -> Column:
    """Whether sets of n and m hashes with these sketches can have a similarity of `least` or more; never false for those that have."""
    odd = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, SKETCH)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return odd <= (n + m) * ((1 - least) / (1 + least)) + F.lit(1e-6)


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of hashes, each sorted and distinct."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles; 0 if it is empty."""
    votes = simhash.Votes()
    for at in range(0, len(found), simhash.BLOCK):
        votes.add(found[at : at + simhash.BLOCK])
    return votes.fingerprint()


def _described(docs: DataFrame) -> DataFrame:
    """row of docs with node, n (distinct shingles), fp, keys and sketch; an empty text has no key, as it only equals empty ones."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [words_of(x) for x in raw(part)]
                sets = [shingles(w) for w in texts]
                nodes, fps = (np.array(x, np.uint64).view(np.int64) for x in ([xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in texts], list(map(fingerprint, sets))))
                keys = pa.array([band_keys(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
                sketches = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), keys, sketches], names=["row", "node", "n", "fp", "keys", "sketch"])

    return docs.select("row", F.col("text").cast("string").alias("text")).mapInArrow(kernel, "row long, node long, n int, fp long, keys array<long>, sketch array<long>")


def _reaching(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of nodes that their sketches don't rule out."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "uv")
    return pairs.join(a, "u").join(b, "v").where(may_reach(F.col("u_sketch"), F.col("v_sketch"), F.col("u_n"), F.col("v_n"), least)).select("u", "v")


def _confirmed(pairs: DataFrame, rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose similarity is `least` or more. texts: node, row of one text of each node."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(words_of(x)).tobytes() for x in raw(part)], pa.binary())], names=["node", "shingles"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(a, b) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    wanted = by_key(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()).join(texts, "node").select("row", "node")
    held = write_table(rows.select("row", F.col("text").cast("string").alias("text")).join(wanted, "row").select("node", "text").mapInArrow(sets, "node long, shingles binary"), "shingles")
    a, b = (held.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "uv")
    return write_table(pairs.join(a, "u").join(b, "v").select("u", "v", "u_set", "v_set").mapInArrow(kernel, "u long, v long"), "confirmed")


def _placed(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """docs as a table with row (distinct), and (row, component)."""
    names = _own(docs)
    rows = write_table(docs.select(*(F.col(f"`{c}`") for c in names)).withColumn("row", F.monotonically_increasing_id()), "rows")
    described = write_table(_described(rows), "described")
    nodes = write_table(described.groupBy("node").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch"))), "nodes")
    texts = nodes.select("node", "row")

    # very near texts: by fingerprint, one node for each
    of_fp = write_table(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    end = lambda x: of_fp.select(F.col("fp").alias(x), F.col("node").alias(f"{x}_node"))
    ring = simhash.near_links(of_fp.select("fp")).distinct().join(end("u"), "u").join(end("v"), "v").select("u_node", "v_node")
    alike = nodes.where("n > 0").join(of_fp.withColumnRenamed("node", "v_node"), "fp").where("node <> v_node").select(F.col("node").alias("u_node"), "v_node")
    very_near = ring.unionByName(alike).select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))

    # the others: by bands, pruned by size, by the distance of fingerprints and by sketches
    buckets = nodes.select("node", "n", "fp", F.explode("keys").alias("key"))
    whole = F.struct("node", "n", "fp")
    ends = buckets.groupBy("key").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).where("low.node < high.node")
    shared = write_table(buckets.join(by_key(ends), "key"), "shared")

    close = (F.least("n", "m") >= F.greatest("n", "m") * (least - 1e-9)) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("gp"))) <= MOST_DIFFERENCE)
    to_ends = shared.select("node", "n", "fp", F.explode(F.array("low", "high")).alias("end")).select("node", "n", "fp", F.col("end.node").alias("end"), F.col("end.n").alias("m"), F.col("end.fp").alias("gp"))
    first = to_ends.where("node <> end").where(close).select(F.least("node", "end").alias("u"), F.greatest("node", "end").alias("v"))
    tried = write_table(_reaching(very_near.unionByName(first).distinct(), nodes, least), "tried")
    links = _confirmed(tried, rows, texts, least)
    found = connected_components(links, "near")

    placed = write_table(shared.select("key", "node", "n", "fp").join(by_key(found), "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    in_key = placed.groupBy("key", "component").agg(F.count("*").alias("nodes"))
    largest = in_key.groupBy("key").agg(F.max(F.struct("nodes", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.component").alias("top"))
    open_ = write_table(placed.join(largest, "key").withColumn("main", F.col("component") == F.col("top")).join(nodes.select("node", "sketch"), "node"), "open")
    a = open_.select("key", F.col("node").alias("a"), "n", "fp", "sketch", F.col("component").alias("ca"), F.col("main").alias("main_a"))
    b = open_.where("not main").select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("fp").alias("gp"), F.col("sketch").alias("other"), F.col("component").alias("cb"))
    reaching = may_reach(F.col("sketch"), F.col("other"), F.col("n"), F.col("m"), least)
    crossing = a.join(by_key(b), "key").where("ca <> cb and (main_a or ca < cb)").where(close).where(reaching).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    rest = write_table(crossing.join(tried, ["u", "v"], "left_anti"), "rest")
    found = connected_components(links.unionByName(_confirmed(rest, rows, texts, least)), "near")
    return rows, described.select("row", "node").join(found, "node", "left").select("row", F.coalesce("component", "node").alias("component"))


def _own(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("row", "component")]


def with_components(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """All columns of docs with row (distinct) and component: rows linked over similarities of `least` or more share one.

    A null text counts as empty; all empty texts are copies of each other, and so are texts that differ in case (A-Z) or white space
    only. Repeated rows stay repeated. Input columns named row or component are replaced.
    """
    rows, by_row = _placed(docs, least)
    return rows.join(by_row, "row").select(*(F.col(f"`{c}`") for c in _own(docs)), "row", "component")


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each component, as it was: the one with the smallest doc_id (none comes last), then by a hash of the row.

    Rows with a null or repeated doc_id are rows like any other. Columns named row or component aren't returned.
    """
    rows, by_row = _placed(docs, least)
    own = _own(docs)
    # the order of a row goes to its component, its text stays where it is
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*(F.col(f"`{c}`") for c in own)), "row")
    kept = rows.select("row", order.alias("order")).join(by_row, "row").groupBy("component").agg(F.min("order").alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*(F.col(f"`{c}`") for c in own))
