"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint of 64 bits is cut into a ring of five segments. If two fingerprints differ in at most four bits,
some start on the ring has every chain of its consecutive segments within a proportional budget: the first l segments
differ in at most l * 4 / 5 bits together. So the first segment is equal, the second differs in at most one bit and the third
in what is left of two; these three segments are the key of an equi-join, whose sides list single-bit changes. All chains and
then the whole distance are residual conditions of that join, so what fails them never leaves it.

Equal fingerprints are one node before the join, and links join nodes by contraction, never by listing a group's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.common import raw, slices, table
from vellumgrid.operators.components import connected_components
from vellumgrid.storage import dealt as by_key
from vellumgrid.storage import write_table

BITS = 64
SHINGLE_WORDS = 4
MAX_DIFFERENCE = 4
SEED = 42
#: Shingles hashed at a time, so that one very long text needs no more memory than many short ones.
BLOCK = 1 << 15


class Votes:
    """Bits of hashes, counted in blocks; the fingerprint has a bit that over half of them have."""

    def __init__(self) -> None:
        self.ones, self.n = np.zeros(BITS, np.int64), 0

    def add(self, hashes: np.ndarray) -> None:
        self.ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        self.n += len(hashes)

    def fingerprint(self) -> int:
        return int(np.packbits(2 * self.ones > self.n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text; 0 if it has no word."""
    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D separate
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(words_per_shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - k]]
    hash_of, votes = xxhash.xxh64_intdigest, Votes()
    for at in range(0, len(starts), BLOCK):
        votes.add(np.array([hash_of(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at + k - 1 : at + BLOCK + k - 1])], "<u8"))
    return votes.fingerprint()


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) for every row; a null text counts as empty and has fingerprint 0."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(x, words_per_shingle) for x in raw(part)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, "doc_id long, fp long")


def segments(parts: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment of the ring, as even as can be."""
    base, more = divmod(bits, parts)
    widths = [base + (k < more) for k in range(parts)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _chain_mask(ring: list[tuple[int, int]], start: int, length: int) -> int:
    return _signed(sum(((1 << w) - 1) << low for low, w in (ring[(start + j) % len(ring)] for j in range(length))))


def near_links(nodes: DataFrame, max_difference: int = MAX_DIFFERENCE) -> DataFrame:
    """Links (u, v), u < v, between distinct fingerprints `fp` that differ in 1 to `max_difference` bits; a link may repeat.

    The ring has max_difference + 1 segments, so a chain of l segments may differ in l * max_difference // parts bits: 0 for the first,
    at most 1 for the first two and 2 for the first three. These three are the key (38 bits of 64): one side lists the changes
    of a bit in the second segment, the other those in the third, and a change that the key has room for but that meets both
    ways is told apart by the residual conditions. The join goes by key: Spark sizes rows before an explode, a hundredth of what it makes.
    """
    parts = max_difference + 1
    ring = segments(parts)
    fp = F.col("fp")
    index_keys, probe_keys = [], []
    for k in range(parts):
        (low, width), (second_low, second_width), (third_low, third_width) = (ring[(k + j) % parts] for j in range(3))
        head = F.shiftleft(_segment(fp, low, width), second_width + third_width)
        key = head.bitwiseOR(F.shiftleft(_segment(fp, second_low, second_width), third_width)).bitwiseOR(_segment(fp, third_low, third_width))
        key = key.bitwiseOR(F.lit(k << 56))
        ours = [0, *(1 << (third_width + b) for b in range(second_width)), *(1 << b for b in range(third_width))]
        index_keys += [key.bitwiseXOR(F.lit(c)) for c in ([0, *(1 << b for b in range(third_width))] if max_difference > 1 else [0])]
        probe_keys += [key.bitwiseXOR(F.lit(c)) for c in (ours if 2 * max_difference // parts else [0])]
    # few rows make many, so the work is dealt out first, over a set number of partitions that small bytes don't make fewer
    dealt = nodes.select(fp).repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = dealt.select(fp.alias("v"), F.explode(F.array(*index_keys)).alias("key"))
    probe = dealt.select(fp.alias("u"), F.explode(F.array(*probe_keys)).alias("key"))
    differs = F.col("u").bitwiseXOR(F.col("v"))
    start = F.shiftrightunsigned(F.col("key"), 56).cast("int")
    within = F.bit_count(differs) <= max_difference
    for length in range(1, parts):
        mask = F.element_at(F.array(*(F.lit(_chain_mask(ring, k, length)) for k in range(parts))), start + 1)
        within &= F.bit_count(differs.bitwiseAND(mask)) <= length * max_difference // parts
    return probe.join(by_key(index), "key").where((F.col("u") < F.col("v")) & within).select("u", "v")


def near_duplicates(docs: DataFrame, max_difference: int = MAX_DIFFERENCE, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Null and empty texts have fingerprint zero and are linked like any other; rows that repeat stay repeated and share a
    component; a null doc_id keeps its row and never names a component unless all of it is null. Other columns are ignored.
    """
    rows = write_table(fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected_components(near_links(nodes, max_difference), "near")
    # both as tables, so that Spark may split the rows of a large component among tasks
    rooted = write_table(nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "rooted")
    named = write_table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    labels = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
