"""Decoding, alignment, word lists, labels, ids and splits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import arrays as a
from vellumgrid.storage import write_table

#: What stands for no character in an alignment, and the alphabet of class numbers.
EMPTY = "%"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"


def ctc_text(classes: Column, alphabet: str = ALPHABET) -> Column:
    """Blanks and repeats dropped, the rest as letters."""
    return a.letters(a.collapse(classes), alphabet)


def align(observed: str, intended: str, costs: dict[tuple[str, str], float] | None = None) -> tuple[float, list[tuple[str, str]]]:
    """Least cost and pairs (observed, intended) of an alignment; ties go to insertion, then deletion, then substitution.

    costs: conditional probabilities of pairs; a step costs 1 less its probability, equal characters nothing. None: unit costs.
    """
    cols = len(observed) + 1
    p = (lambda x, y: costs.get((x, y), 0.0)) if costs is not None else (lambda x, y: 0.0)
    insert = [p(x, EMPTY) for x in observed]
    above = [0.0]
    for x in insert:
        above.append(above[-1] + 1 - x)
    steps = ["i" * cols]
    for y in intended:
        delete = p(EMPTY, y)
        change = {x: 0.0 if x == y else 1 - p(x, y) for x in set(observed)}
        left, corner = above[0] + 1 - delete, above[0]
        row, step = [left], ["d"]
        for x, more, up in zip(observed, insert, above[1:]):
            by_insert, by_delete, by_change = left + 1 - more, up + 1 - delete, corner + change[x]
            if by_insert <= by_delete and by_insert <= by_change:
                left = by_insert
                step.append("i")
            elif by_delete <= by_change:
                left = by_delete
                step.append("d")
            else:
                left = by_change
                step.append("s")
            row.append(left)
            corner = up
        above = row
        steps.append("".join(step))
    pairs, i, j = [], len(intended), len(observed)
    while i or j:
        way = steps[i][j]
        pairs.append((EMPTY if way == "d" else observed[j - 1], EMPTY if way == "i" else intended[i - 1]))
        i, j = i - (way != "i"), j - (way != "d")
    return above[-1], pairs[::-1]


def alignments(pairs: DataFrame, costs: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Adds cost and steps (array of o, i) to rows (observed, intended); null counts as empty."""
    schema = pairs.drop("cost", "steps").withColumns({"cost": F.lit(0.0), "steps": F.array().cast("array<struct<o:string,i:string>>")}).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = list(zip(batch.column("observed").to_pylist(), batch.column("intended").to_pylist()))
            # words that repeat in a batch are aligned once
            known = {w: align(w[0] or "", w[1] or "", costs) for w in set(words)}
            found = [known[w] for w in words]
            ends = np.cumsum([0, *(len(s) for _, s in found)])
            o, i = (pa.array([pair[k] for _, s in found for pair in s], pa.string()) for k in (0, 1))
            steps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([o, i], names=["o", "i"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(c) for c, _ in found]), steps], names=[*batch.schema.names, "cost", "steps"])

    return pairs.drop("cost", "steps").mapInArrow(kernel, schema)


def tally(aligned: DataFrame, times: str | None = None) -> DataFrame:
    """(o, i, n): how often each pair of characters was aligned; times: a column that says how often a row counts."""
    n = F.count("*") if times is None else F.sum("t")
    return aligned.select((F.lit(1) if times is None else F.col(times)).alias("t"), F.explode("steps").alias("s")).groupBy("s.o", "s.i").agg(n.cast("long").alias("n"))


def conditional(counts: DataFrame) -> DataFrame:
    """Adds p: share of a pair among those with the same intended character."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i")))


def train_costs(pairs: DataFrame, most_rounds: int | None = None) -> tuple[DataFrame, int]:
    """Align, count, align with the new costs, until no count changes. Returns (o, i, n, p) and the number of rounds.

    Pairs that repeat are aligned once and counted as often as they stand. Raises if counts still change after most_rounds, or come back
    to those of an earlier round other than the last, as they would then go round for ever. The cost table has a row for each pair of
    characters, so the driver holds it whole.
    """
    distinct = write_table(pairs.groupBy("observed", "intended").agg(F.count("*").alias("times")), "pairs")
    costs, before, seen = None, None, set()
    for number in count(1) if most_rounds is None else range(1, most_rounds + 1):
        now = conditional(tally(alignments(distinct, costs), "times"))
        rows = sorted(now.collect())
        found = tuple((r["o"], r["i"], r["n"]) for r in rows)
        if found == before:
            return pairs.sparkSession.createDataFrame([tuple(r) for r in rows], now.schema), number
        if hash(found) in seen:
            break
        seen.add(hash(found))
        before, costs = found, {(r["o"], r["i"]): r["p"] for r in rows}
    raise ValueError(f"costs did not settle in {number} rounds")


def close_key_mass(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """(letter, close, all): typos of a letter that hit a neighbouring key, and all of them; null share without typos.

    keys: letter, near.
    """
    typos = counts.where((F.col("o") != F.col("i")) & (F.col("o") != EMPTY) & (F.col("i") != EMPTY))
    hit = typos.join(keys.select(F.col("letter").alias("i"), F.col("near").alias("o"), F.lit(1).alias("hit")), ["i", "o"], "left")
    return hit.groupBy(F.col("i").alias("letter")).agg(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("close"), F.sum("n").alias("typos")).withColumn("share", F.try_divide(F.col("close"), F.col("typos")))


def word_list(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n): words of letters only, without accents, in upper case."""
    words = texts.select(F.explode(F.split(column, r"[\x20\x09-\x0D]+")).alias("w")).where(F.col("w").rlike(r"^\p{L}+$"))

    @F.pandas_udf("string")
    def plain(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFD").str.replace("[\u0300-\u036f]", "", regex=True).str.upper()

    # accents go from distinct words only
    counted = words.groupBy("w").agg(F.count("*").alias("n"))
    return counted.select(plain("w").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def dense_ids(df: DataFrame, *order: Column | str, buckets: int = 1024) -> DataFrame:
    """Adds sample_id from 1 without a gap in a total order, and its keys.

    Ids come from counts of ranges, then row numbers within them, so no task holds all rows.
    """
    ranged = df.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id())
    from vellumgrid.storage import write_table

    held = write_table(ranged, "ranges")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    keyed = held.join(F.broadcast(before), "_part").withColumn("sample_id", number.cast("long"))  # a row for each range
    return keyed.withColumn("image_key", F.format_string("image-%09d", "sample_id")).withColumn("label_key", F.format_string("label-%09d", "sample_id")).drop("_part", "_before")


def merge_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, label): two maps as one, the second's label where both have the key."""
    both = first.select("key", "label", F.lit(0).alias("k")).unionByName(second.select("key", "label", F.lit(1).alias("k")))
    return both.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("label"))


def split_by_position(df: DataFrame, order: str, shares: tuple[int, ...] = (70, 15, 15), names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Adds part: by position in a total order, cut at the truncated cumulative percentages."""
    ids = dense_ids(df, order, buckets=64)
    n = ids.count()
    ends = [n * sum(shares[: k + 1]) // 100 for k in range(len(shares) - 1)]
    part = F.lit(names[-1])
    for end, name in reversed(list(zip(ends, names))):
        part = F.when(F.col("sample_id") <= end, name).otherwise(part)
    return ids.withColumn("part", part).drop("image_key", "label_key")


def draw(df: DataFrame, at: Column, weights: DataFrame) -> DataFrame:
    """Adds value: the one whose range of cumulative weights holds `at` (0 to 1). weights: value, weight; a small table."""
    w = Window.orderBy("value")
    total = Window.partitionBy(F.lit(1))
    ranges = weights.withColumn("high", F.sum("weight").over(w) / F.sum("weight").over(total)).withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0.0)))
    return df.withColumn("_at", at).join(F.broadcast(ranges), (F.col("_at") >= F.col("low")) & (F.col("_at") < F.col("high")), "left").drop("_at", "low", "high", "weight")
