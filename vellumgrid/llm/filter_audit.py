"""What a chain of filters removes in every order, by adjacent-transposition enumeration.

A document is reduced to a mask, one bit for each filter that it fails. Documents of a part with the same mask behave alike in
every order, so a part is a row of 2^filters cells of counts, however many documents it has. Orders are visited so that each comes
from the one before by a swap of two neighbours: what filters before and after the pair remove is unchanged, and only the two
steps of the pair are counted again from the cells. Shapley sums of removals are kept up along the same walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.llm.common import table, text_of, words_of

#: More filters than this make more orders than anybody reads (8! is 40,320 rows of steps for each part).
MOST_FILTERS = 8
#: Parts that one walk takes together.
PARTS = 256
#: Salts over which rows without an id are dealt, so that they don't meet in one task.
SALTS = 4096


def contract_rules() -> dict[str, Column]:
    """Failure conditions A to D over columns `text` and `words`: short, repetitive, shouting, with symbols."""
    words = F.col("words")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    capitals = F.length(text_of()) - F.length(F.translate(text_of(), letters, ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": capitals * 100 > F.length(text_of()) * 5,
        "D": text_of().rlike(r"[#$%&*|]"),
    }


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places k whose swap with k + 1 leads from 0..n-1 through all n! orders, each once (plain changes)."""
    order, ways = list(range(n)), [-1] * n
    place = list(range(n))
    while True:
        # the largest item that can still go its way past a smaller one
        for item in range(n - 1, -1, -1):
            at, to = place[item], place[item] + ways[item]
            if 0 <= to < n and order[to] < item:
                break
        else:
            return
        other = order[to]
        order[at], order[to] = other, item
        place[item], place[other] = to, at
        for larger in range(item + 1, n):
            ways[larger] = -ways[larger]
        yield min(at, to)


def walk(cells: np.ndarray, n: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Every order of n filters with what its steps remove: counts[part, step, measure].

    cells[part, mask, measure] counts documents by the filters they fail (bit f of mask: filter f). The array yielded is
    changed by the next step of the walk.
    """
    masks = np.arange(1 << n)

    def removed(before: int, f: int) -> np.ndarray:
        return cells[:, (masks & before == 0) & (masks >> f & 1 == 1)].sum(axis=1)

    order = list(range(n))
    steps = np.zeros((len(cells), n, cells.shape[2]), cells.dtype)
    before = 0
    for k in order:
        steps[:, k] = removed(before, k)
        before |= 1 << k
    yield tuple(order), steps
    for k in adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        before = sum(1 << f for f in order[:k])
        steps[:, k] = removed(before, order[k])
        steps[:, k + 1] = removed(before | 1 << order[k], order[k + 1])
        yield tuple(order), steps


def failure_cells(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], copies: str | None = None, part: Column | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, bit k for the k-th rule.

    docs: doc_id, text, source (unless `part` names another part) and what the rules read. rules: failure conditions; null counts as passed. copies: the letter of a last filter, failed by a
    document whose text equals that of any with a smaller doc_id, in whichever part. Texts are compared by SHA-256, null as
    empty. A row without doc_id is a copy of none and has no label; rows that repeat each count. A doc_id labelled twice is good
    or toxic if it is once. Other columns of both tables are ignored.

    Rows alike in part, text and id are counted before anything is shuffled; copies in one part meet as one row, so a text that a third
    of all documents share is a row for each part.
    """
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(rules.values())), F.lit(0))
    own_part = F.coalesce((F.col("source") if part is None else part).cast("string"), F.lit(""))
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), own_part.alias("part"), mask.cast("int").alias("mask"),
        F.unhex(F.sha2(text_of(F.col("text").cast("string")).cast("binary"), 256)).alias("digest"),
    ).withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(F.lit(-1)))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("salt")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long")
    marked = facts.join(marks, ["doc_id", "salt"], "left").select("doc_id", "part", "mask", "digest", zero("good").alias("good"), zero("toxic").alias("toxic"))
    if copies is None:
        return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # of each text and part: all rows, and those of the smallest id
    by_id = marked.groupBy("digest", "part", "mask", "doc_id").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    own = F.struct(*(F.col(c) for c in ("n", "good", "toxic")))
    nameless = F.col("doc_id").isNull()
    by_part = by_id.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"),
        F.min("doc_id").alias("first"), F.min_by(own, "doc_id").alias("of_first"), F.coalesce(F.sum(F.when(nameless, F.col("n"))), F.lit(0)).alias("nameless"),
    )
    # the smallest id of a text over all parts: rows here are texts by parts, no documents
    placed = by_part.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    leads = F.coalesce(F.col("first") == F.col("least"), F.lit(False))
    clean = {"n": F.when(leads, F.col("of_first.n")).otherwise(0) + F.col("nameless")} | {c: F.when(leads, F.col(f"of_first.{c}")).otherwise(0) for c in ("good", "toxic")}
    both = F.array(
        F.struct(F.col("mask"), *(clean[c].cast("long").alias(c) for c in ("n", "good", "toxic"))),
        F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), *((F.col(c) - clean[c]).cast("long").alias(c) for c in ("n", "good", "toxic"))),
    )
    return placed.select("part", F.inline(both)).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    cells: (part, mask, n, good, toxic), see `failure_cells`; cells that are missing are empty, cells that repeat add up. letters names
    filters by bit. An empty table gives no row; one without documents of some mask gives zeros.
    """
    n = len(letters)
    if not 0 < n <= MOST_FILTERS or len(set(letters)) != n:
        raise ValueError(f"1 to {MOST_FILTERS} filters with a letter each")
    counts = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # 2^filters at most
    summed = cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names)

    def report(parts: list[str], held: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(parts), 1 << n, 3), np.int64)
        for k, row in enumerate(held):
            for c in row:
                table[k, c["mask"]] += (c["n"], c["good"], c["toxic"])
        fails = np.stack([table[:, np.arange(1 << n) >> f & 1 == 1, 0].sum(axis=1) for f in range(n)], axis=1)
        unique = np.stack([table[:, 1 << f, 0] for f in range(n)], axis=1)
        everything = table[:, :, 0].sum(axis=1)
        shapley = np.zeros((len(parts), n), np.int64)
        for order, steps in walk(table, n):
            shapley[:, list(order)] += steps[:, :, 0]
        names_of, step_of = pa.array(np.repeat(np.array(parts, object), n), pa.string()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(parts)))
        for order, steps in walk(table, n):
            at = list(order)
            removed = steps[:, :, 0]
            columns = (everything[:, None] - np.cumsum(removed, axis=1), removed, fails[:, at] - removed, unique[:, at], steps[:, :, 1], steps[:, :, 2], shapley[:, at])
            of_order = pa.array(["".join(letters[f] for f in order)] * (n * len(parts)))
            yield pa.RecordBatch.from_arrays([names_of, of_order, step_of, *(pa.array(c.ravel().copy()) for c in columns)], names=["part", "filter_order", "step", *names])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                part = batch.slice(at, PARTS)
                yield from report(part.column(0).to_pylist(), part.column(1).to_pylist())

    return summed.groupBy("part").agg(counts.alias("cells")).mapInArrow(kernel, schema)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over whole documents, by source; see `failure_cells` and `audit`.

    Null texts are empty, null sources the part ''. A null doc_id fails E never.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", words_of().alias("words"))
    cells = failure_cells(docs, table(spark, sf_dir, "labels"), contract_rules(), copies="E")
    return audit(cells, "ABCDE")


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         len(words) < 50 AS fa, 100 * len(list_distinct(words)) < 65 * len(words) AS fb,
         100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 5 * length(t.text) AS fc,
         regexp_matches(t.text, '[#$%&*|]') AS fd, coalesce(f.least < t.doc_id, false) AS fe
  FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN marks m ON m.doc_id = t.doc_id),
cells AS (
  SELECT part, concat(CASE WHEN fa THEN 'A' ELSE '' END, CASE WHEN fb THEN 'B' ELSE '' END, CASE WHEN fc THEN 'C' ELSE '' END,
                      CASE WHEN fd THEN 'D' ELSE '' END, CASE WHEN fe THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
hits AS (
  SELECT c.part, s.filter_order, s.step, s.f, contains(c.failed, s.f) AS fails, c.failed = s.f AS alone,
         len(list_intersect(string_split(s.earlier, ''), string_split(c.failed, ''))) > 0 AND s.earlier <> '' AND c.failed <> '' AS gone, c.n, c.good, c.toxic
  FROM cells c, steps s),
counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM hits GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
