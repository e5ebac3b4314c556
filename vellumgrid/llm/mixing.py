"""Mixing sources to target weights: every source gives words up to its exact budget.

Documents of a source are put in the order of hash-random keys. The range of keys is divided into buckets; sums of
buckets, then of the rows before a row in its bucket, give each document's distributed prefix sum, so no task ever holds a
source, only a bucket of one. A source's budget is whole epochs of all its documents and a rest, cut where the prefix sum
reaches it: the document there gives its first words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.llm.common import WORD, table, text_of
from vellumgrid.storage import write_table

#: Hexadecimal digits of the random key that name a bucket: 3 make 4,096 buckets of each source.
BUCKET_DIGITS = 3
MOST_EPOCHS = 3
WEIGHTS = (1.0, 2.0, 3.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size): shares of the sum of all sizes.

    Sources in the order of code points, null last, have the weights in turn. A target stops at most_epochs times its
    source's size; what is over goes to the others by weight until none is above. That is min(limit, level * weight) with one
    level: sources sorted by limit / weight stop, first to last, while the level of the rest still exceeds that ratio.
    The rows here are sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    earlier, later = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rest = (F.col("all_words") - F.col("stopped")).cast("double")
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
        .withColumn("limit_words", F.col("source_size") * most_epochs)
        .withColumn("ratio", F.col("limit_words") / F.col("weight"))
        .withColumns({
            "all_words": F.sum("source_size").over(everything),
            "stopped": F.coalesce(F.sum("limit_words").over(earlier), F.lit(0)),
            "open_weight": F.sum("weight").over(later),
        })
        .withColumn("stops", F.col("ratio") * F.col("open_weight") < rest)
        .withColumns({
            "level_rest": F.coalesce(F.max(F.when(~F.col("stops"), rest)).over(everything), F.lit(0.0)),
            "level_weight": F.coalesce(F.max(F.when(~F.col("stops"), F.col("open_weight"))).over(everything), F.lit(1.0)),
        })
        .select("source", "source_size", F.when(F.col("stops"), F.col("limit_words").cast("double")).otherwise(F.col("level_rest") * F.col("weight") / F.col("level_weight")).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "", also: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    A null text has size 0 and gives nothing; a null source is a source of its own, the last; a null doc_id keys as the empty
    text; rows that repeat each count. Keys are md5 of seed and doc_id, ties go by doc_id, then size; rows alike in both are
    interchangeable. Other columns are ignored; `also` names columns over docs to hand through.
    """
    more = also or {}
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = write_table(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), *(c.alias(k) for k, c in more.items())), "sizes")
    targets = write_table(source_targets(sizes, weights, most_epochs), "targets")
    keyed = sizes.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
        .withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_before", "source_size", "target")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    prefix = F.col("bucket_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return (
        keyed.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("prefix", prefix)
        .withColumn("taken", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("prefix")))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", *more)
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS weight
  FROM sized GROUP BY source),
ratios AS (SELECT *, source_size * 3 AS limit_words, CAST(source_size * 3 AS DOUBLE) / weight AS ratio FROM sources),
sums AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_words,
         CAST(coalesce(sum(limit_words) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stopped,
         sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM ratios),
stopping AS (SELECT *, CAST(all_words - stopped AS DOUBLE) AS rest, ratio * open_weight < CAST(all_words - stopped AS DOUBLE) AS stops FROM sums),
levels AS (
  SELECT *, coalesce(max(CASE WHEN NOT stops THEN rest END) OVER (), 0.0) AS level_rest,
         coalesce(max(CASE WHEN NOT stops THEN open_weight END) OVER (), 1.0) AS level_weight
  FROM stopping),
targets AS (
  SELECT source, source_size, CASE WHEN stops THEN CAST(limit_words AS DOUBLE) ELSE CAST(level_rest AS DOUBLE) * weight / level_weight END AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)) AS BIGINT) AS taken
FROM cut
"""
