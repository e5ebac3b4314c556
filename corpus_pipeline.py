"""A corpus from raw documents to tokens: toxic documents go, near-duplicates leave one, secrets are masked, sources are mixed, tokens follow.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import bpe, mixing, near_copies, secret_scan, toxicity
from vellumgrid.llm.common import table, text_of
from vellumgrid.storage import write_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half, by a scorer fitted on the labels of these documents."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.trains)
    return toxicity.score(docs, scorer).where(F.col("score") < 0.5).select(*COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Of a component stays the row with the smallest doc_id; rows without one come last, and stay where none of the others has one.
    """
    return near_copies.one_of_each(docs.select(*COLUMNS))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by a mark."""
    text = secret_scan.redact(F.col("text"), F.col("found"))
    return secret_scan.scan(docs).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; the one at a source's budget also with its first words only.

    Rows alike in doc_id and text are taken as often as the one of them that is taken most.
    """
    tag = F.xxhash64(text_of())
    taken = mixing.mix(docs, also={"tag": tag}).groupBy(F.col("doc_id").alias("d"), "tag").agg(F.max("size").alias("size"), F.max("taken").alias("taken")).where(F.col("taken") > 0)
    joined = docs.withColumn("tag", tag).join(taken, ["tag"]).where(F.col("doc_id").eqNullSafe(F.col("d")))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    # pieces: each word with the white space after it, and before them white space at the very start
    pieces = F.split(text_of(), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    leading = F.when(text_of().rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.when(words < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), words + leading), "")).otherwise(F.col("text"))
    return copies.withColumn("text", cut).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("secrets", secrets_masked),
    ("mixing", mixed),
    ("encoding", encoded),
]
#: Neither fitted scores nor byte-pair tokens are expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
