"""Exact top-k search by tiled matrix products.

Queries are packed into tiles and candidates into shards, both of a fixed number of vectors. Each query tile meets each
shard once; a task multiplies the two matrices, selects the best k of each query within the tile, and the short lists merge
in a tree: first those of the shards that a task sees, then per query over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.llm.common import table
from vellumgrid.storage import write_table

TILE, SHARD = 512, 2048
SCALE = 256


def usable(vector: str = "embedding") -> Column:
    """Neither null nor holding a null or a component that isn't finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & ok, F.lit(False))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(name, ids binary, width, matrix binary): `size` vectors at most, packed within partitions; shorter vectors end in zeros."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors = part.column(1).to_pylist()
                width = max(map(len, vectors))
                matrix = np.zeros((len(vectors), width))
                for k, v in enumerate(vectors):
                    matrix[k, : len(v)] = v
                yield pa.RecordBatch.from_pydict({name: [number], "ids": [part.column(0).to_numpy().astype(np.int64).tobytes()], "width": [width], "matrix": [matrix.tobytes()]}, schema=pa.schema([(name, pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("matrix", pa.binary())]))
                number += 1

    return rows.mapInArrow(kernel, f"{name} long, ids binary, width int, matrix binary")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest finite scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    near = near[np.isfinite(scores[near])]
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50, scale: int = SCALE, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k highest inner products of floor(scale * x) for each query.

    Queries are the rows whose vec_id is divisible by query_step; candidates are all rows with another vec_id, ties to the smaller
    one. Rows with a null id, a null vector, or a component that is null or not finite take no part; where vectors differ in
    length, missing components count as zero. Rows with the same vec_id are not candidates of each other, and a repeated query
    row is asked once; a repeated candidate row counts as often as it stands. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x).alias("embedding")).where(F.col("vec_id").isNotNull() & usable())
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("embedding"))
    queries = rows.where(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id"])
    tiles = _packed(queries, tile, "tile").select("tile", F.col("ids").alias("query_ids"), F.col("width").alias("query_width"), F.col("matrix").alias("query_matrix"))
    shards = _packed(rows, shard, "shard").select("shard", "ids", "width", "matrix")
    # every tile meets every shard: a stated query set against all rows, in blocks; both written once, as each meets many of the other
    pairs = write_table(shards, "shards").crossJoin(write_table(tiles, "tiles"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
            for row in batch.to_pylist():
                q = np.frombuffer(row["query_matrix"]).reshape(-1, row["query_width"]) if row["query_width"] else np.zeros((len(row["query_ids"]) // 8, 0))
                c = np.frombuffer(row["matrix"]).reshape(-1, row["width"]) if row["width"] else np.zeros((len(row["ids"]) // 8, 0))
                width = min(q.shape[1], c.shape[1])
                query_ids, ids = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                scores = q[:, :width] @ c[:, :width].T
                scores[query_ids[:, None] == ids[None, :]] = -np.inf
                for n, query in enumerate(query_ids):
                    best = _best(scores[n], ids, k)
                    out["query_id"].append(np.full(len(best), query))
                    out["vec_id"].append(ids[best])
                    out["score"].append(scores[n][best].astype(np.int64))
            if out["query_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out.values()], names=list(out))

    lists = pairs.select("query_ids", "query_width", "query_matrix", "ids", "width", "matrix").mapInArrow(kernel, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every query; see `top_k`."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
