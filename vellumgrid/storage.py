"""Shared intermediate tables: lineage is cut by writing Parquet where all executors can read it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one if driver and executors are one process.

    Raises on a cluster without the setting: a folder of the driver's machine would be another one on each executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="vellumgrid-")
    return _LOCAL[app]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return it as read back: a replayable table without lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vellumgrid-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """`df` for the right side of a join that a loop makes again and again, or whose size Spark takes for too small (after an explode, or
    with columns that repeat in a file): dealt by its key, never sent whole through the driver, which would hold a copy for each round."""
    return df.hint("merge")
