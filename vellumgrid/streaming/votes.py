"""Votes and accuracy over a stream of recognised characters; batch and stream use the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_votes(events: DataFrame, time: str = "ts", key: str = "user_id", kind: str = "event_type", up: str = "click", down: str = "view", length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, key, votes, flipped): per window and key, votes for upside down less those for upright. Rows later than `late` behind the
    newest are dropped by a stream and kept by a batch."""
    vote = F.sum(F.when(F.col(kind) == down, 1).when(F.col(kind) == up, -1).otherwise(0))
    counted = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length).alias("w"), F.col(key)).agg(vote.cast("long").alias("votes"))
    return counted.select(F.col("w.start").alias("start"), key, "votes", (F.col("votes") > 0).alias("flipped"))
