"""Growth of ordered seeds over a mask, in the order of one queue over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.storage import write_table

#: The order in which a cell's neighbours join the queue, as (row, column) steps.
QUEUE_STEPS = ((0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, 1), (1, -1), (-1, -1))


def queue_growth(seeds: DataFrame, mask: DataFrame, layers: int, key: str = "img") -> DataFrame:
    """(key, r, c, source, layer): seeds (key, source, pos, r, c) grow over mask cells; a cell belongs to what reaches it first.

    One queue takes all seeds by (source, pos); a cell taken from it that is in the mask and not owned yet is owned, and its
    neighbours join the queue. The seeds are layer 0, of `layers` altogether. Instead of a queue every entry has a key: its seed's place,
    then one digit for each step from it. Of entries of one layer the smaller key comes first, so a layer is one grouped minimum over its
    front, however large the images. Seeds off the mask own nothing and don't spread; mask cells that repeat count once.
    """
    free = mask.select(F.col(key).alias("_k"), F.col("r").cast("int").alias("_r"), F.col("c").cast("int").alias("_c")).distinct()
    digits = lambda x: F.lpad(x.cast("string"), 19, "0")
    entries = seeds.select(key, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("source"), F.concat(digits(F.col("source").cast("long")), digits(F.col("pos").cast("long"))).alias("place"))
    owned = None
    for layer in range(layers):
        inside = entries.join(free, (F.col(key) == F.col("_k")) & (F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c")), "left_semi")
        fresh = inside if owned is None else inside.join(owned, [key, "r", "c"], "left_anti")
        first = fresh.groupBy(key, "r", "c").agg(F.min(F.struct("place", "source")).alias("f"))
        front = write_table(first.select(key, "r", "c", "f.source", "f.place", F.lit(layer).alias("layer")), "front")
        if not front.limit(1).count():
            break
        owned = front if owned is None else owned.unionByName(front)
        steps = F.array(*(F.struct(F.lit(str(k)).alias("k"), (F.col("r") + dr).alias("nr"), (F.col("c") + dc).alias("nc")) for k, (dr, dc) in enumerate(QUEUE_STEPS)))
        entries = front.select(key, "source", "place", F.inline(steps)).select(key, F.col("nr").alias("r"), F.col("nc").alias("c"), "source", F.concat("place", "k").alias("place"))
    if owned is None:
        return entries.select(key, "r", "c", "source", F.lit(0).alias("layer")).where(F.lit(False))
    return owned.select(key, "r", "c", "source", "layer")
