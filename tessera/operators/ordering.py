"""Row numbers and neighbour windows over a total order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import materialize


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Add consecutive numbers from 1 in the order of ``order``, whose values must be distinct rows.

    Rows are range-partitioned and written; each partition numbers its own rows after
    the counts of those before it.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # a row a partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn(name, own).join(F.broadcast(offsets), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def neighbour_pairs(df: DataFrame, key: str, id_col: str, window: int, block: int = 4096) -> DataFrame:
    """Each row with the next ``window`` rows in the order of ``key`` and ``id_col``.

    Returns ``a_id, a_key, b_id, b_key``. Numbered rows are cut into blocks; the first
    rows of a block also serve as neighbours in the block before it.
    """
    rows = numbered(df.select(F.col(key).alias("key"), F.col(id_col).alias("id")), ["key", "id"])
    own = F.floor((F.col("rn") - 1) / block)
    carried = (F.col("rn") - 1) % block < window
    blocks = F.when(carried & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = rows.withColumn("own", own).withColumn("block", F.explode(blocks))
    ahead = Window.partitionBy("block").orderBy("rn").rowsBetween(1, window)
    met = placed.withColumn("next", F.collect_list(F.struct("id", "key")).over(ahead)).where(F.col("own") == F.col("block"))
    flat = met.select(F.col("id").alias("a_id"), F.col("key").alias("a_key"), F.explode("next").alias("n"))
    return flat.select("a_id", "a_key", F.col("n.id").alias("b_id"), F.col("n.key").alias("b_key"))
