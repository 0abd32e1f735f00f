"""Places of rows in the order of their key, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``rows`` and ``name``: 1, 2, ... within the same ``keys`` by ``order``. A key of any size is spread over ranges of
    its order; a range's rows are numbered in their task, from the count of the key's rows in earlier ranges. Rows that
    agree in all of ``keys`` and ``order`` get different numbers, in no particular order."""
    placed = cut(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_in"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_in")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    here = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    out = placed.withColumn("_here", here).join(starts, same)
    return out.withColumn(name, F.col("_start") + F.col("_here")).select(*rows.columns, name)
