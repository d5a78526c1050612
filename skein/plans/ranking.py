"""Dense ranks without a window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialize

_LOW = (1 << 33) - 1


def dense_ids(df: DataFrame, *order: str, name: str = "vid") -> DataFrame:
    """``df`` with its rows numbered 0, 1, 2 … in the order of ``order``.

    Rows are dealt out by range and sorted there; a row's number is its place in the partition plus the rows of the
    partitions before. Only one count a partition goes through the window.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = placed.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit(_LOW)))
    return ranked.drop("_part", "_start", "_place")
