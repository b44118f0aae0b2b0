"""What lies before a row in a global order, without a window over all rows: chunks of rows, and chunks of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chunks that are folded to one before the last step, which alone is a single task.
FOLD = 4096


def sums_before(totals: DataFrame, chunk: str, value: str, name: str) -> DataFrame:
    """(chunk, name): the sum of value over all smaller chunks; totals has one row a chunk."""
    rows = totals.select(chunk, value, F.floor(F.col(chunk) / FOLD).alias("_big"))
    big = rows.groupBy("_big").agg(F.sum(value).alias("_t"))
    big = big.select("_big", (F.sum("_t").over(Window.orderBy("_big")) - F.col("_t")).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy("_big").orderBy(chunk)) - F.col(value)
    return rows.withColumn("_inside", inside).join(big, "_big").select(chunk, (F.col("_base") + F.col("_inside")).alias(name))


def last_before(lasts: DataFrame, chunk: str, value: str, name: str) -> DataFrame:
    """(chunk, name): value of the largest smaller chunk, null for the first; lasts has one row a chunk."""
    rows = lasts.select(chunk, value, F.floor(F.col(chunk) / FOLD).alias("_big"))
    big = rows.groupBy("_big").agg(F.max_by(value, chunk).alias("_l"))
    big = big.select("_big", F.lag("_l").over(Window.orderBy("_big")).alias("_before"))
    # a struct tells a null value from a missing row
    own = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("_big").orderBy(chunk))
    found = rows.withColumn("_own", own).join(big, "_big")
    return found.select(chunk, F.when(F.col("_own").isNotNull(), F.col("_own.v")).otherwise(F.col("_before")).alias(name))
