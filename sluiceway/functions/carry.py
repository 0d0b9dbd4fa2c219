"""Carrying the last known value forward along a log, without putting a whole log into one task.

A log is cut into blocks of its order number.  Each block's last value is a partial result; the blocks, few rows, are
scanned in order to find what each begins with; inside a block a window does the rest.  One source or table may hold most
of the rows: its blocks still go to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 100_000


def carry_forward(rows: DataFrame, by: list[str], order: str, value: Column, name: str, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """rows with name: the last value that isn't null up to each row (strict: before it) in its group, by an integer order
    column; null if there is none."""
    keys = [*by, "_block"]
    d = rows.withColumns({"_block": F.floor(F.col(order) / block), "_value": value})
    blocks = d.groupBy(*keys).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    whole = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carried", F.last("_last", ignorenulls=True).over(whole)).drop("_last")
    # group columns may be null (a table id of a control event), and null groups have no value to carry
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    met = d.join(blocks, keys, "left")
    return met.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carried"))).drop("_block", "_value", "_carried")
