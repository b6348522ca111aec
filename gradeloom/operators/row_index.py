"""Position of a row as a column.

A window without partitions would number all rows in one task.  Here every task
numbers its own rows, and only the row counts of the partitions are put in
order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.staging import stage

# monotonically_increasing_id keeps the partition above bit 33.
_PARTITION_BITS = 33
_IN_PARTITION = (1 << _PARTITION_BITS) - 1


def position_in_partition(task_row: Column) -> Column:
    return task_row.bitwiseAND(F.lit(_IN_PARTITION))


def with_row_index(df: DataFrame, *order_by: str | Column, name: str = "row_idx") -> DataFrame:
    """Number rows from 0 in the given order, equal rows in the order they lie.

    The sorted rows are written once, because a second sort could put the
    borders between partitions elsewhere.  Without an order the rows are
    numbered as they lie.
    """
    if order_by:
        # As the last sort key, the place of a row lets equal rows spread over several tasks.
        placed = df.withColumn("_place", F.monotonically_increasing_id())
        df = placed.orderBy(*order_by, "_place").drop("_place")
    rows = stage(df.withColumn("_task_row", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_task_row", _PARTITION_BITS)
    # One row per partition, a bound set by the number of tasks.
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    indexed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    position = F.col("_before") + position_in_partition(F.col("_task_row"))
    return indexed.withColumn(name, position).drop("_part", "_before", "_task_row")
