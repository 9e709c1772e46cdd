"""Dense numbers over all rows of a table in an order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with their place (from 0, without gaps) in the order of some columns; rows equal in these come in any order.

    The rows are range-partitioned, and checkpointed, so that ranges stay what they are; each range is numbered by itself, from the number of rows in the ranges before it, a table of one row a range.
    """
    placed = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = checkpointed(placed)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    joined = placed.join(F.broadcast(sizes), F.col("_part") == F.col("_p"))
    return joined.withColumn(name, F.col("_before") + within - 1).drop("_part", "_p", "_before")


def run_name(number: Column) -> Column:
    """``run_0000`` and so on; longer numbers keep all their digits."""
    return F.format_string("run_%04d", number)
