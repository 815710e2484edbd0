"""Ranks and running sums over whole tables in two steps, so that no order is gathered in one task.

Rows are dealt to range partitions and written once; ranks or sums inside each partition then meet the totals of
the partitions before it, one row a partition (and group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetloom.operators.stages import stage


def _dealt(frame: DataFrame, order: list) -> DataFrame:
    parts = max(2, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return stage(frame.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def numbered(frame: DataFrame, order: list, name: str) -> DataFrame:
    """frame with name: places from 0 in the given order."""
    dealt = _dealt(frame, order)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_own"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_start"))
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return local.join(F.broadcast(starts), "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def running(frame: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """frame with name: the sum of value over the group's rows up to this one, and name_before: up to the one before."""
    dealt = _dealt(frame, [group, order])
    totals = dealt.groupBy(group, "_part").agg(F.sum(value).alias("_own"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, "_part").orderBy(order)
    local = dealt.withColumn("_sum", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    placed = local.join(starts, [group, "_part"]).withColumn(name, F.col("_start") + F.col("_sum"))
    # the very sum of the row before, so that spans neither overlap nor leave gaps
    return placed.withColumn(f"{name}_before", F.coalesce(F.lag(name).over(own), "_start")).drop("_part", "_start", "_sum")
