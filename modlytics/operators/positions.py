"""Dense positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlytics.session import scratch_path
from modlytics.sources.tables import write_table

#: monotonically_increasing_id has the partition above these bits and the row below.
_ROW_BITS = 33


def dense_positions(rows: DataFrame, group: str, order: str, name: str = "pos", keys_of: DataFrame | None = None) -> DataFrame:
    """Number the rows of each group from 0 in the order of a column that is unique inside the group.

    Only the two key columns are sorted: by range, so a group that holds a third of all rows is spread
    over many tasks, whatever its keys look like. A row's position is its place in its partition plus
    the group's rows in the partitions before, of which there is one count per group and partition.
    The sorted keys are written once; rows meet their position by both keys, so they cross the network
    once and no group is hot. ``keys_of`` names the same rows before costly columns were added.
    """
    keys = (rows if keys_of is None else keys_of).select(F.col(group).alias("_group"), F.col(order).alias("_order"))
    placed = keys.repartitionByRange("_group", "_order").sortWithinPartitions("_group", "_order")
    placed = placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    placed = write_table(placed, scratch_path(rows.sparkSession, "positions"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    starts = parts.select("_group", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    numbered = placed.join(starts, ["_group", "_part"]).select("_group", "_order", (F.col("_at") + F.col("_start")).alias(name))
    met = (F.col(group) == F.col("_group")) & (F.col(order) == F.col("_order"))
    return rows.join(numbered, met).drop("_group", "_order")
