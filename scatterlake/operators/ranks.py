"""Ranks within groups of any size: a range sort, counts of each piece, places within pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scatterlake.session import stage


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with p, the place of a row in its group by ``order`` from 1, and n, the rows of the group.

    A group that holds most rows is cut into ranges of the order; no task sorts
    it whole. The counts of the pieces are few: groups x ranges.
    """
    pieces = stage(df.repartitionByRange(F.col(group), *order).withColumn("__piece", F.spark_partition_id()), "ranges")
    counts = pieces.groupBy(group, "__piece").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "__piece", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__before"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    own = F.row_number().over(Window.partitionBy(group, "__piece").orderBy(*order))
    return pieces.withColumn("__own", own).join(counts, [group, "__piece"]).withColumn("p", F.col("__before") + F.col("__own")).drop("__piece", "__own", "__before")
