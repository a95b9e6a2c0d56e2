"""Interval logic: merging what touches, and the gaps that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, key: str, first: str, last: str, touch: int = 1) -> DataFrame:
    """key, first, last, parts: spans of a key that overlap or lie at most touch days apart, as one."""
    order = Window.partitionBy(key).orderBy(first, last)
    reach = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(first) > F.date_add(reach, touch)), 1).otherwise(0)
    numbered = spans.withColumn("__new", begins).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__island").agg(F.min(first).alias(first), F.max(last).alias(last), F.count("*").alias("parts")).drop("__island")


def uncovered(merged: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """key, gap_start, gap_end of the days between neighbouring islands."""
    after = F.lead(first).over(Window.partitionBy(key).orderBy(first))
    rows = merged.withColumn("__next", after).where("__next is not null")
    return rows.select(key, F.date_add(last, 1).alias("gap_start"), F.date_sub("__next", 1).alias("gap_end"))
