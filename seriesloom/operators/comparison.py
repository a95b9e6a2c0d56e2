"""Up to five options of one class side by side: rebased values, and payouts as markers on their days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar

MOST = 5


def checked(codes: list[int], start: str, end: str) -> None:
    if not 1 <= len(codes) <= MOST or len(set(codes)) != len(codes):
        raise ValueError(f"one to {MOST} different codes are compared")
    if end <= start:
        raise ValueError("the last day comes after the first")


def side_by_side(members: DataFrame, nav: DataFrame, payouts: DataFrame, codes: list[int], start: str, end: str) -> DataFrame:
    """position, code, name, part, d, value, rebased and amount: points and payouts of the codes from start to end, in the order asked for.

    members (code, name, class) has all codes, and they are of one class: else a LookupError or ValueError.
    A point's rebased value is 100 at the code's first day of the period; a payout has its amount alone.
    """
    checked(codes, start, end)
    found = members.where(F.col("code").isin(codes)).select("code", "name", "class").collect()  # of the five
    if missing := sorted(set(codes) - {r.code for r in found}):
        raise LookupError(f"no options {missing}")
    if len({r["class"] for r in found}) > 1 or any(r["class"] is None for r in found):
        raise ValueError("the options compared are of one class")
    place = F.array_position(F.array(*[F.lit(c).cast("long") for c in codes]), F.col("code")).cast("long")
    inside = lambda df: df.where(F.col("code").isin(codes) & F.col("d").between(calendar.date(start), calendar.date(end)))
    first = F.first("v").over(Window.partitionBy("code").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    points = inside(nav).select("code", F.lit("point").alias("part"), "d", F.col("v").alias("value"), (F.col("v") / first * 100).alias("rebased"), F.lit(None).cast("double").alias("amount"))
    none = F.lit(None).cast("double")
    marks = inside(payouts).where("amount is not null").select("code", F.lit("payout").alias("part"), "d", none.alias("value"), none.alias("rebased"), F.col("amount").cast("double").alias("amount"))
    names = members.where(F.col("code").isin(codes)).select("code", "name")
    return points.unionByName(marks).join(names, "code").select(place.alias("position"), "code", "name", "part", "d", "value", "rebased", "amount")
