"""Payout yields, cadence and ranking."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar

# Months with payouts that a frequency needs in all and in any year, the days of its median gap, and words that state one.
MONTHLY, QUARTERLY = (48, 8), (16, 3)
MONTHLY_GAP, QUARTERLY_GAP = (20, 45), (60, 120)
SAYS_MONTH, SAYS_QUARTER = "(?i)\\bmonth(?:ly)?\\b", "(?i)\\bquarter(?:ly)?\\b"
SAYS_OTHER = "(?i)\\b(?:daily|weekly|fortnightly|annual|annually|half[ -]?yearly|semi[ -]?annual)\\b"


def trailing_yield(payouts: DataFrame, nav: DataFrame, as_of: str, tolerance: int = 7) -> DataFrame:
    """code, events, paid, value_day, value, yield_pct and status over the year that ends with as_of.

    The year leaves out its first day. The yield divides by the last value within the tolerance.
    """
    day = calendar.date(as_of)
    year = payouts.where((F.col("d") > calendar.anniversary(as_of, 1)) & (F.col("d") <= day))
    paid = year.groupBy("code").agg(F.count("*").alias("events"), F.sum("amount").alias("paid"))
    last = nav.where(F.col("d") <= day).groupBy("code").agg(F.max(F.struct("d", "v")).alias("x"))
    both = last.join(paid, "code", "left").select("code", "events", "paid", F.col("x.d").alias("value_day"), F.col("x.v").alias("value"))
    status = F.when(F.col("value_day") < F.date_sub(day, tolerance), "stale_endpoint").when(F.col("events").isNull(), "no_payout_events").otherwise("available")
    return both.withColumn("status", status).withColumn("yield_pct", F.when(F.col("status") == "available", F.col("paid") / F.col("value") * 100))


def composite_rank(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Competition ranks of yield_pct and events, their percentile scores, and the mean of both, in final order.

    rows has one row for each series; without a scope the ranking is one window over them.
    """
    own = Window.partitionBy(*(scope or []))
    by_yield, by_events = own.orderBy(F.desc("yield_pct")), own.orderBy(F.desc("events"))
    scored = rows.withColumns(
        {
            "yield_rank": F.rank().over(by_yield).cast("long"),
            "events_rank": F.rank().over(by_events).cast("long"),
            "yield_score": (1 - F.percent_rank().over(by_yield)) * 100,
            "events_score": (1 - F.percent_rank().over(by_events)) * 100,
        }
    ).withColumn("score", (F.col("yield_score") + F.col("events_score")) / 2)
    order = own.orderBy(F.desc("score"), F.desc("yield_pct"), F.desc("events"), F.col("code").cast("string"))
    return scored.withColumn("place", F.row_number().over(order).cast("long"))


def payout_frequency(payouts: DataFrame, codes: DataFrame, start: str, end: str) -> DataFrame:
    """codes (code, name, ...) with months, blocks, events, median_gap, frequency and basis of the payouts from start to end.

    blocks has the months with payouts of each year from start on, years without any too. A name that
    states a month or quarter needs a steady history of it; any other stated frequency rules both out;
    a name that states none needs steady gaps beside it.
    """
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if last < first:
        raise ValueError("the period ends before it starts")
    n_blocks = 1 + ((last.year - first.year) * 12 + last.month - first.month - (last.day < first.day)) // 12
    inside = payouts.where(F.col("d").between(F.lit(first), F.lit(last))).select("code", "d").distinct()
    block = F.floor(F.months_between("d", F.lit(first)) / 12).cast("int")
    per_block = inside.groupBy("code", block.alias("block")).agg(F.count_distinct(F.trunc("d", "MM")).alias("n"))
    held = F.map_from_entries(F.collect_list(F.struct("block", "n")))  # at most a pair for each year
    blocks = per_block.groupBy("code").agg(held.alias("m")).select("code", F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("blocks"))
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("code").orderBy("d")))
    total = inside.withColumn("gap", gap).groupBy("code").agg(F.count_distinct(F.trunc("d", "MM")).alias("months"), F.count("*").alias("events"), F.median("gap").alias("median_gap"))
    rows = codes.join(total, "code", "left").join(blocks, "code", "left").fillna(0, ["months", "events"])
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.array_repeat(F.lit(0).cast("long"), n_blocks)))
    steady = lambda limits: (F.col("months") >= limits[0]) & (F.array_min("blocks") >= limits[1])
    name, monthly, quarterly = F.col("name"), steady(MONTHLY), steady(QUARTERLY)
    basis = (
        F.when(name.rlike(SAYS_MONTH), F.when(monthly, "scheme_name_monthly").otherwise("monthly_consistency_failed"))
        .when(name.rlike(SAYS_QUARTER), F.when(quarterly, "scheme_name_quarterly").otherwise("quarterly_consistency_failed"))
        .when(name.rlike(SAYS_OTHER), "explicit_other_frequency")
        .when(monthly & F.col("median_gap").between(*MONTHLY_GAP), "observed_monthly_cadence")
        .when(quarterly & F.col("median_gap").between(*QUARTERLY_GAP), "observed_quarterly_cadence")
        .otherwise("no_supported_monthly_or_quarterly_cadence")
    )
    rows = rows.withColumn("basis", basis)
    kinds = {"monthly": ("scheme_name_monthly", "observed_monthly_cadence"), "quarterly": ("scheme_name_quarterly", "observed_quarterly_cadence")}
    return rows.withColumn("frequency", F.when(F.col("basis").isin(*kinds["monthly"]), "monthly").when(F.col("basis").isin(*kinds["quarterly"]), "quarterly"))
