"""The screener: candidates of a class, ranked by return or payouts, and every exclusion with its reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from . import payouts as payouts_of
from . import series


def candidates(members: DataFrame, *, classes: list[str], plan: str, option: str, houses: list[str] | None = None, search: str | None = None) -> DataFrame:
    """members (code, name, house, class, plan, option, isin) that the filters leave; a payout option needs its identifier.

    The search is a part of name, code or identifier, in any case, taken literally.
    """
    if option not in ("growth", "idcw") or plan not in ("direct", "regular"):
        raise ValueError("the option is growth or idcw, the plan direct or regular")
    tests = [F.col("class").isin(*classes), F.col("plan") == plan, F.col("option") == option]
    if option == "idcw":
        tests.append(F.col("isin").isNotNull())
    if houses:
        tests.append(F.col("house").isin(*houses))
    if term := (search or "").strip().lower():
        tests.append(F.lower("name").contains(term) | F.lower(F.col("code").cast("string")).contains(term) | F.lower(F.coalesce("isin", F.lit(""))).contains(term))
    return members.where(reduce(lambda a, b: a & b, tests))


def screened(found: DataFrame, nav: DataFrame, events: DataFrame | None, as_of: str, horizon: str = "1y", tolerance: int = 7) -> DataFrame:
    """found with endpoints, returns, payouts, status and reason_detail.

    events (code, d, amount) are given for payout options, which are screened over one year only.
    """
    if events is not None and horizon != "1y":
        raise ValueError("payout options are screened over the trailing year only")
    day, target = calendar.date(as_of), calendar.horizon_start(as_of, horizon)
    own = nav.join(found.select("code"), "code", "left_semi")
    rows = found.join(series.trailing(own, as_of, horizon, tolerance, first=True), "code", "left")  # one pass over the values
    rows = rows.withColumn("status", F.coalesce("status", F.lit("stale_endpoint")))
    rows = rows.withColumn("total_pct", F.when(F.col("status") == "available", (F.col("end_value") / F.col("start_value") - 1) * 100))
    if events is not None:
        paid = events.where((F.col("d") > target) & (F.col("d") <= day)).groupBy("code").agg(F.sum("amount").alias("paid"), F.count("*").alias("events"), F.max("d").alias("last_payout"))
        rows = rows.join(paid, "code", "left")
        rows = rows.withColumn("status", F.when((F.col("status") == "available") & F.col("paid").isNull(), "no_payout_events").otherwise(F.col("status")))
        rows = rows.withColumn("yield_pct", F.when(F.col("status") == "available", F.col("paid") / F.col("end_value") * 100))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    cutoff = F.date_sub(day, tolerance)
    detail = (
        F.when((F.col("status") == "stale_endpoint") & F.col("end_day").isNull(), F.concat(F.lit("no valid value on or before "), iso(day)))
        .when(F.col("status") == "stale_endpoint", F.concat(F.lit("the latest valid value of "), iso("end_day"), F.lit(" is before "), iso(cutoff)))
        .when(F.col("status") == "insufficient_history", F.concat(F.lit("no valid first value from "), iso(target), F.lit(" to "), iso(F.date_add(target, tolerance))))
        .when(F.col("status") == "invalid_period", F.lit("first and last value are of one day"))
        .when(F.col("status") == "no_payout_events", F.concat(F.lit("no current payout after "), iso(target), F.lit(" and up to "), iso(day)))
    )
    return rows.withColumn("reason_detail", detail)


def ranked(rows: DataFrame, *, by_payouts: bool) -> DataFrame:
    """The available rows in final order: by return, or by the mean percentile of yield and number of payouts."""
    good = rows.where("status = 'available'")
    if by_payouts:
        return payouts_of.composite_rank(good)
    order = Window.partitionBy().orderBy(F.desc("return_pct"), F.col("code").cast("string"))  # a row for each series of a class
    return good.withColumn("place", F.row_number().over(order).cast("long"))


def page(rows: DataFrame, *, by_payouts: bool, limit: int = 25, offset: int = 0, exclusion_limit: int = 25, exclusion_offset: int = 0) -> DataFrame:
    """One page of the ranking and one of the exclusions, as rows with part, place and the counts of all candidates and statuses."""
    order = Window.partitionBy().orderBy("status", "name", F.col("code").cast("string"))
    out = rows.where("status <> 'available'").withColumn("place", F.row_number().over(order).cast("long"))
    top = ranked(rows, by_payouts=by_payouts)
    within = lambda first, size: F.col("place").between(first + 1, first + size)
    both = top.where(within(offset, limit)).withColumn("part", F.lit("ranked")).unionByName(out.where(within(exclusion_offset, exclusion_limit)).withColumn("part", F.lit("excluded")), allowMissingColumns=True)
    totals = rows.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("status") == s).alias(n) for n, s in (("total", "available"), ("stale", "stale_endpoint"), ("too_short", "insufficient_history"), ("no_payouts", "no_payout_events"))])
    return both.join(F.broadcast(totals))  # one row of totals
