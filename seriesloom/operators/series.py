"""Operators over dated series: current revisions, as-of points, rolling returns, drawdowns, rebasing, sampling.

A series table has the columns code, d (date) and v (double). Every operator partitions by code, or
aggregates by it, so that work spreads with the number of series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, returns


def current(revisions: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The latest revision of each key, by one aggregation that combines before it shuffles."""
    latest = F.max_by(F.struct(*values), F.struct(*order)).alias("__latest")
    return revisions.groupBy(*keys).agg(latest).select(*keys, "__latest.*")


def horizon_points(nav: DataFrame, as_of: str, horizons: list[str], tolerance: int = 7, *, recent: bool = False, first: bool = False) -> DataFrame:
    """code, e (last d and v up to as_of), and for each horizon s_<horizon>: the first d and v within the tolerance from its start on.

    One aggregation finds all of them, over no day after as_of. With recent only days that can count
    are read: a stale series then has no end at all. With first all days are read, and first_day is the first of all.
    """
    if not 0 <= tolerance <= 31:
        raise ValueError("tolerance is 0 to 31 days")
    day, d = calendar.date(as_of), F.col("d")
    starts = {h: d.between(calendar.horizon_start(as_of, h), F.date_add(calendar.horizon_start(as_of, h), tolerance)) for h in horizons}
    if first:
        past = {h: c & (d <= day) for h, c in starts.items()}
        points = [F.min(F.when(c, F.struct("d", "v"))).alias(f"s_{h}") for h, c in past.items()]
        return nav.groupBy("code").agg(F.max(F.when(d <= day, F.struct("d", "v"))).alias("e"), F.min("d").alias("first_day"), *points)
    rows = nav.where(d <= day)
    if recent:
        rows = rows.where(reduce(lambda a, b: a | b, starts.values(), d >= F.date_sub(day, tolerance)))
    end = F.struct("d", "v") if not recent else F.when(d >= F.date_sub(day, tolerance), F.struct("d", "v"))
    return rows.groupBy("code").agg(F.max(end).alias("e"), *[F.min(F.when(c, F.struct("d", "v"))).alias(f"s_{h}") for h, c in starts.items()])


def with_status(points: DataFrame, as_of: str, tolerance: int) -> DataFrame:
    """points (code, start_day, start_value, end_day, end_value, ...) with days, stale_days and status."""
    day = calendar.date(as_of)
    return points.withColumns(
        {
            "days": F.datediff("end_day", "start_day"),
            "stale_days": F.datediff(day, F.col("end_day")),
            "status": returns.endpoint_status(F.col("end_day"), F.col("start_day"), day, tolerance),
        }
    )


def endpoints(nav: DataFrame, as_of: str, horizon: str, tolerance: int = 7, *, recent: bool = False, first: bool = False) -> DataFrame:
    """code, start and end day and value, days, staleness and status of each series that has any value.

    The end is the last value up to as_of, the start the first from the horizon's beginning on, within
    the tolerance. recent and first are as for ``horizon_points``.
    """
    found = horizon_points(nav, as_of, [horizon], tolerance, recent=recent, first=first).withColumn("s", F.col(f"s_{horizon}"))
    return with_status(found.select("code", *["first_day"] * first, F.col("s.d").alias("start_day"), F.col("s.v").alias("start_value"), F.col("e.d").alias("end_day"), F.col("e.v").alias("end_value")), as_of, tolerance)


def trailing_horizons(nav: DataFrame, as_of: str, horizons: list[str], tolerance: int = 7, *, recent: bool = False) -> DataFrame:
    """endpoints and trailing return of each series and horizon, from one pass over the values."""
    found = horizon_points(nav, as_of, horizons, tolerance, recent=recent)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"s_{h}").alias("s")) for h in horizons]))
    points = found.select("code", "e", each.alias("x")).select(
        "code", "x.horizon", F.col("x.s.d").alias("start_day"), F.col("x.s.v").alias("start_value"), F.col("e.d").alias("end_day"), F.col("e.v").alias("end_value")
    )
    rows = with_status(points, as_of, tolerance)
    args = F.col("start_value"), F.col("end_value"), F.col("days")
    annual = [h for h in horizons if calendar.is_annualised(h)]
    value = F.when(F.col("horizon").isin(annual), returns.trailing_return(*args, True)).otherwise(returns.trailing_return(*args, False))
    return rows.withColumn("return_pct", F.when(F.col("status") == "available", value))


def trailing(nav: DataFrame, as_of: str, horizon: str, tolerance: int = 7, *, recent: bool = False, first: bool = False) -> DataFrame:
    """endpoints with the trailing return, null unless available."""
    found = endpoints(nav, as_of, horizon, tolerance, recent=recent, first=first)
    value = returns.trailing_return(F.col("start_value"), F.col("end_value"), F.col("days"), calendar.is_annualised(horizon))
    return found.withColumn("return_pct", F.when(F.col("status") == "available", value))


def rolling(nav: DataFrame, years: int, *, month_ends: bool = False, tolerance: int = 7) -> DataFrame:
    """code, start_day, end_day, r: the annual return of every window of so many years.

    Each end takes the first value on or after its anniversary. With month_ends only a month's last
    value ends a window; starts may be any day.
    """
    return rolling_years(nav, (years,), month_ends=month_ends, tolerance=tolerance).drop("years")


def rolling_years(nav: DataFrame, lengths: tuple[int, ...], *, month_ends: bool = False, tolerance: int = 7) -> DataFrame:
    """years, code, start_day, end_day, r of the windows of several lengths.

    A merge of points and targets: both stand in one order of days, the latest first, and a target takes
    the last point that has gone by. One exchange by code and one running value, so the work grows with days, not
    with the length of windows; with month_ends only a month's last days have targets.
    """
    d, v = F.col("d"), F.col("v")
    goals = F.array(*[F.struct(calendar.anniversary(d, y).alias("day"), F.lit(y).alias("years"), d.alias("d"), v.alias("v")) for y in lengths])
    if month_ends:
        after = F.lead("d").over(Window.partitionBy("code").orderBy("d"))
        nav = nav.withColumn("__last", after.isNull() | (F.trunc(after, "MM") != F.trunc("d", "MM")))
        goals = F.when(F.col("__last"), goals).otherwise(F.slice(goals, 1, 0))
    point = F.array(F.struct(d.alias("day"), F.lit(0).alias("years"), d.alias("d"), v.alias("v")))
    rows = nav.select("code", F.inline(F.concat(point, goals)))
    gone_by = Window.partitionBy("code").orderBy(F.desc("day"), F.col("years") > 0, F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("years") == 0, F.struct("d", "v")), ignorenulls=True).over(gone_by)
    found = rows.withColumn("s", start).where("years > 0").select("years", "code", "d", "v", "day", F.col("s.d").alias("start_day"), F.col("s.v").alias("start_value"))
    ok = (F.col("start_day") < F.col("d")) & (F.col("start_day") <= F.date_add("day", tolerance))
    value = returns.annual_return(F.col("start_value"), F.col("v"), F.datediff("d", "start_day"))
    return found.where(ok).select("years", "code", "start_day", F.col("d").alias("end_day"), value.alias("r")).where("r is not null")


def rolling_summary(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, latest, least, median, mean, most and share of positive windows by key."""
    r = F.col("r")
    return windows.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.min("end_day").alias("first_end"),
        F.max("end_day").alias("last_end"),
        F.max_by("r", "end_day").alias("latest"),
        F.min(r).alias("least"),
        F.median(r).alias("median"),
        F.avg(r).alias("mean"),
        F.max(r).alias("most"),
        (F.avg(F.when(r > 0, 1.0).otherwise(0.0)) * 100).alias("positive_pct"),
    )


def since_inception(nav: DataFrame) -> DataFrame:
    """First and last point, total and annual return of each series; the annual one is null for a single day."""
    ends = nav.groupBy("code").agg(F.min(F.struct("d", "v")).alias("s"), F.max(F.struct("d", "v")).alias("e"), F.count("*").alias("points"))
    s, e = F.col("s.v"), F.col("e.v")
    days = F.datediff("e.d", "s.d")
    return ends.select("code", "points", F.col("s.d").alias("first_day"), F.col("e.d").alias("last_day"), returns.total_return(s, e).alias("total_pct"), returns.annual_return(s, e, days).alias("annual_pct"))


def max_drawdown(nav: DataFrame) -> DataFrame:
    """The worst fall from a running peak, with the peak's first day and the first trough of that depth; 0 if none."""
    before = Window.partitionBy("code").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(F.struct(F.col("v"), (-F.unix_date("d")).alias("neg"))).over(before)
    falls = nav.withColumn("p", peak).select("code", "d", ((F.col("v") / F.col("p.v") - 1) * 100).alias("fall"), F.date_from_unix_date(-F.col("p.neg")).alias("peak_day"))
    worst = falls.groupBy("code").agg(F.min(F.struct("fall", "d", "peak_day")).alias("w"))
    return worst.select("code", F.col("w.fall").alias("drawdown_pct"), F.col("w.peak_day").alias("peak_day"), F.col("w.d").alias("trough_day"))


def rebased(nav: DataFrame, base: float = 100.0) -> DataFrame:
    """Each series as a multiple of its first value."""
    first = Window.partitionBy("code").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return nav.withColumn("rebased", F.col("v") / F.first("v").over(first) * base)


def month_ends(nav: DataFrame) -> DataFrame:
    """The last value of each calendar month."""
    month = F.trunc("d", "MM").alias("month")
    return nav.groupBy("code", month).agg(F.max(F.struct("d", "v")).alias("x")).select("code", "month", F.col("x.d").alias("d"), F.col("x.v").alias("v"))


def gaps(points: DataFrame, order: str | None = None) -> DataFrame:
    """Days between neighbouring dates: their count, median and largest by series, and whether dates rise in the source's order.

    order is the column that the source orders its rows by; dates that stand still or fall in it do not rise.
    """
    before = F.lag("d").over(Window.partitionBy("code").orderBy("d"))
    steps = points.select("code", "d").distinct().withColumn("gap", F.datediff("d", before))
    out = steps.groupBy("code").agg(F.count("gap").alias("steps"), F.median("gap").alias("median_gap"), F.max("gap").alias("largest_gap"))
    if order is None:
        return out
    told = points.withColumn("__up", F.col("d") > F.lag("d").over(Window.partitionBy("code").orderBy(order)))
    return out.join(told.groupBy("code").agg(F.min(F.coalesce("__up", F.lit(True))).alias("rising")), "code")


def even_sample(rows: DataFrame, key: str, order: list[str], most: int = 12) -> DataFrame:
    """At most so many rows of each key, evenly spaced from the first to the last; halves round to even."""
    own = Window.partitionBy(key)
    numbered = rows.withColumn("__i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(own))
    i, last = F.col("__i"), F.col("__n") - 1
    turn = F.round(i * (most - 1) / last)  # more than a row apart from turn to turn, so that i can be the row of this one only
    return numbered.where(F.when(last < most, True).otherwise(F.bround(turn * last / (most - 1)) == i)).drop("__i", "__n")


def nearest(left: DataFrame, right: DataFrame, days: int) -> DataFrame:
    """For each row (id, code, t) of left, the point of right (code, d, v) nearest to t within so many days, the earlier of two.

    The nearest point is sought once for each (code, t), however many rows name it, and rows meet it by equal keys.
    Days fall into stretches of so many days; a day meets the points of its own stretch and its
    neighbours', so that a series which many rows name is dealt out by time.
    """
    stretch = lambda c: F.floor(F.unix_date(c) / days)
    goals = left.select(F.col("code").alias("__c"), "t").distinct().select("__c", "t", F.explode(F.array(*[stretch("t") + i for i in (-1, 0, 1)])).alias("__k"))
    points = right.select(F.col("code").alias("__c"), stretch("d").alias("__k"), "d", "v")
    off = F.abs(F.datediff("d", "t"))
    near = F.min(F.struct(off.alias("off"), "d", "v")).alias("n")
    found = goals.join(points, ["__c", "__k"]).where(off <= days).groupBy("__c", "t").agg(near)
    both = left.select("id", F.col("code").alias("__c"), "t").join(found, ["__c", "t"])
    return both.select("id", "t", F.col("n.off").alias("off_days"), F.col("n.d").alias("d"), F.col("n.v").alias("v"))
