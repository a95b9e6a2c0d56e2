"""Heatmap tiles: funds by class, and reference series one by one, over trailing and rolling periods.

A tile has tile, label, status, value_pct, least and most, the candidates, constituents and exclusions by
reason, samples, the basis of its returns, bounds of its periods and the most stale endpoint. The three
bases of reference series (price, gross, net) are series of their own and never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from . import series

TRAILING = ("1m", "3m", "6m", "1y", "3y", "5y", "10y")
ROLLING = {"rolling_1y": 1, "rolling_3y": 3, "rolling_5y": 5, "rolling_10y": 10}
# The kinds of instruments of each universe, and the basis of their returns.
UNIVERSES = {"benchmarks": ("gross_total_return_index", "net_total_return_index"), "indices": ("price_index",)}
BASES = {"price_index": "price", "gross_total_return_index": "gross_total_return", "net_total_return_index": "net_total_return"}


def split_periods(periods: list[str]) -> tuple[list[str], dict[int, str]]:
    """The trailing periods, and the rolling ones by their years."""
    if unknown := [p for p in periods if p not in TRAILING and p not in ROLLING]:
        raise ValueError(f"unknown periods: {', '.join(unknown)}")
    return [p for p in periods if p in TRAILING], {ROLLING[p]: p for p in periods if p in ROLLING}


def by_years(periods: dict[int, str]) -> Column:
    out = None
    for years, name in periods.items():
        out = F.when(F.col("years") == years, name) if out is None else out.when(F.col("years") == years, name)
    return out


def summed_up(found: DataFrame, tile: str) -> DataFrame:
    """Tiles by period from rows for each series: value, samples, status, starts, ends and staleness."""
    good = F.col("status") == "available"
    tiles = found.groupBy("period", tile).agg(
        F.count("*").alias("candidates"),
        F.count_if(good).alias("constituents"),
        F.count_if(F.col("status") == "stale_endpoint").alias("stale"),
        F.count_if(F.col("status") == "insufficient_history").alias("too_short"),
        F.coalesce(F.sum(F.when(good, F.col("samples"))), F.lit(0)).alias("samples"),
        F.median(F.when(good, F.col("value"))).alias("value_pct"),
        F.min(F.when(good, F.col("value"))).alias("least_pct"),
        F.max(F.when(good, F.col("value"))).alias("most_pct"),
        F.min(F.when(good, F.col("first_start"))).alias("first_start"),
        F.max(F.when(good, F.col("last_start"))).alias("last_start"),
        F.min(F.when(good, F.col("first_end"))).alias("first_end"),
        F.max(F.when(good, F.col("last_end"))).alias("last_end"),
        F.max(F.when(good, F.col("stale_days"))).cast("long").alias("most_stale_days"),
        F.when(F.count_distinct("product") == 1, F.min("product")).otherwise("mixed").alias("product"),
    )
    status = F.when(F.col("constituents") > 0, "available").otherwise("insufficient_history")
    return placed(tiles.withColumns({"status": status, "excluded": F.col("candidates") - F.col("constituents"), "basis": F.lit("nav_only")}), tile)


def placed(tiles: DataFrame, label: str, ident: str | None = None) -> DataFrame:
    """tiles with their place in a period: highest value first, those without one last, then by label and identifier."""
    order = Window.partitionBy("period").orderBy(F.desc_nulls_last("value_pct"), F.lower(label), ident or label)
    return tiles.withColumn("place", F.row_number().over(order).cast("long"))


def fund_tiles(nav: DataFrame, members: DataFrame, as_of: str, periods: list[str], tolerance: int = 7) -> DataFrame:
    """Tiles of the classes of members (code, class, product): medians of trailing returns, or of the series' rolling medians.

    A rolling period counts for a series whose last value up to as_of is not stale; its windows end
    with months. All trailing periods come from one pass over the values, all rolling ones from another.
    """
    trailing, rolling = split_periods(periods)
    parts = []
    past = nav.where(F.col("d") <= calendar.date(as_of))
    if trailing:  # with rolling periods all days are read anyway, and both share that pass
        found = series.trailing_horizons(past if rolling else nav, as_of, trailing, tolerance, recent=not rolling)
        every = members.withColumn("period", each_of(trailing))
        own = found.select("code", F.col("horizon").alias("period"), "status", "return_pct", "start_day", "end_day", "stale_days")
        rows = every.join(own, ["code", "period"], "left")
        parts.append(rows.select(
            "period", "class", "product", F.coalesce("status", F.lit("stale_endpoint")).alias("status"), F.col("return_pct").alias("value"), F.lit(1).alias("samples"),
            F.col("start_day").alias("first_start"), F.col("start_day").alias("last_start"), F.col("end_day").alias("first_end"), F.col("end_day").alias("last_end"), "stale_days",
        ))
    if rolling:
        day = calendar.date(as_of)
        fresh = past.groupBy("code").agg(F.max(F.struct("d", "v")).alias("x")).select("code", (F.col("x.d") >= F.date_sub(day, tolerance)).alias("fresh"))  # of both columns, so that its exchange is the windows'
        each = series.rolling_years(past, tuple(rolling), month_ends=True).groupBy("years", "code").agg(
            F.median("r").alias("value"), F.count("*").alias("samples"), F.min(F.struct("end_day", "start_day")).alias("a"), F.max(F.struct("end_day", "start_day")).alias("b")
        )
        every = members.withColumn("period", each_of(list(rolling.values())))
        rows = every.join(fresh, "code", "left").join(each.withColumn("period", by_years(rolling)).drop("years"), ["code", "period"], "left")
        status = F.when(~F.coalesce("fresh", F.lit(False)), "stale_endpoint").when(F.col("value").isNull(), "insufficient_history").otherwise("available")
        parts.append(rows.select(
            "period", "class", "product", status.alias("status"), "value", "samples", F.col("a.start_day").alias("first_start"), F.col("b.start_day").alias("last_start"),
            F.col("a.end_day").alias("first_end"), F.col("b.end_day").alias("last_end"), F.datediff(day, F.col("b.end_day")).alias("stale_days"),
        ))
    return summed_up(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], "class")


def each_of(periods: list[str]) -> Column:
    """A row for each period."""
    return F.explode(F.array(*map(F.lit, periods)))


def reference_tiles(values: DataFrame, instruments: DataFrame, universe: str, as_of: str, periods: list[str], tolerance: int = 7) -> DataFrame:
    """Tiles of the universe's instruments (code, label, kind), each a series of its own in values (code, d, v: current revisions).

    A rolling tile is the median over all windows of the series; its least and most are windows', not medians.
    """
    if universe not in UNIVERSES:
        raise ValueError("the universe is benchmarks or indices")
    trailing, rolling = split_periods(periods)
    basis = None
    for kind, name in BASES.items():
        basis = F.when(F.col("kind") == kind, name) if basis is None else basis.when(F.col("kind") == kind, name)
    chosen = instruments.where(F.col("kind").isin(*UNIVERSES[universe])).select("code", "label", basis.alias("basis"))
    own = values.join(chosen.select("code"), "code", "left_semi").where(F.col("d") <= calendar.date(as_of))
    parts = []
    if trailing:
        found = series.trailing_horizons(own, as_of, trailing, tolerance).withColumnRenamed("horizon", "period")
        rows = chosen.withColumn("period", each_of(trailing)).join(found, ["code", "period"], "left").withColumn("status", F.coalesce("status", F.lit("stale_endpoint")))
        good = F.col("status") == "available"
        shown = [F.when(good, F.col("return_pct")).alias(n) for n in ("value_pct", "least_pct", "most_pct")]
        days = [F.when(good, F.col(c)).alias(n) for n, c in (("first_start", "start_day"), ("last_start", "start_day"))] + [F.col("end_day").alias(n) for n in ("first_end", "last_end")]
        parts.append(rows.select("period", "code", "label", "basis", "status", *shown, F.when(good, 1).otherwise(0).cast("long").alias("samples"), *days, F.col("stale_days").cast("long").alias("most_stale_days")))
    if rolling:
        day = calendar.date(as_of)
        last = own.groupBy("code").agg(F.max(F.struct("d", "v")).alias("x")).select("code", F.col("x.d").alias("last_day"))
        each = series.rolling_years(own, tuple(rolling)).groupBy("years", "code").agg(
            F.median("r").alias("value_pct"), F.min("r").alias("least_pct"), F.max("r").alias("most_pct"), F.count("*").alias("samples"),
            F.min(F.struct("end_day", "start_day")).alias("a"), F.max(F.struct("end_day", "start_day")).alias("b"),
        )
        rows = chosen.withColumn("period", each_of(list(rolling.values()))).join(last, "code", "left").join(each.withColumn("period", by_years(rolling)).drop("years"), ["code", "period"], "left")
        stale = F.col("last_day").isNull() | (F.col("last_day") < F.date_sub(day, tolerance))
        status = F.when(stale, "stale_endpoint").when(F.col("value_pct").isNull(), "insufficient_history").otherwise("available")
        rows = rows.withColumn("status", status)
        good = F.col("status") == "available"
        shown = [F.when(good, F.col(n)).alias(n) for n in ("value_pct", "least_pct", "most_pct")]
        days = [
            F.when(good, F.col("a.start_day")).alias("first_start"), F.when(good, F.col("b.start_day")).alias("last_start"),
            F.when(good, F.col("a.end_day")).otherwise(F.col("last_day")).alias("first_end"), F.when(good, F.col("b.end_day")).otherwise(F.col("last_day")).alias("last_end"),
        ]
        parts.append(rows.select("period", "code", "label", "basis", "status", *shown, F.when(good, F.col("samples")).otherwise(0).cast("long").alias("samples"), *days, F.datediff(day, F.col("last_day")).cast("long").alias("most_stale_days")))
    return placed(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], "label", "code")
