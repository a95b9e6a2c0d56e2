"""Worked examples of the time-series rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import calendar, returns, text
from seriesloom.operators import heatmaps, intervals, payouts, revisions, series

D = dt.date


def nav(spark, rows, code=1):
    return spark.createDataFrame([(code, d, float(v)) for d, v in rows], "code long, d date, v double")


def test_horizons(spark):
    row = spark.range(1).select(
        calendar.horizon_start("2026-09-02", "1m").alias("a"), calendar.horizon_start("2026-09-02", "6m").alias("b"), calendar.horizon_start("2024-02-29", "1y").alias("c"),
        calendar.horizon_start("2026-09-02", "10y").alias("d"), calendar.frequency_start("2026-09-02").alias("e"), calendar.yearly_cutoffs("2024-02-29").alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (D(2026, 8, 2), D(2026, 3, 2), D(2023, 2, 28), D(2016, 9, 2))
    assert row.e == D(2021, 10, 1)
    assert row.f == [D(2020, 2, 29), D(2021, 2, 28), D(2022, 2, 28), D(2023, 2, 28), D(2024, 2, 29)]
    with pytest.raises(ValueError):
        calendar.horizon_start("2026-09-02", "2w")


def test_inception_and_rolling(spark):
    three = nav(spark, [(D(2020, 1, 1), 100), (D(2021, 1, 1), 110), (D(2022, 1, 1), 121)])
    total = series.since_inception(three).first()
    assert total.total_pct == pytest.approx(21.0) and total.annual_pct == pytest.approx(9.9856587738)
    rolled = series.rolling_summary(series.rolling(three, 1), ["code"]).first()
    assert rolled.samples == 2 and rolled.latest == pytest.approx(10.0)
    ten = nav(spark, [(D(2010, 1, 1), 100), (D(2020, 1, 1), 200)])
    assert series.rolling(ten, 10).first().r == pytest.approx(7.1732778930)
    late = nav(spark, [(D(2021, 1, 4), 100), (D(2022, 1, 1), 110)])
    assert series.rolling(late, 1).count() == 1
    assert series.rolling(nav(spark, [(D(2020, 1, 20), 100), (D(2021, 1, 1), 110)]), 1).count() == 0


def test_month_ends_end_windows_but_do_not_start_them(spark):
    points = [(D(2021, 1, 1), 100), (D(2021, 1, 15), 101), (D(2021, 2, 1), 102), (D(2022, 1, 10), 110), (D(2022, 1, 20), 111), (D(2022, 2, 1), 112)]
    rows = series.rolling(nav(spark, points), 1, month_ends=True).orderBy("end_day").collect()
    assert [(r.start_day, r.end_day) for r in rows] == [(D(2021, 2, 1), D(2022, 2, 1))] or rows[-1].start_day == D(2021, 2, 1)


def test_drawdown(spark):
    row = series.max_drawdown(nav(spark, [(D(2020, 1, 1), 100), (D(2020, 2, 1), 120), (D(2020, 3, 1), 90), (D(2020, 4, 1), 130)])).first()
    assert (row.drawdown_pct, row.peak_day, row.trough_day) == (-25.0, D(2020, 2, 1), D(2020, 3, 1))
    flat = series.max_drawdown(nav(spark, [(D(2020, 1, 1), 1), (D(2020, 2, 1), 2)])).first()
    assert flat.drawdown_pct == 0.0 and flat.trough_day == D(2020, 1, 1)


def test_endpoints_report_why(spark):
    rows = nav(spark, [(D(2020, 1, 1), 100), (D(2021, 1, 1), 110)]).union(nav(spark, [(D(2020, 1, 1), 100)], 2)).union(nav(spark, [(D(2021, 1, 1), 5)], 3))
    found = {r.code: r for r in series.trailing(rows, "2021-01-03", "1y").collect()}
    assert found[1].status == "insufficient_history" and found[1].return_pct is None
    assert found[2].status == "stale_endpoint" and found[3].status == "insufficient_history"
    with pytest.raises(ValueError):
        series.endpoints(rows, "2021-01-03", "1y", tolerance=40)


def test_heatmap_median(spark):
    rows = nav(spark, [(D(2020, 1, 1), 100), (D(2021, 1, 1), 110)]).union(nav(spark, [(D(2020, 1, 1), 100), (D(2021, 1, 1), 120)], 2))
    members = spark.createDataFrame([(1, "equity", "mutual_fund"), (2, "equity", "etf"), (3, "equity", "etf")], "code long, class string, product string")
    found = {r.period: r for r in heatmaps.fund_tiles(rows, members, "2021-01-01", ["1y", "3y", "rolling_1y"]).collect()}
    tile = found["1y"]
    assert tile.constituents == 2 and tile.candidates == 3 and tile.stale == 1 and tile.product == "mixed" and tile.value_pct == pytest.approx(14.956, abs=0.02)
    assert (found["3y"].status, found["3y"].too_short, found["3y"].value_pct) == ("insufficient_history", 2, None)
    assert found["rolling_1y"].samples == 2 and found["rolling_1y"].value_pct == pytest.approx(tile.value_pct)
    with pytest.raises(ValueError):
        heatmaps.fund_tiles(rows, members, "2021-01-01", ["2w"])
    assert tile.least_pct == pytest.approx(9.9712, abs=0.02) and tile.most_pct == pytest.approx(19.94, abs=0.02)


def test_bases_of_reference_tiles_are_kept_apart(spark):
    points = [("p", 100.0, 110.0), ("g", 100.0, 110.0), ("n", 100.0, 105.0), ("old", 100.0, 120.0)]
    rows = spark.createDataFrame([(c, D(2020 - (c == "old"), 1, 1), a) for c, a, _ in points] + [(c, D(2021 - (c == "old"), 1, 1), z) for c, _, z in points], "code string, d date, v double")
    kinds = {"p": "price_index", "g": "gross_total_return_index", "n": "net_total_return_index", "old": "price_index"}
    instruments = spark.createDataFrame([(c, c.upper(), k) for c, k in kinds.items()], "code string, label string, kind string")
    tiles = {r.code: r for r in heatmaps.reference_tiles(rows, instruments, "benchmarks", "2021-01-01", ["1y", "rolling_1y"]).where("period = '1y'").collect()}
    assert {c: (r.basis, round(r.value_pct, 1)) for c, r in tiles.items()} == {"g": ("gross_total_return", 10.0), "n": ("net_total_return", 5.0)}
    price = {(r.code, r.period): r for r in heatmaps.reference_tiles(rows, instruments, "indices", "2021-01-01", ["1y", "rolling_1y"]).collect()}
    assert price["p", "rolling_1y"].samples == 1 and price["old", "1y"].status == "stale_endpoint" and price["old", "rolling_1y"].last_end == D(2020, 1, 1) and price["old", "1y"].value_pct is None
    with pytest.raises(ValueError):
        heatmaps.reference_tiles(rows, instruments, "funds", "2021-01-01", ["1y"])


def test_horizons_in_one_pass_are_those_one_by_one(spark):
    rows = nav(spark, [(D(2020, 1, 1) + dt.timedelta(9 * i), 100 + i * i % 17) for i in range(90)])
    one = {h: tuple(series.trailing(rows, "2022-01-01", h).select("status", "return_pct", "start_day").first()) for h in ("1m", "6m", "1y", "3y")}
    assert {r.horizon: (r.status, r.return_pct, r.start_day) for r in series.trailing_horizons(rows, "2022-01-01", list(one)).collect()} == one
    assert {r.horizon: r.status for r in series.trailing_horizons(rows, "2022-01-01", list(one), recent=True).collect()} == {h: x[0] for h, x in one.items()}
    each = {y: sorted(map(tuple, series.rolling(rows, y).collect())) for y in (1, 2)}
    both = series.rolling_years(rows, (1, 2))
    assert {y: sorted(map(tuple, both.where(F.col("years") == y).drop("years").collect())) for y in (1, 2)} == each


def test_nearest_point_within_a_week(spark):
    marks = spark.createDataFrame([("a", "x", D(2020, 1, 5)), ("b", "x", D(2020, 3, 1)), ("c", "x", D(2020, 1, 8))], "id string, code string, t date")
    points = spark.createDataFrame([("x", D(2020, 1, 1), 1.0), ("x", D(2020, 1, 9), 2.0), ("y", D(2020, 3, 1), 3.0)], "code string, d date, v double")
    assert {r.id: (r.off_days, r.v) for r in series.nearest(marks, points, 7).collect()} == {"a": (4, 1.0), "c": (1, 2.0)}


def test_rows_that_fall_do_not_rise(spark):
    rows = spark.createDataFrame([(1, D(2020, 1, 3), 1), (1, D(2020, 1, 1), 2), (2, D(2020, 1, 1), 1), (2, D(2020, 1, 2), 2)], "code long, d date, seq long")
    assert {r.code: r.rising for r in series.gaps(rows, "seq").collect()} == {1: False, 2: True}


def test_payout_year_leaves_out_its_first_day(spark):
    pay = spark.createDataFrame([(1, D(2020, 1, 1), 9.0), (1, D(2020, 6, 1), 1.0), (1, D(2020, 9, 1), 2.0), (1, D(2021, 1, 1), 3.0)], "code long, d date, amount double")
    row = payouts.trailing_yield(pay, nav(spark, [(D(2021, 1, 1), 100)]), "2021-01-01").first()
    assert (row.events, row.paid, row.yield_pct) == (3, 6.0, 6.0)


def test_composite_rank_breaks_ties_by_code(spark):
    rows = spark.createDataFrame([("b", 5.0, 3), ("a", 5.0, 3)], "code string, yield_pct double, events long")
    found = payouts.composite_rank(rows).orderBy("place").collect()
    assert [(r.code, r.yield_rank, r.score) for r in found] == [("a", 1, 100.0), ("b", 1, 100.0)]
    three = spark.createDataFrame([("balanced", 7.0, 12), ("high", 8.0, 1), ("low", 4.0, 4)], "code string, yield_pct double, events long")
    assert [(r.code, r.score) for r in payouts.composite_rank(three).orderBy("place").collect()] == [("balanced", 75.0), ("high", 50.0), ("low", 25.0)]


def test_payout_frequency(spark):
    months = [D(2021 + (i + 8) // 12, (i + 8) % 12 + 1, 15) for i in range(60)]
    quarters = [D(y, m, 15) for y in range(2021, 2027) for m in (3, 6, 9, 12)]
    rows = [(1, d) for i, d in enumerate(months) if i not in (4, 17, 29, 41, 53)] + [(2, d) for d in quarters] + [(3, d) for d in quarters if not D(2023, 9, 1) <= d <= D(2024, 8, 31)]
    rows += [(4, d) for d in months] + [(5, D(2021, 9, 1) + dt.timedelta(i)) for i in range(1825)] + [(6, d) for d in quarters]
    pay = spark.createDataFrame([(c, d, 1.0) for c, d in rows], "code long, d date, amount double")
    names_ = ["Direct Monthly IDCW", "Direct Quarterly IDCW", "Direct Quarterly IDCW", "Direct IDCW", "Direct Daily IDCW", "Direct IDCW", "Direct Monthly IDCW"]
    found = {r.code: r for r in payouts.payout_frequency(pay, spark.createDataFrame(list(enumerate(names_, 1)), "code long, name string"), "2021-09-01", "2026-08-30").collect()}
    assert (found[1].frequency, found[1].basis, found[1].months, found[1].blocks) == ("monthly", "scheme_name_monthly", 55, [11] * 5)
    assert (found[2].frequency, found[2].months, found[2].blocks) == ("quarterly", 20, [4] * 5)
    assert (found[3].frequency, found[3].basis, found[3].blocks[2]) == (None, "quarterly_consistency_failed", 0)
    assert (found[4].frequency, found[4].basis) == ("monthly", "observed_monthly_cadence") and (found[5].frequency, found[5].basis) == (None, "explicit_other_frequency")
    assert found[6].basis == "observed_quarterly_cadence" and (found[7].basis, found[7].months, found[7].blocks) == ("monthly_consistency_failed", 0, [0] * 5)


def test_islands_and_gaps(spark):
    spans = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 1, 5)), (1, D(2020, 1, 6), D(2020, 1, 7)), (1, D(2020, 1, 3), D(2020, 1, 4)), (1, D(2020, 2, 1), D(2020, 2, 2))], "k long, a date, b date")
    merged = intervals.islands(spans, "k", "a", "b")
    assert {(r.a, r.b, r.parts) for r in merged.collect()} == {(D(2020, 1, 1), D(2020, 1, 7), 3), (D(2020, 2, 1), D(2020, 2, 2), 1)}
    assert [tuple(r) for r in intervals.uncovered(merged, "k", "a", "b").collect()] == [(1, D(2020, 1, 8), D(2020, 1, 31))]


def test_even_sample_rounds_halves_to_even(spark):
    rows = spark.createDataFrame([(1, i) for i in range(30)], "code long, i int")
    assert [r.i for r in series.even_sample(rows, "code", ["i"]).orderBy("i").collect()] == sorted({round(i * 29 / 11) for i in range(12)})


def test_fold_by_tier(spark):
    day = D(2020, 1, 1)
    rows = [
        (1, day, 5.0, 3, 1), (1, day, 6.0, 1, 2), (1, day, 9.0, 2, 3),
        (2, day, 5.0, 2, 1), (2, day, 6.0, 2, 2), (2, day, 6.0, 2, 3),
        (3, day, 5.0, 2, 1), (3, day, 6.0, 2, 2), (3, day, 7.0, 1, 3),
        (4, D(1950, 1, 1), 5.0, 1, 1),
    ]
    found = {r.code: (r.amount, r.tier, r.revision, r.state, r.events) for r in revisions.reconcile(spark.createDataFrame(rows, "code long, d date, amount double, tier int, seq long")).collect()}
    assert found[1] == (6.0, 1, 2, "current", 3) and found[2] == (None, 2, 1, "conflict", 3)
    assert found[3] == (7.0, 1, 2, "current", 3) and found[4][3] == "implausible_date"


def test_merge_actions(spark):
    old = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0), (5, 2.0)], "code long, v double")
    new = spark.createDataFrame([(1, 10.0), (2, 6.0), (4, 7.0), (5, -1.0)], "code long, v double")
    acts = revisions.merge_actions(old, new, ["code"], "v")
    assert {r.code: r.action for r in acts.collect()} == {1: "unchanged", 2: "revised", 3: "absent", 4: "inserted", 5: "quarantined"}
    assert {r.code: r.v for r in revisions.apply_actions(acts, ["code"]).collect()} == {1: 10.0, 2: 6.0, 3: 1.0, 4: 7.0, 5: 2.0}


class Fold:
    """The rule of reconciliation, row by row."""

    def __init__(self, day):
        self.day, self.amount, self.tier, self.revision, self.n, self.state = day, None, None, 0, 0, "implausible_date" if day < D(1964, 1, 1) else "none"

    def add(self, value, tier):
        self.n += 1
        if self.state == "implausible_date":
            return
        if self.tier is None or tier < self.tier:
            self.revision += self.amount is None or value != self.amount or self.state == "conflict"
            self.amount, self.tier, self.state = value, tier, "current"
        elif tier == self.tier and self.state == "current" and value != self.amount:
            self.amount, self.state = None, "conflict"


def test_reconciliation_is_the_fold(spark):
    rng = random.Random(4)
    rows = [(e, D(1950, 1, 1) if e % 40 == 0 else D(2020, 1, 1), float(rng.randint(1, 2)), rng.randint(1, 3), i) for e in range(400) for i in range(rng.randint(1, 7))]
    folds = {}
    for code, day, amount, tier, _ in rows:
        folds.setdefault(code, Fold(day)).add(amount, tier)
    found = {r.code: (r.amount, r.tier, r.revision, r.state, r.events) for r in revisions.reconcile(spark.createDataFrame(rows, "code long, d date, amount double, tier int, seq long")).collect()}
    assert found == {c: (f.amount, f.tier, f.revision, f.state, f.n) for c, f in folds.items()}


def test_text_rules(spark):
    values = ["0.1600", "6.00%", "1:3", "20% (Rs 2/- Per Unit", "15%-Rs 1.50 Per Unit", "30% (Rs 3/- per Unit", "abc", "20% (INR 2/- Per Unit", "20% (Rs 2 Per Unit", "20% (Rs /- Per Unit", "20% (Rs 0/- Per Unit", "0:3", "1:0", "1::3", "1:3%", "-1", "NaN"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", text.value_grammar(F.col("t")).alias("g")).orderBy("i")
    found = [r.g for r in df.collect()]
    assert [g.kind for g in found] == ["scalar", "percent", "ratio", "annotated", "annotated", "annotated", *["invalid"] * 11]
    assert (found[3].value, found[3].annotated) == (20, 2) and (found[4].value, float(found[4].annotated)) == (15, 1.5) and (found[2].ratio_from, found[2].ratio_to, found[2].value) == (1, 3, None)
    row = spark.range(1).select(
        text.safe_cell(F.lit("=1+1")).alias("c"), text.trimmed_number(F.lit(1.25)).alias("d"), text.decimal_text(F.lit("1,234.5")).cast("double").alias("e"), text.decimal_text(F.lit("N.A.")).alias("f"),
        text.is_isin(F.lit("INF204KB14I2")).alias("g"), returns.total_return(F.lit(0.0), F.lit(1.0)).alias("h"), text.trimmed_number(F.lit(None).cast("double")).alias("i"), text.titled(F.lit("gross_total"), F.lit("return")).alias("j"),
        returns.colour_scale(F.lit(-3.5)).alias("k"),
    ).first()
    assert row.c == "'=1+1" and row.d == "1.25" and row.e == 1234.5 and row.f is None and row.g and row.h is None and row.i is None and row.j == "Gross Total Return" and row.k == 3.5


def test_rolling_windows_are_those_of_a_search_for_each_end(spark):
    rng = random.Random(4)
    days = sorted({D(2016, 1, 1) + dt.timedelta(days=rng.randint(0, 2200)) for _ in range(700)} | {D(2016, 2, 29), D(2020, 2, 29), D(2017, 2, 28)})
    points = [(d, rng.uniform(5, 50)) for d in days]

    def back(d, years):
        return d.replace(year=d.year - years, day=28) if (d.month, d.day) == (2, 29) and (d.year - years) % 4 else d.replace(year=d.year - years)

    def windows(years, ends):
        out = []
        for e, v in ends:
            start = next(((d, x) for d, x in points if d >= back(e, years)), None)
            if start and start[0] < e and (start[0] - back(e, years)).days <= 7:
                out.append((years, start[0], e, round(((v / start[1]) ** (365 / (e - start[0]).days) - 1) * 100, 6)))
        return out

    last = [p for p, q in zip(points, [*points[1:], (D(2100, 1, 1), 0)], strict=True) if (p[0].year, p[0].month) != (q[0].year, q[0].month)]
    for month_ends, ends in ((False, points), (True, last)):
        df = series.rolling_years(nav(spark, points), (1, 3, 5), month_ends=month_ends)
        assert sorted((r.years, r.start_day, r.end_day, round(r.r, 6)) for r in df.collect()) == sorted(w for y in (1, 3, 5) for w in windows(y, ends))
        plan = df._jdf.queryExecution().toString()
        assert "RangeFrame" not in plan and plan.count("Exchange hashpartitioning") <= 2
