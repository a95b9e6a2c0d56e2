"""Observations with their statistics, requests to sources, and identities, by worked examples."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import identities, observations, sync

D = dt.date
DAY = D(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def test_observations_and_their_issues(spark):
    current = spark.createDataFrame([(1, day(0), 10.0, "valid", 1), (1, day(1), 0.0, "error", 2), (1, day(2), 5.0, "valid", 1)], observations.CURRENT)
    batch = spark.createDataFrame(
        [(1, day(0), 10.0, "10.0", "INF204KB14I2", None), (1, day(1), 3.0, "3", "BAD", None), (1, day(2), -1.0, "-1", None, "INF204KB14IX"), (1, day(3), None, "N.A.", None, None), (2, day(0), 0.0, "0", None, None)],
        "code long, d date, v double, raw string, isin_payout_or_growth string, isin_reinvestment string",
    )
    told = observations.publish(current, batch)
    assert [(r.code, r.d, r.action, r.status, r.revision) for r in told.orderBy("code", "d").collect()] == [
        (1, day(0), "unchanged", "valid", 1), (1, day(1), "revised", "valid", 3), (1, day(2), "revised", "error", 2), (1, day(3), "invalid", None, None), (2, day(0), "inserted", "error", 1),
    ]
    assert sorted((r.code, r.d, r.issue, r.severity, r.detail) for r in observations.issues(told).collect()) == [
        (1, day(1), "INVALID_ISIN_PAYOUT_OR_GROWTH", "warning", "BAD"), (1, day(2), "INVALID_ISIN_REINVESTMENT", "warning", "INF204KB14IX"), (1, day(2), "NON_POSITIVE_NAV", "error", "-1"),
        (1, day(3), "INVALID_NAV_VALUE", "error", "N.A."), (2, day(0), "NON_POSITIVE_NAV", "error", "0"),
    ]
    assert told.agg(*observations.counters(told)).first().asDict() == {"received": 5, "inserted": 1, "unchanged": 1, "revised": 2, "quarantined": 3, "latest_day": day(2)}
    assert observations.links(told, "b1").count() == 4
    left = observations.revised(current, told)
    assert observations.publish(left, batch).where("action not in ('unchanged', 'invalid')").count() == 0


def test_statistics_by_deltas_are_those_of_a_recount(spark):
    rng = random.Random(3)
    current, held = spark.createDataFrame([], observations.CURRENT), spark.createDataFrame([], observations.STATISTICS)
    for turn in range(3):
        rows = {(rng.randint(1, 6), day(rng.randint(0, 9))): rng.choice([None, 0.0, 1.0, 2.0]) for _ in range(40)}
        told = observations.publish(current, spark.createDataFrame([(*k, v) for k, v in rows.items()], "code long, d date, v double"))
        new = spark.createDataFrame(observations.revised(current, told).collect(), observations.CURRENT)
        held = spark.createDataFrame(observations.statistics_after(held, spark.createDataFrame(told.collect(), told.schema), new).collect(), observations.STATISTICS)
        current = new
        want = {r.code: (r.valid, r.error, r.first_valid, r.last_valid) for r in observations.counted(current).collect()}
        assert {r.code: (r.valid, r.error, r.first_valid, r.last_valid) for r in held.collect() if r.valid or r.error} == want
    whole = observations.dataset(held).first()
    assert (whole.valid, whole.error) == (current.where("status = 'valid'").count(), current.where("status = 'error'").count())


def test_only_series_that_lost_a_bound_are_read_again(spark):
    held = spark.createDataFrame([(1, 2, 0, day(0), day(5), day(0), day(5)), (2, 2, 0, day(0), day(5), day(0), day(5))], observations.STATISTICS)
    told = observations.publish(spark.createDataFrame([(1, day(5), 1.0, "valid", 1), (2, day(5), 1.0, "valid", 1)], observations.CURRENT), spark.createDataFrame([(1, day(5), 0.0), (2, day(6), 3.0)], "code long, d date, v double"))
    only = spark.createDataFrame([(1, day(0), 1.0, "valid", 1), (1, day(5), 0.0, "error", 2)], observations.CURRENT)  # the second series is not there, and is not missed
    found = {r.code: tuple(r)[1:] for r in observations.statistics_after(held, told, only).collect()}
    assert found == {1: (1, 1, day(0), day(0), day(0), day(5)), 2: (3, 0, day(0), day(6), day(0), day(6))}


def spans(df):
    return sorted((r.source, str(r.start_day), str(r.end_day)) for r in df.collect())


def test_requests_from_gaps_and_checkpoints(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    coverage = sync.covered(
        spark.createDataFrame([("a", D(2025, 1, 1), D(2025, 1, 10)), ("b", D(2024, 1, 1), D(2026, 1, 1))], sync.COVERAGE), spark.createDataFrame([("a", D(2025, 1, 11), D(2025, 1, 20)), ("a", D(2025, 2, 1), D(2025, 2, 5))], sync.COVERAGE)
    )
    assert spans(coverage) == [("a", "2025-01-01", "2025-01-20"), ("a", "2025-02-01", "2025-02-05"), ("b", "2024-01-01", "2026-01-01")]
    none = spark.createDataFrame([], sync.CHECKPOINT)
    assert spans(sync.requests(sources, coverage, none, "full", "2025-01-05", "2025-06-30")) == [
        ("a", "2025-01-21", "2025-01-31"), ("a", "2025-02-06", "2025-05-06"), ("a", "2025-05-07", "2025-06-30"), ("c", "2025-01-05", "2025-04-04"), ("c", "2025-04-05", "2025-06-30"),
    ]
    held = spark.createDataFrame([("a", D(2025, 6, 20), None), ("b", D(2025, 7, 20), None)], sync.CHECKPOINT)
    plan = lambda overlap: spans(sync.requests(sources.where("source < 'c'"), coverage, held, "incremental", "2025-01-05", "2025-06-30", overlap))
    assert plan(7) == [("a", "2025-06-14", "2025-06-30")] and plan(0) == [("a", "2025-06-21", "2025-06-30")]
    done = spark.createDataFrame([("a", D(2025, 6, 1), D(2025, 6, 25)), ("z", D(2025, 1, 1), None)], "source string, end_day date, latest_found date")
    assert sorted((r.source, r.completed_through, r.latest_found) for r in sync.advanced(held, done).collect()) == [("a", D(2025, 6, 20), D(2025, 6, 25)), ("b", D(2025, 7, 20), None), ("z", D(2025, 1, 1), None)]
    for wrong in (("other", "2025-01-01", "2025-01-02", 7), ("full", "2025-01-02", "2025-01-01", 7), ("full", "2025-01-01", "2025-01-02", -1)):
        with pytest.raises(ValueError):
            sync.requests(sources, coverage, none, *wrong)


def test_requests_keep_the_sources_contract(spark):
    windows = spark.createDataFrame([("12", D(2025, 1, 1), D(2025, 3, 31))], sync.COVERAGE)
    assert sync.contracted(windows).count() == 1 and sync.contracted(windows).first().source == "12"
    years = spark.createDataFrame([("1", "20", "All"), ("1", "21", "2024")], "fund string, family string, year string")
    assert sync.contracted(years).count() == 2
    for bad, what in ((windows.withColumn("source", F.lit("x1")), "source"), (windows.withColumn("end_day", F.lit(D(2025, 4, 1))), "window"), (windows.withColumn("end_day", F.lit(D(2024, 4, 1))), "window"), (years.withColumn("year", F.lit("24")), "year"), (years.withColumn("family", F.lit(None).cast("string")), "family")):
        with pytest.raises(Exception, match=what):
            sync.contracted(bad).collect()


def test_indices_by_either_name(spark):
    mappings = spark.createDataFrame([("Nifty 50", "NIFTY"), ("NIFTY", "Other")], "display_name string, trading_name string")
    asked = spark.createDataFrame([(" nifty 50 ",), ("nifty",), ("OTHER",), ("",)], "name string")
    found = {r.name: r.trading_name for r in sync.index_names(asked, mappings).collect()}
    assert found == {"nifty 50": "NIFTY", "nifty": "Other", "OTHER": "Other"}
    with pytest.raises(Exception, match="does not have"):
        sync.index_names(spark.createDataFrame([("Sensex",)], "name string"), mappings).collect()
    done = spark.createDataFrame([("NIFTY|price", D(2024, 1, 1))], "source string, start_day date")
    plan = lambda mode: {(r.source, str(r.start_day), str(r.end_day)): r.state for r in sync.index_requests(mappings.where("trading_name = 'NIFTY'"), done, mode, "2024-01-01", "2025-01-10").collect()}
    assert plan("full") == {("NIFTY|price", "2024-01-01", "2024-12-30"): "skipped", ("NIFTY|price", "2024-12-31", "2025-01-10"): "pending", ("NIFTY|total_return", "2024-01-01", "2024-12-30"): "pending", ("NIFTY|total_return", "2024-12-31", "2025-01-10"): "pending"}
    assert set(plan("refresh").values()) == {"pending"}


def test_what_answers_mean(spark):
    answers = spark.createDataFrame([("s", DAY, DAY, x) for x in sync.OUTCOMES], "source string, start_day date, end_day date, outcome string")
    found = {r.outcome: (r.issue, r.severity, r.completed, r.failed, r.checkpointed) for r in sync.triaged(answers).collect()}
    assert found == {
        "rows": (None, None, True, False, True), "empty": ("empty_source_period", "info", True, False, True), "not_published": ("empty_trading_day", "info", True, False, False),
        "missing": ("empty_trading_day", "info", True, False, False), "transport": ("download_failure", "error", False, True, False),
    }
    with pytest.raises(Exception, match="cannot be parsed"):
        sync.triaged(answers.withColumn("outcome", F.lit("parse_error"))).collect()
    plan = sync.daily_requests(answers.select("source"), sync.triaged(answers).where("checkpointed"), "full", "2019-12-31", "2020-01-02")
    assert [(r.start_day, r.state) for r in plan.orderBy("place").collect()] == [(D(2020, 1, 2), "pending"), (D(2020, 1, 1), "skipped"), (D(2019, 12, 31), "pending")]
    assert [r[0] for r in spark.range(2).select(sync.run_status(F.col("id"))).collect()] == ["completed", "completed_with_issues"]


def test_families_to_ask_for(spark):
    universe = spark.createDataFrame([("1", "a", "A"), ("1", "b", "B new"), ("1", "c", "C"), ("2", "a", "A")], "fund string, family string, name string")
    held = spark.createDataFrame([("1", "a", "A"), ("1", "b", "B"), ("1", "c", "C")], "fund string, family string, name string")
    open_ = spark.createDataFrame([("1", "c"), ("1", "c")], "fund string, family string")
    state = lambda *a: [r.state for r in sync.family_requests(universe, held, open_, *a).orderBy("fund", "family").collect()]
    assert state("full", True) == ["skipped", "pending", "retry", "pending"] and state("full") == ["skipped", "pending", "skipped", "pending"] and set(state("refresh")) == {"pending"}


PRICE = "exchange string, security_id string, isin string, symbol string, series string, d date"


def test_identity_is_official_only_on_the_rosters_day(spark):
    instruments = spark.createDataFrame([("nse", "etf", "I1", "n", "f", "I1", "s", None), ("nse", "price_index", "X", "n", "f", None, None, None)], identities.INSTRUMENT)
    listings = spark.createDataFrame([("BSE", "2", "I2", "s", "A"), ("BSE", "3", "I3", "s", "A"), ("BSE", "3", "I4", "s", "A")], identities.LISTING)
    roster = spark.createDataFrame([(s, f"Fund {s}", c, f"A{s}", day(5)) for s, c in (("1", "Gold"), ("2", None), ("3", None), ("4", "Debt"), ("5", None))], "security_id string, name string, category string, alias string, day date")
    rows = [("BSE", "1", "I1", "s1", "A", day(5)), ("BSE", "1", "I1", "s1", "A", day(6)), ("BSE", "9", "I1", "s9", "A", day(5)), ("BSE", "2", None, "s2", "A", day(5)), ("BSE", "3", None, "s3", "A", day(5)), ("BSE", "4", "I9", "s4", "B", day(4)), ("BSE", "8", "I8", "s8", "A", day(5)), ("BSE", "5", None, "s5", "A", day(5))]
    told = identities.resolved(spark.createDataFrame(rows, PRICE), instruments, listings, roster)
    found = sorted((r.security_id, str(r.d), r.instrument, r.found_by, r.identity, r.issue) for r in told.collect())
    late = "provisional_current_mapping"
    assert found == [
        ("1", "2020-01-06", "I1", "isin", "official", None), ("1", "2020-01-07", "I1", "isin", late, None), ("2", "2020-01-06", "I2", "listing", "official", None), ("3", "2020-01-06", None, None, "identity_unresolved", "identity_unresolved"),
        ("4", "2020-01-05", "I9", "roster", late, None), ("5", "2020-01-06", None, None, "identity_unresolved", "identity_unresolved"), ("8", "2020-01-06", None, None, None, None), ("9", "2020-01-06", "I1", "isin", late, None),
    ]
    after = identities.with_roster(instruments, told, roster)
    assert {r.isin: (r.provider, r.identifier, r.name, r.family, r.symbol, r.series) for r in after.where("kind = 'etf'").collect()} == {"I1": ("nse", "I1", "n", "f", "s", None), "I9": ("bse", "4", "Fund 4", "BSE Debt ETF", "A4", "B")}
    master = spark.createDataFrame([("I1", "New", "Gold", "G"), ("I7", "Other", "Debt", "O")], "isin string, name string, underlying string, symbol string")
    named = identities.with_master(after, master)
    assert {r.isin: (r.name, r.family, r.symbol, r.provider) for r in named.where("kind = 'etf'").collect()} == {"I1": ("New", "Gold", "G", "nse"), "I9": ("Fund 4", "BSE Debt ETF", "A4", "bse"), "I7": ("Other", "Debt", "O", "nse")}
    daily = identities.with_daily(named, spark.createDataFrame([("I1", "X", "X", "X", "EQ"), (None, "Y", "Y", "Y", "EQ")], "isin string, name string, underlying string, symbol string, series string"))
    assert sorted(map(str, daily.collect())) == sorted(map(str, named.collect()))
    indices = spark.createDataFrame([("X", "Index X"), ("Y", "Index Y")], "trading_name string, display_name string")
    more = identities.with_indices(named, indices)
    assert sorted((r.identifier, r.kind, r.name) for r in more.where("kind <> 'etf'").collect()) == [
        ("X", "gross_total_return_index", "Index X TRI"), ("X", "net_total_return_index", "Index X NTR"), ("X", "price_index", "Index X"), ("X", "price_index", "n"), ("Y", "gross_total_return_index", "Index Y TRI"), ("Y", "net_total_return_index", "Index Y NTR"), ("Y", "price_index", "Index Y"),
    ]
    held = identities.with_prices(listings, told)
    assert {(r.security_id, r.isin, r.symbol) for r in held.collect()} == {("1", "I1", "s1"), ("9", "I1", "s9"), ("4", "I9", "s4"), ("2", "I2", "s"), ("3", "I3", "s"), ("3", "I4", "s")}
    moved = identities.with_prices(held, told.where("security_id = '1'").withColumns({"isin": F.lit("I5"), "instrument": F.lit("I5")}))
    assert [tuple(r) for r in identities.identity_changes(held, moved).collect()] == [("BSE", "1", "I5", "I1")]
    assert identities.identity_changes(held, held).count() == 0
