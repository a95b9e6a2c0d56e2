"""Comparisons and the named parts of the quality report."""

import datetime as dt

import pytest

from seriesloom.operators import comparison, quality

D = dt.date


def test_comparison(spark):
    members = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, "C", "y"), (4, "D", None)], "code long, name string, class string")
    nav = spark.createDataFrame([(1, D(2020, 1, 1), 5.0), (1, D(2020, 1, 2), 10.0), (1, D(2020, 1, 3), 20.0), (2, D(2020, 1, 3), 4.0), (3, D(2020, 1, 2), 1.0)], "code long, d date, v double")
    payouts = spark.createDataFrame([(1, D(2020, 1, 2), 0.5), (1, D(2019, 1, 2), 0.5), (2, D(2020, 1, 2), None), (3, D(2020, 1, 2), 1.0)], "code long, d date, amount double")
    found = comparison.side_by_side(members, nav, payouts, [2, 1], "2020-01-02", "2020-01-03")
    assert [tuple(r) for r in found.orderBy("position", "part", "d").collect()] == [
        (1, 2, "B", "point", D(2020, 1, 3), 4.0, 100.0, None), (2, 1, "A", "payout", D(2020, 1, 2), None, None, 0.5), (2, 1, "A", "point", D(2020, 1, 2), 10.0, 100.0, None), (2, 1, "A", "point", D(2020, 1, 3), 20.0, 200.0, None),
    ]
    for codes, end in (([], "2020-01-03"), ([1, 1], "2020-01-03"), ([1, 2, 3, 4, 5, 6], "2020-01-03"), ([1], "2020-01-02"), ([1, 3], "2020-01-03"), ([4], "2020-01-03")):
        with pytest.raises(ValueError):
            comparison.side_by_side(members, nav, payouts, codes, "2020-01-02", end)
    with pytest.raises(LookupError, match="9"):
        comparison.side_by_side(members, nav, payouts, [1, 9], "2020-01-02", "2020-01-03")


def test_reviews_that_are_due(spark):
    gated = spark.createDataFrame([(1, "bonus", "explicit_bonus_option", "S", "b"), (1, "bonus", "explicit_bonus_option", "R", "a"), (2, "distribution", "cash_amount_candidate", "S", "a")], "code long, kind string, gate string, scheme string, label string")
    assert [tuple(r) for r in quality.label_review_items(gated).collect()] == [("bonus", 1, 2, ["R", "S"], ["a", "b"])]
    rows = spark.createDataFrame([(1, "f", "s", "A", "x", D(2020, 1, 1)), (8, "g", "s", "B", "y", D(2020, 1, 2)), (8, "f", "s", "A", "y", D(2020, 1, 1)), (9, "f", "s", "A", "x", D(2020, 1, 1))], "code long, fund string, scheme_code string, scheme string, label string, d date")
    reviews = spark.createDataFrame([(8, 1, 1, "source_only", "e1", None), (8, 1, 2, "mapped", "e2", 1)], "code long, reviewed_at long, id long, status string, evidence string, matched long")
    found = quality.unresolved_identifiers(rows, spark.createDataFrame([(1,)], "code long"), reviews)
    assert sorted(map(tuple, found.collect())) == [(8, 2, ["f", "g"], ["s"], ["A", "B"], ["y"], D(2020, 1, 1), D(2020, 1, 2), "mapped", 2, "e2", 1), (9, 1, ["f"], ["s"], ["A"], ["x"], D(2020, 1, 1), D(2020, 1, 1), None, None, None, None)]
    assert {r.item: r.n for r in quality.review_counts(found).collect()} == {"unreviewed": 1, "source_only": 0, "mapped": 1, "source_error": 0}


def test_runs_and_batches_under_way(spark):
    runs = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "run string, began long")
    assert [r.run for r in quality.latest_run(runs).collect()] == ["c"] and quality.latest_run(runs.limit(0)).count() == 0
    batches = spark.createDataFrame([("x", "running", 2), ("y", "failed", 1), ("z", "running", 1)], "batch string, state string, started long")
    assert [r.batch for r in quality.running_batches(batches).collect()] == ["z", "x"]
