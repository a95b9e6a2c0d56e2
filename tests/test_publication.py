"""Publication of payouts by tier, against the rules row by row, and the reports about it."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import publication, screener

D = dt.date
DAY = D(2020, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(rows, publication.EVENT)


def amfi(spark, rows):
    return spark.createDataFrame([(c, DAY, i, u, v, "Fund", f"Fund - {x}") for i, (c, u, v, x) in enumerate(rows)], "code long, d date, seq long, unit string, value double, scheme string, label string")


def test_normalisation(spark):
    known = spark.createDataFrame([(i,) for i in range(1, 8)], "code long")
    rows = amfi(spark, [
        (1, "amount", 1.0, "IDCW"), (1, "amount", 1.0, "IDCW"), (1, "amount", 2.0, "IDCW"), (1, "amount", 1.0, "IDCW"), (2, "amount", 5.0, "IDCW"), (3, "amount", 4.0, "IDCW"),
        (4, "amount", 1.0, "IDCW"), (4, "amount", 1.0, "Growth"), (5, "ratio", None, "IDCW"), (6, "amount", 0.0, "IDCW"), (9, "amount", 1.0, "IDCW"),
    ])
    before = events(spark, [(2, DAY, 5.0, 2, 3), (3, DAY, 9.0, 3, 1)])
    done = publication.normalise(rows, known, before)
    found = [(r.code, r.action, r.revision) for r in done.orderBy("seq").collect()]
    assert found == [(1, "inserted", 1), (1, "unchanged", 1), (1, "revised", 2), (1, "revised", 3), (2, "unchanged", 3), (3, "revised", 2), (4, "refused", 0), (4, "refused", 0), (5, "blocked", 0), (6, "blocked", 0), (9, "blocked", 0)]
    after = {r.code: (r.amount, r.tier, r.revision) for r in publication.after(before, done).collect()}
    assert after == {1: (1.0, 1, 3), 2: (5.0, 1, 3), 3: (4.0, 1, 2)}
    again = publication.normalise(rows.where("seq in (3, 4, 5)"), known, publication.after(before, done))
    assert {r.action for r in again.collect()} == {"unchanged"}


def registrar_by_row(rows, before, linked):
    """The registrar's rule, one row after another."""
    state = {k: {"cur": a, "tier": t, "rev": r, "keys": set(linked.get(k, ()))} for k, (a, t, r) in before.items()}
    out = []
    for code, day, _, capture, raw, amount in rows:
        s = state.setdefault((code, day), {"cur": None, "tier": None, "rev": 0, "keys": set(), "new": True})
        if s["cur"] is not None and s["cur"] != amount:
            again = s["tier"] == 2 and (capture, raw) in s["keys"]
            if s["tier"] <= 2 and not again:
                out.append(("conflict", s["rev"]))
                if s["tier"] == 2:
                    s["cur"] = None
                continue
            s.update(cur=amount, tier=2, rev=s["rev"] + 1, keys={(capture, raw)})
            out.append(("revised", s["rev"]))
        elif s["cur"] is None:
            if s["tier"] is not None and s["tier"] <= 2:
                out.append(("conflict", s["rev"]))
                continue
            out.append(("inserted" if s.pop("new", False) else "revised", s["rev"] + 1))
            s.update(cur=amount, tier=2, rev=s["rev"] + 1, keys={(capture, raw)})
        else:
            if s["tier"] == 3:
                s.update(tier=2, keys=set())
            s["keys"].add((capture, raw))
            out.append(("linked", s["rev"]))
    return out, {k: (s["cur"], s["tier"], s["rev"]) for k, s in state.items()}


def test_registrar_publication_is_the_rule_row_by_row(spark):
    rng = random.Random(7)
    before = {(c, DAY): (rng.choice([None, 1.0, 2.0]), rng.randint(1, 3), 1) for c in range(0, 300) if c % 4}
    linked = {k: {("k", str(rng.randint(0, 2)))} for k, (a, t, _) in before.items() if a is not None and t == 2}
    rows = [(c, DAY, c * 10 + i, "k", str(rng.randint(0, 2)), float(rng.randint(1, 2))) for c in range(300) for i in range(rng.randint(1, 6))]
    wanted, left = registrar_by_row(rows, before, linked)
    df = spark.createDataFrame(rows, "code long, d date, seq long, capture string, raw string, amount double").withColumn("state", F.lit("mapped"))
    old = events(spark, [(*k, *v) for k, v in before.items()])
    behind = [(*k, -i, *x, before[k][0]) for i, (k, xs) in enumerate(sorted(linked.items()), 1) for x in xs]
    stored = spark.createDataFrame(behind, "code long, d date, seq long, capture string, raw string, amount double")
    links = spark.createDataFrame([("registrar", r[2], r[0], r[1], 1) for r in behind], publication.LINK)
    done = publication.publish_registrar(df, old, links, stored)
    assert [(r.action, r.revision) for r in done.orderBy("seq").collect()] == wanted
    assert {(r.code, r.d): (r.amount, r.tier, r.revision) for r in publication.after(old, done).collect()} == left


def runs(publish, rows, events_, links, batches):
    """Actions of each run over its rows, and what all runs leave: rows of a run are those of its batch and before."""
    told, issues = [], None
    for upto in range(1, batches + 1):
        done = publish(rows.where(F.col("batch") <= upto), events_, links, issues)
        told.append({r.seq: (r.action, r.revision) for r in done.collect()})
        own = {"normalise": "regulator", "publish_registrar": "registrar", "publish_third_party": "third_party"}[publish.__name__]
        spark = rows.sparkSession
        events_ = spark.createDataFrame(publication.after(events_, done).collect(), publication.EVENT)
        links = spark.createDataFrame(links.unionByName(publication.new_links(done, own)).collect(), publication.LINK)
        found = publication.new_issues(done, own)
        issues = spark.createDataFrame((found if issues is None else issues.unionByName(found)).collect(), publication.ISSUE)
    return told, {(r.code, r.d): (r.amount, r.tier, r.revision) for r in events_.collect()}, links


def registrar_runs_by_row(rows, batches):
    """The registrar's rule with its ledger, one row after another, run after run: over rows (code, seq, batch, origin, amount)."""
    state, linked, told = {}, {}, []
    for upto in range(1, batches + 1):
        now = {}
        for code, seq, batch, origin, amount in rows:
            if batch > upto:
                continue
            if seq in linked:
                now[seq] = ("unchanged", linked[seq])
                continue
            s = state.setdefault(code, {"cur": None, "tier": None, "rev": 0, "keys": set()})
            again = s["cur"] is not None and s["cur"] != amount and origin in s["keys"]
            if s["cur"] == amount:
                now[seq], linked[seq] = ("linked", s["rev"]), s["rev"]
                s["keys"].add(origin)
            elif again or s["tier"] is None:
                now[seq] = ("revised" if again else "inserted", s["rev"] + 1)
                s.update(cur=amount, tier=2, rev=s["rev"] + 1, keys={origin})
                linked[seq] = s["rev"]
            else:
                now[seq] = ("conflict", s["rev"])
                s["cur"] = None
        told.append(now)
    return told, {(c, DAY): (s["cur"], s["tier"], s["rev"]) for c, s in state.items()}


def test_registrar_runs_again(spark):
    rng = random.Random(11)
    rows = [(c, c * 10 + i, rng.randint(1, 3), ("k", str(rng.randint(0, 2)), rng.choice([None, "x"]), 1.0, None), float(rng.randint(1, 2))) for c in range(120) for i in range(rng.randint(1, 6))]
    wanted, left = registrar_runs_by_row(rows, 4)
    df = spark.createDataFrame([(c, s, b, *o, a) for c, s, b, o, a in rows], "code long, seq long, batch int, capture string, raw string, other_raw string, ex_nav double, cum_nav double, amount double").withColumns({"d": F.lit(DAY), "state": F.lit("mapped")})

    def publish_registrar(rows, events_, links, _):
        return publication.publish_registrar(rows, events_, links)

    told, events_, links = runs(publish_registrar, df, events(spark, []), spark.createDataFrame([], publication.LINK), 4)
    assert told == wanted and events_ == left
    assert {x[0] for x in told[3].values()} == {"unchanged", "conflict"}
    assert {s: x for s, x in told[3].items() if x[0] == "unchanged"}.keys() == {r.seq for r in links.collect()}


def test_a_second_run_changes_nothing(spark):
    known = spark.createDataFrame([(1,), (2,)], "code long")
    rows = amfi(spark, [(1, "amount", 1.0, "IDCW"), (1, "amount", 1.5, "IDCW"), (2, "amount", 5.0, "IDCW"), (2, "amount", 5.0, "IDCW"), (9, "amount", 5.0, "IDCW")]).withColumn("batch", F.lit(1))

    def normalise(rows, events_, links, _):
        return publication.normalise(rows, known, events_, links)

    told, events_, links = runs(normalise, rows, events(spark, []), spark.createDataFrame([], publication.LINK), 3)
    assert told[0] == {0: ("inserted", 1), 1: ("revised", 2), 2: ("inserted", 1), 3: ("unchanged", 1), 4: ("blocked", 0)}
    assert told[1] == told[2] == {0: ("unchanged", 1), 1: ("unchanged", 2), 2: ("unchanged", 1), 3: ("unchanged", 1), 4: ("blocked", 0)}
    assert events_ == {(1, DAY): (1.5, 1, 2), (2, DAY): (5.0, 1, 1)} and links.count() == 4
    late = amfi(spark, [(1, "amount", 1.0, "IDCW"), (1, "amount", 1.5, "IDCW"), (2, "amount", 5.0, "IDCW"), (2, "amount", 5.0, "IDCW"), (1, "amount", 1.0, "IDCW")])
    now = publication.normalise(late, known, events(spark, [(*k, *v) for k, v in events_.items()]), links).where("seq = 4").first()
    assert (now.action, now.revision) == ("revised", 3)
    for broken in (rows.where("seq <> 0"), rows.withColumn("unit", F.when(F.col("seq") == 0, "ratio").otherwise(F.col("unit")))):
        with pytest.raises(Exception, match="no longer a cash amount candidate"):
            publication.normalise(broken, known, events(spark, []), links).collect()


def test_third_party_runs_again(spark):
    rows = [(1, 1.0, 1), (1, 1.0, 2), (2, 1.0, 1), (2, 2.0, 1), (3, 1.0, 1), (3, 2.0, 2), (4, 7.0, 2)]
    df = spark.createDataFrame([(c, DAY, i, a, b, "r1") for i, (c, a, b) in enumerate(rows)], "code long, d date, seq long, amount double, batch int, review string")
    told, events_, links = runs(publication.publish_third_party, df, events(spark, []), spark.createDataFrame([], publication.LINK), 3)
    assert told[0] == {0: ("inserted", 1), 2: ("blocked", 0), 3: ("blocked", 0), 4: ("inserted", 1)}
    assert told[1] == {0: ("unchanged", 1), 1: ("linked", 1), 2: ("skipped", None), 3: ("skipped", None), 4: ("unchanged", 1), 5: ("blocked", 1), 6: ("inserted", 1)}
    assert told[2] == {0: ("unchanged", 1), 1: ("unchanged", 1), 2: ("skipped", None), 3: ("skipped", None), 4: ("unchanged", 1), 5: ("skipped", None), 6: ("unchanged", 1)}
    assert events_ == {(1, DAY): (1.0, 3, 1), (3, DAY): (None, 3, 1), (4, DAY): (7.0, 3, 1)}
    issues = publication.new_issues(publication.publish_third_party(df, events(spark, [])), "third_party")
    other = publication.publish_third_party(df.withColumn("review", F.lit("r2")), events(spark, []), None, issues)
    assert "skipped" not in {r.action for r in other.collect()}
    first = publication.publish_third_party(df, events(spark, []), most_options=2)
    assert {r.code for r in first.where("action <> 'waiting'").collect()} == {1, 2}
    with pytest.raises(ValueError):
        publication.publish_third_party(df, events(spark, []), most_options=0)


def test_what_is_resumed_has_to_be_stored(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "house string, payload int")
    assert publication.require_stored(stored.limit(1), stored, ["house", "payload"], "a capture").count() == 1
    with pytest.raises(ValueError, match="a capture has to be imported first: missing 1"):
        publication.require_stored(spark.createDataFrame([("a", 1), ("b", 3)], "house string, payload int"), stored, ["house", "payload"], "a capture")


def test_registrar_rows_that_are_held_back(spark):
    rows = spark.createDataFrame([(1, "mapped", D(1950, 1, 1), 1, "k", "r", 1.0), (1, "ambiguous", DAY, 2, "k", "r", 1.0), (None, "unresolved", DAY, 3, "k", "r", 1.0)], "code long, state string, d date, seq long, capture string, raw string, amount double")
    found = publication.publish_registrar(rows, events(spark, [])).orderBy("seq").collect()
    assert [(r.issue, r.action) for r in found] == [("implausible_record_date", "blocked"), ("ambiguous_scheme", "blocked"), ("unmapped_scheme", "blocked")]


def test_third_party_publication(spark):
    rows = [(1, 1.0), (1, 1.0), (2, 1.0), (2, 2.0), (3, 1.0), (4, 1.0), (5, 1.0), (6, 1.0), (7, 1.0)]
    df = spark.createDataFrame([(c, D(1950, 1, 1) if c == 7 else DAY, i, a) for i, (c, a) in enumerate(rows)], "code long, d date, seq long, amount double")
    before = events(spark, [(3, DAY, 2.0, 1, 1), (4, DAY, 2.0, 3, 1), (5, DAY, None, 2, 1), (6, DAY, 1.0, 1, 1)])
    done = publication.publish_third_party(df, before)
    assert [(r.code, r.action, r.issue) for r in done.orderBy("seq").collect()] == [
        (1, "inserted", None), (1, "inserted", None), (2, "blocked", "same_priority_conflict"), (2, "blocked", "same_priority_conflict"), (3, "blocked", "higher_priority_conflict"), (4, "blocked", "same_priority_conflict"),
        (5, "blocked", "same_priority_conflict"), (6, "linked", None), (7, "blocked", "implausible_record_date"),
    ]
    assert {r.code: (r.amount, r.tier) for r in publication.after(before, done).collect()} == {1: (1.0, 3), 3: (2.0, 1), 4: (None, 3), 5: (None, 2), 6: (1.0, 1)}


def test_notices_fail_on_contradiction(spark):
    rows = spark.createDataFrame([(1, DAY, 1, 1.0), (2, DAY, 1, 3.0)], "code long, d date, seq long, amount double")
    done = publication.publish_notice(rows, events(spark, [(2, DAY, 3.0, 2, 4)]))
    assert {r.code: (r.action, r.revision) for r in done.collect()} == {1: ("inserted", 1), 2: ("linked", 4)}
    with pytest.raises(Exception, match="contradicts"):
        publication.publish_notice(rows, events(spark, [(2, DAY, 4.0, 2, 4)])).collect()


METADATA = [
    (1, "Aditya Birla Sun Life Gold Index Fund - Direct Plan - IDCW Payout", "ABSL Mutual Fund", "direct", "idcw"), (2, "Aditya Birla Sun Life Gold Index Fund - Regular - IDCW", "ABSL Mutual Fund", "regular", "idcw"),
    (3, "ABSL Gold Index Growth", "ABSL Mutual Fund", "direct", "growth"), (4, "Balanced Advantage Fund - IDCW Plan - Direct Plan", "HDFC Mutual Fund", "direct", "idcw"), (5, "Balanced Advantage Fund Monthly Reinvestment - Direct", "HDFC Mutual Fund", "direct", "idcw"),
]


def test_registrar_mapping(spark):
    meta = spark.createDataFrame(METADATA, "code long, name string, house string, plan string, option string")
    captures = spark.createDataFrame([("a", "ABSL Gold Index Dir Dividend (formerly known as Silver)", "direct"), ("b", "Birla Sun Life Gold Index Fund", "unknown"), ("c", "Other", "unknown")], "capture string, name string, plan string")
    assert sorted(map(tuple, publication.registrar_candidates(captures, meta).collect())) == [("a", 1), ("b", 1), ("b", 2)]
    nav = spark.createDataFrame([(1, DAY, 10.0), (2, DAY, 10.0), (2, D(2020, 1, 2), 11.0)], "code long, d date, v double")
    evidence = spark.createDataFrame([("a", DAY, 10.0), ("b", DAY, 10.0), ("c", DAY, 10.0)], "capture string, d date, value double")
    assert {r.capture: (r.state, r.code) for r in publication.map_registrar(captures, evidence, meta, nav).collect()} == {"a": ("mapped", 1), "b": ("ambiguous", None), "c": ("unresolved", None)}


def test_third_party_mapping(spark):
    meta = spark.createDataFrame(METADATA, "code long, name string, house string, plan string, option string")
    captures = spark.createDataFrame([("a", "Balanced Advtg Dir IDCW", "HDFC"), ("b", "Balanced Dir Mly Reinv", "HDFC Mutual Fund"), ("c", "Balanced Advtg Reg", "HDFC")], "capture string, name string, house string")
    days = [D(2020, 1, 1), D(2020, 1, 20), D(2020, 2, 20)]
    nav = spark.createDataFrame([(4, d, 10.0) for d in days] + [(5, d, 12.0) for d in days], "code long, d date, v double")
    sampled = lambda v, n: spark.createDataFrame([(c, d, v) for c in "ab" for d in days[:n]], "capture string, d date, value double")
    assert sorted(map(tuple, publication.third_party_pairs(captures, sampled(10.0, 1), meta, nav).collect())) == [("a", 4, True), ("a", 5, True), ("b", 4, False)]
    state = lambda v, n: {r.capture: (r.state, r.code) for r in publication.map_third_party(captures, sampled(v, n), meta, nav).collect()}
    assert state(10.0, 3) == {"a": ("mapped", 4), "b": ("mapped", 4), "c": ("unresolved", None)}
    assert state(10.0, 1) == {"a": ("mapped", 4), "b": ("unresolved", None), "c": ("unresolved", None)} and state(99.0, 3)["a"] == ("unresolved", None)


def test_pilot_report(spark):
    meta = spark.createDataFrame(METADATA, "code long, name string, house string, plan string, option string")
    h = "HDFC Mutual Fund"
    captures = spark.createDataFrame(
        [("a", "Balanced Advantage Dir IDCW", h, "direct", "monthly", "unknown"), ("b", "Balanced Advantage Dir", h, "direct", "monthly", "quarterly"), ("c", "Balanced Advantage Dir", h, "regular", "unknown", "unknown"), ("d", "Balanced Advantage", h, "unknown", "monthly", "monthly"), ("e", "Balanced Advantage", h, "direct", "x", "x")],
        "capture string, name string, house string, plan string, source_frequency string, display_frequency string",
    )
    days = [D(2020, 1, 1), D(2020, 1, 20), D(2020, 2, 20), D(2020, 3, 20)]
    nav = spark.createDataFrame([(4, d, 10.0) for d in days[:3]] + [(5, d, 12.0) for d in days], "code long, d date, v double")
    rows = spark.createDataFrame([(c, d, 10.0, i > 0) for c in "abcd" for i, d in enumerate(days[:2] if c == "d" else days)], "capture string, d date, value double, positive boolean")
    found = {r.capture: (r.source_rows, r.zero_rows, r.candidates, r.qualified, r.matches, r.conflicts, r.missing, r.state, r.code, r.reason) for r in publication.pilot_report(captures, rows, meta, nav).collect()}
    assert found == {
        "a": (4, 1, 2, 1, 3, 4, 1, "mapped", 4, "one_candidate_qualifies"), "b": (4, 1, 2, 1, 3, 4, 1, "unresolved", None, "frequency_conflict"), "c": (4, 1, 0, 0, 0, 0, 0, "unresolved", None, "no_name_and_plan_candidate"),
        "d": (2, 1, 2, 0, 2, 2, 0, "unresolved", None, "too_few_source_rows"), "e": (0, 0, 2, 0, 0, 0, 0, "unresolved", None, "too_few_source_rows"),
    }


def test_coverage_and_blockers(spark):
    options = spark.createDataFrame([(1,), (2,), (3,)], "code long")
    sources = spark.createDataFrame([(1, DAY), (1, DAY), (2, DAY)], "code long, d date")
    found = publication.coverage(options, sources, sources.where("code = 1").limit(1), events(spark, [(1, DAY, 1.0, 1, 1), (2, DAY, None, 2, 1)]))
    assert {r.code: (r.status, r.source_rows, r.blocked_rows, r.events) for r in found.collect()} == {1: ("events_present", 2, 1, 1), 2: ("blocked_source_rows", 1, 1, 0), 3: ("unverified_empty", 0, 0, 0)}
    gates = {r.gate: (r.rows, r.options) for r in publication.blockers(found, spark.createDataFrame([(1, "unknown_option_label"), (2, "ratio_source_value")], "code long, gate string")).collect()}
    assert len(gates) == 10 and gates["ratio_source_value"] == (1, 1) and gates["unknown_option_label"] == (0, 0)


def test_backlog(spark):
    captures = spark.createDataFrame([("a", "cams", "A", 5), ("b", "advisorkhoj", "B", 3), ("c", "advisorkhoj", "C", 0), ("d", "cams", "D", 9)], "capture string, provider string, name string, rows long")
    say = lambda **x: json.dumps({"candidate_codes": [], "qualifying_codes": [], "candidates": []} | x)
    reviews = [("a", 1, 1, "unresolved", say()), ("a", 2, 2, "ambiguous", say(candidate_codes=["1", "2"])), ("b", 1, 3, "unresolved", say(candidate_codes=["1"], candidates=[{"conflicts": ["x"]}])), ("c", 1, 4, "unresolved", say()), ("d", 1, 5, "mapped", say())]
    df = spark.createDataFrame(reviews, "capture string, reviewed_at long, id long, state string, evidence string")
    open_ = publication.backlog(captures, df)
    assert {r.capture: (r.state, r.reason) for r in open_.collect()} == {"a": ("ambiguous", "multiple_exact_name_plan_nav_candidates"), "b": ("unresolved", "comparable_nav_conflict"), "c": ("unresolved", None)}
    assert {r.provider: (r.ambiguous_rows, r.unresolved_captures, r.unresolved_empty) for r in publication.backlog_summary(open_).collect()} == {"cams": (5, 0, 0), "advisorkhoj": (0, 1, 1)}
    assert [r.capture for r in publication.backlog_ranked(open_).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="contradicts"):
        publication.backlog(captures, spark.createDataFrame([("a", 1, 1, "ambiguous", say(candidate_codes=["1"]))], df.schema)).collect()


def test_screener_pages(spark):
    members = spark.createDataFrame([(1, "Alpha", "H", "equity", "direct", "idcw", "I1"), (2, "Beta", "H", "equity", "direct", "idcw", "I2"), (3, "Gamma", "H", "equity", "direct", "idcw", None), (4, "Delta", "H", "equity", "direct", "idcw", "I4"), (5, "Eps_", "G", "equity", "direct", "growth", None)], "code long, name string, house string, class string, plan string, option string, isin string")
    nav = spark.createDataFrame([(c, d, v) for c in (1, 2, 5) for d, v in ((D(2020, 1, 1), 100.0), (D(2021, 1, 1), 121.0))] + [(4, D(2021, 3, 1), 5.0)], "code long, d date, v double")
    paid = spark.createDataFrame([(1, D(2020, 1, 1), 50.0), (1, D(2020, 6, 1), 3.0)], "code long, d date, amount double")
    found = screener.candidates(members, classes=["equity"], plan="direct", option="idcw")
    rows = screener.screened(found, nav, paid, "2021-01-01")
    page = {r.code: r for r in screener.page(rows, by_payouts=True).collect()}
    assert (page[1].part, page[1].place, round(page[1].yield_pct, 6)) == ("ranked", 1, round(300 / 121, 6)) and page[2].status == "no_payout_events" and page[4].status == "stale_endpoint" and page[4].end_day is None
    assert (page[1].candidates, page[1].total, page[1].no_payouts) == (3, 1, 1) and page[4].reason_detail == "no valid value on or before 2021-01-01"
    growth = screener.candidates(members, classes=["equity"], plan="direct", option="growth", search="S_")
    assert [r.code for r in growth.collect()] == [5] and screener.page(screener.screened(growth, nav, None, "2021-01-01"), by_payouts=False).first().return_pct == pytest.approx(20.94, abs=0.02)
    with pytest.raises(ValueError):
        screener.screened(found, nav, paid, "2021-01-01", "3y")
