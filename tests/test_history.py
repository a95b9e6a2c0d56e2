"""Families, aliases, repairs, provenance and the single-file export, by worked examples."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import aliases, lifecycle, provenance, publication, repairs
from seriesloom.sources import sinks

D = dt.date
DAY = D(2020, 1, 1)


def test_families_from_snapshot_to_snapshot(spark):
    rows = [("f", 1, "a", "A"), ("f", 1, "b", "B"), ("f", 3, "a", "A2"), ("f", 3, "c", "C"), ("f", 7, "b", "B9"), ("f", 7, "c", "C"), ("g", 2, "a", "A")]
    members = spark.createDataFrame(rows, "fund string, snapshot int, family string, name string")
    snapshots = spark.createDataFrame([("f", 1), ("f", 3), ("f", 7), ("g", 2), ("g", 5)], "fund string, snapshot int")
    changed = lifecycle.changes(members, snapshots)
    assert sorted(map(tuple, changed.collect()), key=str) == sorted([
        ("f", "a", 2, "renamed", "A", "A2"), ("f", "a", 3, "removed", "A2", None), ("f", "b", 2, "removed", "B", None), ("f", "b", 3, "added", None, "B9"), ("f", "b", 3, "renamed", "B", "B9"), ("f", "c", 2, "added", None, "C"), ("g", "a", 2, "removed", "A", None),
    ], key=str)
    held = spark.createDataFrame([("f", "a")], "fund string, family string")
    assert sorted(map(tuple, lifecycle.issues(changed, held).collect())) == [
        ("f", "a", 2, "name_changed_without_effective_date"), ("f", "a", 3, "catalog_member_removed"), ("f", "b", 2, "catalog_member_removed"), ("g", "a", 2, "catalog_member_removed"),
    ]
    assert sorted(map(tuple, lifecycle.latest(members, snapshots).collect())) == [("f", "b", "B9"), ("f", "c", "C")]


def test_launches(spark):
    rows = [("f", "a", "f", "a", DAY, 1), ("f", "a", "f", "a", DAY, 2), ("f", "a", "f", "a", D(2021, 1, 1), 3), ("f", "b", "f", "b", None, 4), ("g", "c", "f", "c", DAY, 5), ("f", "d", "f", "d", DAY, 6)]
    details = spark.createDataFrame(rows, "fund string, family string, asked_fund string, asked_family string, day date, seq long")
    events, issues = lifecycle.launches(details)
    assert sorted(map(tuple, events.collect())) == [("f", "a", DAY, 1), ("f", "a", D(2021, 1, 1), 3), ("f", "d", DAY, 6)]
    assert sorted(map(tuple, issues.collect())) == [("f", "a", 3, "launch_date_conflict"), ("f", "b", 4, "missing_launch_date"), ("f", "c", 5, "identity_mismatch")]
    again, more = lifecycle.launches(details, events)
    assert again.count() == 0 and sorted(r.issue for r in more.collect()) == ["identity_mismatch", "missing_launch_date"]
    late, clash = lifecycle.launches(details.where("seq = 1").withColumn("day", F.lit(D(2019, 1, 1))), events)
    assert late.count() == 1 and [r.issue for r in clash.collect()] == ["launch_date_conflict"]


def test_counters_have_to_add_up(spark):
    names = "funds_total funds_completed funds_failed families_total families_completed families_skipped families_failed details_received details_inserted details_unchanged details_rejected".split()
    frame = lambda *v: spark.createDataFrame([v], ", ".join(f"{n} long" for n in names))
    assert lifecycle.reconciled(frame(2, 1, 1, 5, 3, 1, 1, 3, 1, 1, 1)).count() == 1
    for bad, what in ((frame(1, 1, 1, 5, 3, 1, 1, 3, 1, 1, 1), "funds are done"), (frame(2, 1, 1, 4, 3, 1, 1, 3, 1, 1, 1), "families are done"), (frame(2, 1, 1, 5, 3, 1, 1, 3, 1, 1, 0), "accounted for")):
        with pytest.raises(Exception, match=what):
            lifecycle.reconciled(bad).collect()


def store(spark):
    held = spark.createDataFrame([("x", "Gold", "gold", "open", "active", 2), ("y", "Debt", "debt", "open", "active", 1), ("z", "Old", "old", "open", "inactive", 3)], aliases.ALIAS)
    members = spark.createDataFrame([("c1", "x"), ("c2", "x"), ("c3", "y")], aliases.MEMBER)
    classes = spark.createDataFrame([(f"c{i}", "close" if i == 9 else "open", f"Class {i}") for i in range(1, 10)], "classification string, structure string, shown string")
    return held, members, classes, spark.createDataFrame([("x", 1, "Gold", "gold", "open", "active", ["c1"], "because")], aliases.REVISION)


CASES = [
    ("x", 2, "Gold", "open", "active", ["c1"], "no", "reason"), ("x", 2, "Gold", "open", "active", ["c1"], "x" * 501, "reason"), ("q", 1, "New", "open", "active", ["c4"], "because", "not_found"), ("x", 1, "Gold", "open", "active", ["c1"], "because", "stale"),
    ("x", 0, "Gold", "open", "active", ["c1"], "because", "stale"), ("x", 2, "  ", "open", "active", ["c1"], "because", "blank_name"), ("x", 2, "g" * 101, "open", "active", ["c1"], "because", "long_name"), ("x", 2, "Gold", "open", "active", [], "because", "no_members"),
    ("x", 2, "Gold", "open", "inactive", ["c1"], "because", "members_of_inactive"), ("x", 2, "Gold", "open", "active", ["c1", "c1"], "because", "repeated_members"), ("x", 2, " DEBT ", "open", "active", ["c1"], "because", "name_taken"), ("x", 2, "Gold", "open", "active", ["c77"], "because", "unknown_members"),
    ("x", 2, "Gold", "open", "active", ["c9"], "because", "other_structure"), ("x", 2, "Gold", "open", "active", ["c3"], "because", "members_taken"), ("x", 2, "Gold", "open", "active", [f"k{i}" for i in range(201)], "because", "too_many_members"),
    ("x", 2, "Gold  fund", "open", "active", ["c1", "c4"], "because", "updated"), ("x", 2, "Gold", "open", "inactive", [], "because", "updated"), ("n", 0, "Debt", "close", "active", ["c9"], "because", "created"),
]


def test_every_change_has_its_outcome(spark):
    held, members, classes, _ = store(spark)
    for i, (*change, outcome) in enumerate(CASES):
        told = aliases.judged(spark.createDataFrame([(i, *change)], aliases.CHANGE), held, members, classes)
        assert [r.outcome for r in told.collect()] == [outcome], change


def test_a_batch_of_changes(spark):
    held, members, classes, past = store(spark)
    changes = spark.createDataFrame([
        (1, "x", 2, " Gold  fund", "open", "active", ["c4", "c1"], " by   rule "), (2, "y", 1, "Debt", "open", "active", ["c3", "c4"], "because"), (3, "n", 0, "gold FUND", "open", "active", ["c5"], "because"), (4, "m", 0, "Mixed", "open", "active", ["c6"], "because"), (5, "m", 0, "Mixed again", "open", "active", ["c7"], "because"),
    ], aliases.CHANGE)
    told = aliases.judged(changes, held, members, classes)
    assert {r.seq: r.outcome for r in told.collect()} == {1: "updated", 2: "contested", 3: "contested", 4: "created", 5: "contested"}
    left, own, revisions = aliases.applied(told, held, members, past)
    assert {r.alias: (r.name, r.version) for r in left.collect()} == {"x": ("Gold fund", 3), "y": ("Debt", 1), "z": ("Old", 3), "m": ("Mixed", 1)}
    assert sorted(map(tuple, own.collect())) == [("c1", "x"), ("c3", "y"), ("c4", "x"), ("c6", "m")]
    listing = {r.alias: r for r in aliases.listed(left, own, revisions, classes).collect()}
    assert [tuple(s) for s in listing["x"].sources] == [("Class 1", "c1"), ("Class 4", "c4")] and [(v.version, v.members, v.reason) for v in listing["x"].revisions] == [(3, ["c1", "c4"], "by rule"), (1, ["c1"], "because")]
    assert listing["z"].sources is None
    seeds = spark.createDataFrame([("gold", "Gold funds", "open", "Class 1"), ("gold", "Gold funds", "open", "Class 2")], "alias string, name string, structure string, shown string")
    names = classes.select("classification", F.concat(F.lit("Only "), "shown").alias("name"))
    made = aliases.judged(aliases.seeded(classes, seeds, names), held.limit(0), members.limit(0), classes)
    assert {r.outcome for r in made.collect()} == {"created"} and {r.alias: r.members for r in made.collect()}["gold"] == ["c1", "c2"] and made.count() == 8


def test_repairs(spark):
    revisions = spark.createDataFrame([(1, DAY, v, s, i + 1) for i, (v, s) in enumerate([(1.0, "valid"), (1.0, "valid"), (2.0, "valid"), (2.0, "valid"), (2.0, "valid")])] + [(2, DAY, 3.0, "valid", 1), (2, DAY, 3.0, "error", 2)], "code long, d date, v double, status string, revision int")
    links = spark.createDataFrame([(1, DAY, 1, "a"), (1, DAY, 2, "b"), (1, DAY, 3, "c"), (1, DAY, 4, "c"), (1, DAY, 5, "d"), (2, DAY, 2, "e")], "code long, d date, revision int, batch string")
    kept, moved = repairs.collapsed(revisions, links)
    assert sorted((r.code, r.revision, r.v) for r in kept.collect()) == [(1, 1, 1.0), (1, 2, 1.0), (1, 3, 2.0), (2, 1, 3.0), (2, 2, 3.0)]
    assert sorted((r.code, r.revision, r.batch) for r in moved.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 3, "d"), (2, 2, "e")]
    old = D(1950, 1, 1)
    events = spark.createDataFrame([(1, old, 1.0, 2, 1), (1, DAY, 1.0, 2, 1)], publication.EVENT)
    tied = spark.createDataFrame([("registrar", 1, 1, old, 1), ("third_party", 2, 1, old, 1), ("regulator", 3, 1, DAY, 1)], publication.LINK)
    reviews = spark.createDataFrame([(2, "r2"), (3, "r3")], "seq long, review string")
    left, held, issues = repairs.retracted(events, tied, reviews)
    assert [r.d for r in left.collect()] == [DAY] and [r.seq for r in held.collect()] == [3]
    assert sorted(map(tuple, issues.collect()), key=str) == sorted([("registrar", 1, None, "implausible_record_date"), ("third_party", 2, "r2", "implausible_record_date")], key=str)
    with pytest.raises(Exception, match="primary provenance"):
        repairs.retracted(events, tied.withColumn("d", F.lit(old)), reviews)[2].collect()


def test_drill_down_pages(spark):
    days = [D(2020, 1, i) for i in range(1, 6)]
    revisions = spark.createDataFrame([(1, d, r, float(r), r == 2, dt.datetime(2021, 1, r)) for d in days for r in (1, 2)], "code long, d date, revision int, amount double, current boolean, at timestamp")
    links = spark.createDataFrame([("regulator", 7, 1, days[4], 2), ("registrar", 8, 1, days[4], 2), ("registrar", 9, 1, days[0], 1)], publication.LINK)
    batches = spark.createDataFrame([("b1", "u1", dt.datetime(2021, 5, 1), "p", "s1"), ("b2", "u2", dt.datetime(2021, 4, 1), "p", None)], "batch string, url string, retrieved_at timestamp, parser string, sha256 string")
    rows = spark.createDataFrame([(7, "m", "s", "o", "Fund", "Fund - IDCW", days[4], "1.0", "amount", "sig")], "seq long, fund string, scheme string, option string, scheme_name string, shown_name string, d date, raw string, unit string, signature string")
    seen = spark.createDataFrame([(7, "b1"), (7, "b2")], "seq long, batch string")
    registrar = spark.createDataFrame([(8, "k", days[4], "2", "x"), (9, "k", days[0], "2", "y")], "seq long, capture string, d date, raw string, signature string")
    captures = spark.createDataFrame([("k", "cams", "f", "s", "Fund", "direct", "payout", "u", dt.datetime(2021, 4, 15), "b1")], "capture string, provider string, fund string, scheme string, scheme_name string, plan string, variant string, url string, captured_at timestamp, batch string")
    reviews = spark.createDataFrame([("k", "{}")], "capture string, evidence string")
    records = [provenance.from_regulator(links, rows, seen, batches), provenance.from_registrars(links, registrar, captures, reviews, batches)]
    coverage = spark.createDataFrame([(1, "events_present", 3)], "code long, status string, source_rows long")
    found = provenance.drill_down(revisions, records, coverage, limit=2, offset=0).orderBy("place").collect()
    assert [(r.d, r.place, r.total) for r in found] == [(days[4], 1, 5), (days[3], 2, 5)] and found[0].coverage.status == "events_present"
    assert [(v.revision, v.current, [(s.provider, s.batch, s.sha256) for s in v.sources]) for v in found[0].revisions] == [(2, True, [("amfi", "b2", None), ("cams", "b1", "s1"), ("amfi", "b1", "s1")]), (1, False, [])]
    assert found[0].revisions[0].sources[1].shown_name == "Fund - Direct - Payout" and found[0].revisions[0].sources[1].identity_evidence == "{}"
    last = provenance.drill_down(revisions, records, limit=2, offset=4).collect()
    assert [(r.d, len(r.revisions[1].sources)) for r in last] == [(days[0], 1)]
    with pytest.raises(ValueError):
        provenance.drill_down(revisions, records, limit=201)


def test_blocked_options_and_invariants(spark):
    options = spark.createDataFrame([(1, "A"), (2, "B")], "code long, name string")
    rows = spark.createDataFrame([(1, DAY), (1, DAY), (1, D(2020, 2, 1))], "code long, d date")
    none = spark.createDataFrame([], publication.EVENT)
    assessed = publication.coverage(options, rows, rows.limit(0), none)
    gated = spark.createDataFrame([(1, "ratio_source_value"), (1, "ratio_source_value")], "code long, gate string")
    found = publication.blocked_options(assessed, gated, options).collect()
    assert [(r.code, r.name, r.source_rows, r.regulator_rows, r.other_rows, r.gates, r.last_day) for r in found] == [(1, "A", 3, 2, 1, {"ratio_source_value": 2}, D(2020, 2, 1))]
    with pytest.raises(Exception, match="regulator's rows exceed"):
        publication.blocked_options(assessed, gated.union(gated), options).collect()
    with pytest.raises(Exception, match="links exceed"):
        publication.coverage(options, rows.limit(1), rows, none).collect()
    with pytest.raises(Exception, match="events exceed"):
        publication.coverage(options, rows, rows.limit(0), spark.createDataFrame([(1, DAY, 1.0, 1, 1)], publication.EVENT)).collect()


def test_single_file_export(spark, tmp_path):
    path = str(tmp_path / "out" / "export.csv")
    (tmp_path / "out").mkdir()
    df = spark.createDataFrame([(3, "=sum", 1.5, D(2020, 1, 2)), (1, None, 2.0, None), (2, 'say "a, b"', 0.1234567, D(2020, 1, 1))], "k int, t string, v double, d date").repartition(3)
    for _ in range(2):
        told = sinks.write_single_csv(df, path, ["k"], assumptions=["a"], limitations=["b"])
        content = (tmp_path / "out" / "export.csv").read_bytes()
        assert content.decode() == '﻿k,t,v,d\n1,,2,\n2,"say ""a, b""",0.123457,2020-01-01\n3,\'=sum,1.5,2020-01-02\n'
        assert told["sha256"] == hashlib.sha256(content).hexdigest() and told["rows"] == 3 and told["bytes"] == len(content)
        assert json.loads((tmp_path / "out" / "export.csv.manifest.json").read_text()) == told
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["export.csv", "export.csv.manifest.json"]
    sinks.write_single_csv(df.limit(0), path, ["k"])
    assert (tmp_path / "out" / "export.csv").read_text() == "﻿k,t,v,d\n"
