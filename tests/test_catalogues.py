"""Catalogues, third-party histories, notices, label gates and ledgers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import labels
from seriesloom.operators import ledgers
from seriesloom.sources import catalogues


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "source string, payload string")


def test_fund_catalogue(spark):
    pair = lambda i, n: f'\\\\"mf_id\\\\":\\\\"{i}\\\\",\\\\"mf_name\\\\":\\\\"{n}\\\\",\\\\"amc_name\\\\":\\\\"x\\\\"'.replace("\\\\", "\\")
    pairs = ",".join(pair(i, f"Fund \\u0026 {i}") for i in range(10))
    rows = catalogues.fund_catalogue(files(spark, f"<html>{pairs}</html>", pair(1, "A"), f"{pairs},{pair(3, 'Other')}")).collect()
    by = {(r.source, r.fund_id): r for r in rows}
    assert len([k for k in by if k[0] == "f0"]) == 10 and by["f0", 3].error is None and by["f0", 3].fund_name == "Fund & 3" and by["f1", 1].error == "too_few" and by["f2", 3].error == "conflict"


def detail(**more):
    base = {"MF_Name": "House", "Scheme_Name": "Fund", "Scheme_Objective": "", "SchemeType_Desc": "Open Ended", "SchemeCat_Desc": "Equity", "Launch_Date": "2021-04-19T00:00:00+05:30", "Scheme_load": "", "Scheme_min_amt": "500", "AMC_Website": "", "scheme_Id": 12233, "MF_Id": 3}
    return base | more


def test_scheme_details(spark):
    rows = [detail(), detail(Launch_Date=None), detail(Launch_Date="2020-01-02"), detail(Launch_Date="2020-01-02T00:00:00+00:00"), detail(MF_Id="x"), detail(Scheme_Name=" "), {k: v for k, v in detail().items() if k != "Scheme_load"}]
    found = catalogues.scheme_details(files(spark, json.dumps({"data": rows}), '{"data": []}')).orderBy("source", "position").collect()
    assert [(str(r.launch_day), r.error) for r in found[:4]] == [("2021-04-19", None), ("None", None), ("None", "launch_date"), ("None", "launch_date")]
    assert [r.error for r in found[4:]] == ["bad_code", "no_name", "keys", "no_records"]


def watch(code, name, day="2025-01-02", **more):
    own = {k: "1" for k in catalogues.WATCH_KEYS} | {"Scrip_cd": code, "EtfAlias_Name": f"A{code}", "TYPE": "Gold", "DT_TM": f"{day}T10:00:00"}
    return own | {name: "The Fund"} | more


def test_market_watch(spark):
    a, b = watch(1, "ScripName"), watch(2, "ETFNAME")
    payloads = [{"Table": [a, a, watch("3", "ScripName"), watch(-1, "ScripName"), watch(5, "ScripName", TYPE=7)]}, {"Table": [a, b]}, {"Table": [b, watch(4, "ETFNAME", "2025-01-03")]}, {"Table": [], "more": 1}, {"Table": [a | {"x": 1}]}]
    found = catalogues.market_watch(files(spark, *map(json.dumps, payloads))).orderBy("source", "position").collect()
    by = {}
    for r in found:
        by.setdefault(r.source, []).append(r.error)
    assert by == {"f0": [None, "repeated", "bad_code", "bad_code", "category"], "f1": ["mixed_variants"] * 2, "f2": ["as_of"] * 2, "f3": ["no_table"], "f4": ["keys"]}
    assert (found[0].code, found[0].name, str(found[0].as_of), found[0].variant) == ("1", "The Fund", "2025-01-02", "broad_market_watch")
    alias = catalogues.market_watch(files(spark, json.dumps({"Table": [b]}))).first()
    assert (alias.name, alias.variant, alias.error) == ("A2", "categorized_subset", None)


def test_missing_file_page(spark):
    page = "\n<!DOCTYPE html><title>Live Stock/Share Market</title> BSE Sensex www.bseindia.com"
    df = spark.createDataFrame([(page,), (page.replace("Sensex", ""),), ("<html>home</html>",), ("x" * 40000 + page,)], "p string")
    assert [r[0] for r in df.select(catalogues.is_missing_file_page(F.col("p"))).collect()] == [True, False, False, False]


HEAD = "<tr><th>Dividend Record Date</th><th>Dividend (&#8377; / Unit)</th><th>NAV (&#8377;)</th><th>Dividend Yield (%)</th></tr>"


def history(*rows, head=HEAD, name="One Fund IDCW"):
    body = "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows)
    return f"<script>var scheme_name = '{name}';</script><h1>x</h1><table><tr><td>menu</td></tr></table><table id='tbl_dividend_history'>{head}{body}</table>"


def test_history_pages(spark):
    good = [("27-07-2026", "0.2500", "43.273", "0.58%"), ("25-06-2026", "0.2500", "43.446", "0.58%"), ("27-04-2026", "0.2500", "43.679", "0.57%")]
    bad = [("03-02-2025", "1", "8", "12.50%"), ("03-01-2025", "1", "8", "12.51%"), ("03-01-2025", "1", "8", "12.5%"), ("04-01-2025", "1", "8", "12.5%"), ("x", "1", "8", "1%"), ("01-01-2024", "1", "0", "1%"), ("01-01-2023", "1", "8", "12.5"), ("1",)]
    found = catalogues.history_pages(files(spark, history(*good), history(*bad), history(head=HEAD.replace("NAV", "Value")), "<p>none</p>")).orderBy("source", "row").collect()
    assert [r.error for r in found if r.source == "f0"] == [None] * 3 and [r.error for r in found if r.source == "f1"] == [None, "yield", "repeated_day", "order", "bad_date", "bad_value", "bad_value", "columns"]
    assert [(r.source, r.error) for r in found if r.source in ("f2", "f3")] == [("f2", "headers"), ("f3", "tables")]


def test_history_json(spark):
    row = lambda d, v, a, y: {"dividend_date": d, "net_asset_value": v, "dividend_value": a, "dividend_yield": y}
    rows = [row("03-02-2025", 8, 1, 12.5), row("03-01-2025", 8, 1, 12.51), row("03-12-2024", 0, 1, 0), row("03-11-2024", -1, 1, 0), {"dividend_date": "x"}]
    found = catalogues.history_json(files(spark, json.dumps(rows), "null", '{"a": 1}')).orderBy("source", "row").collect()
    assert [(r.source, r.error) for r in found] == [("f0", None), ("f0", "yield"), ("f0", None), ("f0", "bad_value"), ("f0", "keys"), ("f2", "no_array")]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_third_party_captures(spark):
    host = "https://www.advisorkhoj.com"
    page = history(("27-07-2026", "0.2500", "43.273", "0.58%"))
    one = {"schema_version": 1, "provider": "advisorkhoj", "requested_url": f"{host}{catalogues.HISTORY_PATH}One%20Fund%20IDCW", "source_url": f"{host}{catalogues.HISTORY_PATH}One", "captured_at": "2026-08-01T00:00:00Z", "amc_name": "House", "requested_scheme_name": "One Fund IDCW", "source_payload_sha256": sha(page), "source_payload": page}
    two = {"schema_version": 2, "provider": "advisorkhoj", "catalog_sha256": "a" * 64, "source_url": host + catalogues.DETAIL_PATH, "captured_at": "2026-08-01T00:00:00+05:30", "amc_name": "House", "category": "C", "requested_scheme_name": "One", "source_payload_sha256": sha("null"), "source_payload": "null"}
    cases = [(one, None), (two, None), (two | {"catalog_sha256": "b"}, "catalogue"), (two | {"source_payload": "[]"}, "checksum"), (two | {"source_url": "http://x.com"}, "url"), (one | {"captured_at": "2026-08-01T00:00:00"}, "naive_time"), (one | {"requested_scheme_name": "Other"}, "requested"), (one | {"more": 1}, "keys")]
    lines = spark.createDataFrame([(f"f{i}", json.dumps(x)) for i, (x, _) in enumerate(cases)] + [("mixed", json.dumps(two)), ("mixed", json.dumps(two | {"catalog_sha256": "c" * 64, "requested_scheme_name": "Two"})), ("twice", json.dumps(one)), ("twice", json.dumps(one))], "source string, value string")
    found = catalogues.third_party_captures(lines).orderBy("source", "line").collect()
    assert [r.error for r in found if r.source.startswith("f")] == [e for _, e in cases] and [r.error for r in found if r.source == "mixed"] == ["mixed_catalogues"] * 2 and [r.error for r in found if r.source == "twice"] == ["repeated"] * 2


def test_third_party_catalogue(spark):
    landing = "<select id='sel_amcCompanies'><option value=''>Choose</option><option value='A'>A</option><option value='B'>B</option></select>"

    def query(house, schemes):
        names = json.dumps(list(schemes))
        return {"amc_name": house, "categories_payload_sha256": sha(names), "categories_payload": names, "scheme_queries": [{"category": c, "source_payload_sha256": sha(json.dumps(s)), "source_payload": json.dumps(s)} for c, s in schemes.items()]}

    def catalogue(**more):
        base = {"schema_version": 2, "provider": "advisorkhoj", "captured_at": "2026-08-01T00:00:00Z", "source_url": "https://www.advisorkhoj.com/x", "source_payload_sha256": sha(landing), "source_payload": landing, "queries": [query("A", {"equity": ["a1", "a2"], "debt": []}), query("B", {"equity": ["b1"]})]}
        base["schemes"] = [{"amc_name": "A", "category": "equity", "scheme_name": "a1"}, {"amc_name": "A", "category": "equity", "scheme_name": "a2"}, {"amc_name": "B", "category": "equity", "scheme_name": "b1"}]
        return json.dumps(base | more)

    cut = query("A", {"equity": ["a1", "a2"], "debt": []})
    cases = [catalogue(), catalogue(queries=[query("A", {"equity": ["a1"]})]), catalogue(queries=[cut | {"scheme_queries": cut["scheme_queries"][:1]}, query("B", {"equity": ["b1"]})]), catalogue(schemes=[]), catalogue(source_payload_sha256="0" * 64), catalogue(queries=[cut | {"categories_payload_sha256": "x"}, query("B", {"equity": ["b1"]})])]
    found = catalogues.third_party_catalogue(files(spark, *cases)).orderBy("source", "scheme").collect()
    assert [(r.house, r.scheme) for r in found if r.source == "f0"] == [("A", "a1"), ("A", "a2"), ("B", "b1")]
    assert [(r.source, r.error) for r in found if r.source != "f0"] == [("f1", "queries"), ("f2", "categories"), ("f3", "schemes"), ("f4", "checksum"), ("f5", "checksum")]


NOTICE = """HDFC Asset Management Company Limited
NOTICE is hereby given that the Distribution under Income Distribution cum Capital Withdrawal (IDCW) Options is declared and Wednesday, February 25, 2026 is fixed as the Record Date for the same:
Name of the Scheme / Plan(s) / Option(s) Net Asset Value Amount of Distribution Face Value
HDFC Test Fund - Regular Plan - IDCW Option (Payout and Reinvestment) 38.386
0.250 10.00
HDFC Test Fund - Direct Plan - IDCW Option (Payout and Reinvestment) 45.270
#Amount of distribution per unit will be lower."""


def test_notices(spark):
    cases = [NOTICE, NOTICE.replace("0.250 ", ""), NOTICE.replace("February 25", "Smarch 25"), NOTICE.replace("45.270", ""), NOTICE.replace("Company Limited", "")]
    found = catalogues.notices(files(spark, *cases)).orderBy("source", "plan").collect()
    assert [(r.name, r.plan, str(r.d), float(r.amount)) for r in found if r.source == "f0"] == [("HDFC Test Fund", "direct", "2026-02-25", 0.25), ("HDFC Test Fund", "regular", "2026-02-25", 0.25)]
    assert [(r.source, r.error) for r in found if r.source != "f0"] == [("f1", "amounts"), ("f2", "bad_date"), ("f3", "no_value"), ("f4", "issuer")]
    summary = "SCHEME SUMMARY DOCUMENT HDFC Test Fund\n29 AMFI Codes (To be phased out) 100120 - HDFC Test Fund - IDCW Plan 118969 - HDFC Test Fund - IDCW Plan - Direct Plan 118968 - HDFC Test Fund - Growth Plan - Direct Plan 30 SEBI Codes X"
    codes = catalogues.scheme_codes(files(spark, summary, "other")).orderBy("source", "code").collect()
    assert [(r.code, r.name, r.plan, r.option) for r in codes[:3]] == [("100120", "HDFC Test Fund", "regular", "idcw"), ("118968", "HDFC Test Fund", "direct", "growth"), ("118969", "HDFC Test Fund", "direct", "idcw")] and codes[3].error == "issuer"


def test_completeness_and_quality(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (("a", "b"), ("b", "c")))
    assert {tuple(r) for r in catalogues.completeness(a, b, ["k"]).collect()} == {("a", "missing"), ("c", "extra")}
    row = spark.range(1).select(*[catalogues.row_quality(F.lit(v), F.lit(x)).alias(n) for n, v, x in (("a", 0, 1), ("b", 1, -1), ("c", 1, 0), ("d", 1, 1))]).first()
    assert tuple(row) == ("zero_reference_nav", "negative_amount", "zero_amount", "valid")
    counted = catalogues.row_counters(spark.createDataFrame([("1950-01-01", 1.0, 1.0), ("2030-01-01", 0.0, 0.0), ("2020-01-01", -1.0, 1.0)], "t string, amount double, value double").withColumn("d", F.to_date("t")), "2025-01-01").first()
    assert tuple(counted) == (3, 1, 1, 1, 1, 1, 1)


def test_option_kinds(spark):
    cases = [
        ("Some Growth Fund - Series X", "Some Growth Fund - Series X - IDCW", "distribution", "IDCW"), ("Some Dividend Yield Fund", "Some Dividend Yield Fund - Growth Option", "growth_or_cumulative", "Growth Option"),
        ("Money Market Fund Regular", "Money Market Fund Regular (Bonus / Dividend)", "bonus_or_distribution", "Bonus / Dividend"), ("Money Fund (Bonus / Dividend)", "Money Fund (Bonus / Dividend)", "bonus_or_distribution", None),
        ("Capital Builder Fund - Div", "Capital Builder Fund - Div", "distribution", None), ("Liquid Plan - Daily", "Liquid Plan - Daily", "unknown", None),
        ("Flexi Cap Fund", "Flexi Cap Fund - Regular Plan - Payout of Income Distribution cum Capital Withdrawal option", "distribution", "Regular Plan - Payout of Income Distribution cum Capital Withdrawal option"),
        ("New Liquid Fund", "Old Liquid Fund-Cash Plan-Monthly Dividend Plan", "distribution", None), ("Income Fund - Direct Plan - Quarterly Dividend Plan", "Long Fund - Direct Plan - Quarterly Dividend Plan", "distribution", None),
        ("Fixed Maturity Plan", "Fixed Maturity Plan - Direct Plan - Cumulative Option", "growth_or_cumulative", "Direct Plan - Cumulative Option"), ("Beta Growth Fund Series A", "Beta Growth Fund - Direct Plan - IDCW", "distribution", None),
        ("Alpha", "Alphabet Growth", "growth_or_cumulative", None), ("Alpha", "Alpha - Growth IDCW", "conflicting", "Growth IDCW"), ("Alpha", "Alpha - Bonus Option", "bonus", "Bonus Option"), ("", "x", "unknown", None), (None, None, "unknown", None),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, scheme string, label string")
    found = labels.with_option_kind(df, "scheme", "label").orderBy("i").collect()
    assert [(r.kind, r.descriptor) for r in found] == [c[2:] for c in cases]


def test_gates(spark):
    rows = [(False, "amount", 1.0, "distribution"), (True, "ratio", None, "distribution"), (True, "percentage", 0.0, "distribution"), (True, "percentage", 5.0, "bonus"), (True, "amount", None, "bonus"), *[(True, "amount", 1.0, k) for k in labels.GATE_OF]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, known boolean, unit string, value double, kind string")
    found = [r.g for r in df.select("i", labels.gate(*map(F.col, ("known", "unit", "value", "kind"))).alias("g")).orderBy("i").collect()]
    assert found == ["unmatched_option_identifier", "ratio_source_value", "non_positive_scalar", "percentage_source_value", None, *labels.GATE_OF.values()] and set(found) - {None} == set(labels.GATES)


def test_ledgers(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y")], "k string, t long, v string")
    assert [(r.revision, r.valid_from, r.valid_to) for r in ledgers.versions(rows, "k", ["t"], ["v"]).orderBy("t").collect()] == [(1, 1, 3), (2, 3, None)]
    now = spark.createDataFrame([("a", 2)], "k string, revision int")
    ups = spark.createDataFrame([("a", 2), ("a", 1), ("b", 0), ("c", 4)], "k string, expected int")
    assert sorted(r.outcome for r in ledgers.checked_update(now, ups, "k").collect()) == ["applied", "created", "stale", "unknown"]
    runs = spark.createDataFrame([("r", "running", "2025-01-01 00:00:00"), ("s", "running", "2025-01-01 09:00:00")], "id string, state string, t string").withColumn("started_at", F.to_timestamp("t"))
    assert {r.id: r.state for r in ledgers.stale_runs(runs, "2025-01-01 10:00:00").collect()} == {"r": "failed", "s": "running"}
    assert ledgers.next_state("running", "failed") == "failed"
    with pytest.raises(ValueError):
        ledgers.next_state("failed", "running")
