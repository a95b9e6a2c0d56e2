"""Feeds, page tables, ZIP members, price files, sinks and the incremental store."""

import datetime as dt
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import identities
from seriesloom.sources import exchange, feeds, markup, sinks
from seriesloom.streaming import incremental

VALUES = """Scheme Code;ISIN Div Payout/ ISIN Growth;ISIN Div Reinvestment;Scheme Name;Net Asset Value;Date

Open Ended Schemes(Equity Scheme - Large Cap Fund)

Alpha House

100;INF204KB14I2;-;Alpha Direct Growth;12.5000;02-Sep-2026
101;-;-;Alpha Regular;N.A.;02-Sep-2026
102;-;-;Alpha Short;1.0
Beta House
200;-;-;Beta;7.25;03-Sep-2026
200;-;-;Beta;7.30;03-Sep-2026
"""


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "source string, payload string")


def test_value_feed(spark):
    found = feeds.value_feed(files(spark, VALUES)).orderBy("line").collect()
    good = found[0]
    assert (good.code, float(good.value), good.house, good["class"], good.isin, good.isin2, good.error) == ("100", 12.5, "Alpha House", "Open Ended Schemes(Equity Scheme - Large Cap Fund)", "INF204KB14I2", None, None)
    assert [(r.code, r.error) for r in found] == [("100", None), ("101", "bad_value"), ("102", "field_count"), ("200", None), ("200", "repeated")]
    assert found[1].raw_value == "N.A." and found[3].house == "Beta House"
    assert [r.error for r in feeds.value_feed(files(spark, VALUES.replace("Scheme Code;", "Code;"))).select("error").distinct().collect()] == ["unknown_header"]
    lost = VALUES.replace("Open Ended Schemes(Equity Scheme - Large Cap Fund)", "Equity")
    assert {r.error for r in feeds.value_feed(files(spark, lost)).collect()} == {"lost_section", "no_section"}
    bad = [feeds.value_feed(files(spark, VALUES.replace("12.5000", x))).orderBy("line").first().error for x in ("1,000", "-1", "NaN")]
    assert bad == ["bad_value"] * 3 and feeds.value_feed(files(spark, VALUES.replace("12.5000", "1e3"))).orderBy("line").first().value == 1000
    assert [r.issue for r in feeds.isin_warnings(feeds.value_feed(files(spark, VALUES.replace("INF204KB14I2", "INF1")))).collect()] == ["INVALID_ISIN_PAYOUT_OR_GROWTH"]


QUALIFIED = """Scheme Code;NAV Name;Plan;Option;ISIN Div Payout/ISIN Growth;ISIN Div Reinvestment;Net Asset Value;Date

Open Ended Schemes ( Equity Scheme - Multi Cap Fund )

One House
148921;One Fund-Direct Growth;Direct Plan;GROWTH;INF209KB1Y49;;23.12;20-Aug-2026
148919;One Fund-Regular-IDCW Payout;;IDCW Payout;INF209KB1Y31;;19.06;20-Aug-2026
"""
OLD = """Scheme Code;Scheme Name;ISIN Div Payout/ISIN Growth;ISIN Div Reinvestment;Net Asset Value;Repurchase Price;Sale Price;Date
Open Ended Schemes ( Equity Scheme - Multi Cap Fund )
One House
148921;One Fund-Direct Growth;INF209KB1Y49;;22.69;;;03-Aug-2026
148921;One Fund-Direct Growth;INF209KB1Y49;;23.07;;;14-Aug-2026
"""


def test_value_feed_in_other_forms(spark):
    found = feeds.value_feed(files(spark, QUALIFIED, OLD)).orderBy("source", "line").collect()
    assert [(r.plan, r.option, float(r.value), str(r.day), r.error) for r in found[:2]] == [("Direct Plan", "GROWTH", 23.12, "2026-08-20", None), (None, "IDCW Payout", 19.06, "2026-08-20", None)]
    assert [(str(r.day), r.error) for r in found[2:]] == [("2026-08-03", None), ("2026-08-14", None)]


def test_payload_state(spark):
    failed = "<HTML>View/Download NAV History Application Error! Please try again later"
    df = spark.createDataFrame([(failed,), ("<html>error",), (feeds.EMPTY_MARK,), ("no data found",), ("x;y",)], "p string")
    assert [r[0] for r in df.select(feeds.payload_state(F.col("p"))).collect()] == ["failed", "data", "empty", "data", "data"]


def test_json_feeds(spark):
    good = json.dumps([{"scheme_id": "1", "scheme_name": "A"}, {"scheme_id": "1", "scheme_name": "B"}, {"scheme_id": "x", "scheme_name": "C"}, {"id": 1}, {"scheme_id": 4, "scheme_name": "D"}, {"scheme_id": "5", "scheme_name": " "}])
    assert [r.error for r in feeds.scheme_list(files(spark, good)).orderBy("position").collect()] == [None, "repeated", "bad_code", "keys", "bad_code", "no_name"]
    assert feeds.scheme_list(files(spark, "[]")).count() == 0 and [r.error for r in feeds.scheme_list(files(spark, "{}")).collect()] == ["no_array"]


def payout(**more):
    return {"MF_ID": "20", "SD_ID": 101143, "scheme_id": "712", "Scheme_Name": "Fund", "Nav_name": "Fund - IDCW", "Div_year": "2009-04-06T00:00:00.000Z", "year": "2009", "Rate_of_div": "6.00%"} | more


def test_payout_feed(spark):
    late, old = {"Div_year": "2026-03-10T00:00:00.000Z", "year": "2026"}, {"Div_year": "2009-04-07T00:00:00.000Z"}
    rows = [
        payout(), payout(**old, Rate_of_div="0.60"), payout(**late, SD_ID=120335, Rate_of_div="0.1600", Plan="Direct Plan", Option="IDCW"), payout(SD_ID=1, Rate_of_div="0.5", Plan=None, Option="  "), payout(SD_ID=2, Plan=1, Option=None),
        payout(SD_ID=3, Plan="x"), payout(SD_ID=4, year="2010"), payout(SD_ID=5, Div_year="2009-04-06T01:00:00Z"), payout(SD_ID="a"), payout(SD_ID=6, Rate_of_div="not disclosed"), payout(Rate_of_div="1:3"), payout(SD_ID=7, Rate_of_div="1:3"), payout(SD_ID=True),
    ]
    found = feeds.payout_feed(files(spark, json.dumps({"data": rows}))).orderBy("position").collect()
    assert [r.error for r in found] == [None, None, None, None, "Plan", "keys", "year", "bad_date", "bad_code", "bad_value", "repeated", None, "bad_code"]
    assert [r.unit for r in found[:4]] == ["percentage", "amount", "amount", "percentage"] and (found[2].Plan, found[2].Option, found[3].Option) == ("Direct Plan", "IDCW", None)
    assert found[0].signature == hashlib.sha256(json.dumps(rows[0], sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert feeds.payout_feed(files(spark, '{"data": []}')).count() == 0 and feeds.payout_feed(files(spark, "[]")).first().error == "no_array"


def capture(**more):
    base = {
        "schema_version": 1, "provider": "cams", "source_url": "https://www.camsonline.com/x", "captured_at": "2026-01-01T00:00:00Z", "fund": {"code": "F", "name": "Fund"},
        "scheme": {"code": "S", "name": "Scheme", "plan_type": "direct", "option_variant": "payout", "latest_nav_date": "2026-01-01", "latest_nav_value": "10"},
        "source_payload_sha256": hashlib.sha256(b"raw").hexdigest(), "source_payload": "raw",
        "records": [{"record_date": "2025-01-02", "individual_amount": "0.10000000000000001", "non_individual_amount": None, "ex_nav": "9.5", "cum_nav": None, "source_terminology": "x"}],
    }
    return base | more


def test_captures(spark):
    one = capture()
    record = one["records"][0]
    cases = [
        (one, None), (capture(source_payload_sha256="0" * 64), "checksum"), (capture(provider="other"), "provider"), (capture(source_url="http://www.camsonline.com/x"), "host"), (capture(captured_at="2026-01-01T00:00:00"), "naive_time"),
        (capture(more=1), "keys"), (capture(scheme=one["scheme"] | {"plan_type": "x"}), "plan"), (capture(scheme=one["scheme"] | {"latest_nav_value": None}), "latest"), (capture(records=[record, record]), "repeated_record"),
        (capture(records=[record | {"individual_amount": "0"}]), "record"), (capture(records=[record | {"more": 1}]), "record"), (capture(fund={"code": "F"}), "keys"),
    ]
    lines = [(f"f{i:02}", json.dumps(x)) for i, (x, _) in enumerate(cases)]
    lines += [("two", json.dumps(one)), ("two", json.dumps(capture(provider="kfintech", source_url="https://mfs.kfintech.com/x"))), ("twice", json.dumps(one)), ("twice", json.dumps(one))]
    found = feeds.captures(spark.createDataFrame(lines, "source string, value string"))
    by = {}
    for r in found.collect():
        by.setdefault(r.source, []).append(r.error)
    assert [by[f"f{i:02}"] for i in range(len(cases))] == [[e] for _, e in cases] and by["two"] == ["mixed_providers"] * 2 and by["twice"] == ["repeated"] * 2
    records = feeds.capture_records(found.where("source = 'f00'"))
    assert float(records.first().amount) == 0.1 and float(records.first().ex_value) == 9.5 and records.first().cum_value is None
    assert sorted((r.kind, float(r.value)) for r in feeds.evidence(found.where("source = 'f00'")).collect()) == [("ex_nav", 9.5), ("latest_nav", 10.0)]


def test_index_feeds(spark):
    bar = {"RequestNumber": "1", "Index Name": "I", "INDEX_NAME": "I", "HistoricalDate": "02 Jan 2025", "OPEN": "-", "HIGH": "10", "LOW": "8", "CLOSE": "9"}
    days = [bar | {"HistoricalDate": f"{d:02} Jan 2025"} | x for d, x in ((2, {}), (3, {"OPEN": "9", "HIGH": "8.5"}), (4, {"CLOSE": "0"}), (2, {}))]
    rows = feeds.index_prices(files(spark, json.dumps(days))).orderBy("position").collect()
    assert [(r.issue, r.error) for r in rows] == [(None, None), ("bar", None), ("close", "bad_value"), (None, "repeated")] and rows[1].high is None and rows[1].close == 9.0 and rows[2].close is None and rows[0].open is None
    tri = {"RequestNumber": "1", "Index Name": "I", "Date": "02 Jan 2025", "TotalReturnsIndex": "100", "NTR_Value": "-"}
    found = feeds.total_returns(files(spark, json.dumps([tri, tri | {"Date": "03 Jan 2025", "NTR_Value": "99"}, tri | {"Date": "04 Jan 2025", "NTR_Value": "0"}, tri]))).collect()
    assert {(r.d.day, r.basis, r.value) for r in found if r.error is None} == {(2, "gross", 100.0), (3, "gross", 100.0), (3, "net", 99.0)} and sorted(r.error for r in found if r.error and r.basis == "gross") == ["bad_value", "repeated"]
    names = feeds.index_names(files(spark, json.dumps([{"Trading_Index_Name": "N", "Index_long_name": "Nifty"}, {"Trading_Index_Name": "N", "Index_long_name": "Other"}])))
    assert [(r.display_name, r.error) for r in names.orderBy("position").collect()] == [("Nifty", None), ("Other", "repeated")]
    assert identities.with_indices(spark.createDataFrame([], identities.INSTRUMENT), names.where("error is null")).count() == 3


def test_yields(spark):
    row = spark.range(1).select(feeds.yield_holds(F.lit(1.0).cast("decimal(18,8)"), F.lit(8.0).cast("decimal(18,8)"), F.lit(12.5).cast("decimal(18,2)"))).first()
    assert row[0]


def test_registrar_pages(spark):
    head = "<tr><th>Record Date</th><th>Dividend Rate (Individual)</th><th>Dividend Rate Non-Individual</th><th>Ex NAV</th><th>Remark</th></tr>"
    row = lambda *c: f"<tr>{''.join(f'<td> {x} </td>' for x in c)}</tr>"
    one = row("01/02/2025", "1,234.5", "-", "9.5", "left out")
    table = f"<table><tr><td>menu</td></tr></table><table>{row('Payouts')}{head}{one}{one}{row('01-Mar-2025', '0', 'NA', '', 'x')}{row('only')}{row('32/01/2025', '1', '', '', '')}</table>"
    rows = markup.registrar_payouts(files(spark, table, "<p>No Dividend Records Found</p>", "<table><tr><th>Other</th></tr></table>")).orderBy("source", "row").collect()
    assert [(r.source, r.error) for r in rows] == [("f0", None), ("f0", "bad_value"), ("f0", "columns"), ("f0", "bad_date"), ("f2", "headers")]
    assert (str(rows[0].d), float(rows[0].individual), rows[0].non_individual, float(rows[0].ex_nav), rows[0].cum_nav) == ("2025-02-01", 1234.5, None, 9.5, None)


def test_registrar_lists(spark):
    landing = "<table><tr><td class='x comptitle'>One  Fund</td><td><a href='NAV_Dividend.aspx?Fund=101'>go</a></td></tr><tr><td>x</td></tr></table>"
    assert [tuple(r)[1:] for r in markup.registrar_funds(files(spark, landing, "<p>")).orderBy("source").collect()] == [("101", "One Fund", None), (None, None, "no_funds")]
    option = lambda v, n: f"<option value='{v}'>{n}</option>"
    form = "<select name='ctl00$ContentPlaceHolder1$SelScheme'>" + option("0", "Choose") + option("7", "Fund IDCW") + option("7", "Fund Direct IDCW") + option("7", "Fund IDCW") + option("8", "A Direct") + option("8", "A Regular") + option("9", "B") + "</select>"
    found = markup.scheme_options(files(spark, form)).orderBy("code").collect()
    assert [(r.code, r.name, r.aliases, r.plan, r.error) for r in found] == [("7", "Fund Direct IDCW", ["Fund IDCW"], "direct", None), ("8", "A Direct", ["A Regular"], "regular", "plan_conflict"), ("9", "B", [], "unknown", None)]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return bytearray(out.getvalue())


def test_zip_members(spark):
    day, early = dt.date(2012, 1, 2), dt.date(2009, 1, 2)
    cases = [
        ("nse", day, {"cm02Jan2012bhav.csv": "x"}, None), ("nse", day, {"cm03Jan2012bhav.csv": "x"}, "unsafe_member"), ("unified", day, {"a.csv": "x", "b.csv": "x"}, "members"), ("unified", day, {"../a.csv": "x"}, "unsafe_member"),
        ("bse", day, {"EQ020112.CSV": "x", "read.me": "y"}, None), ("bse", day, {"EQ030112.CSV": "x"}, "members"), ("members", day, {"etf020112.csv": "x", "pr020112.csv": "y"}, None), ("members", day, {"etf030112.csv": "x"}, "not_published"),
        ("members", early, {"pr020109.csv": "y"}, "empty"), ("members", day, {"pr020112.csv": "y"}, "members"),
    ]
    rows = [(f"{i:02}", zipped(m), k, d) for i, (k, d, m, _) in enumerate(cases)] + [("90", bytearray(b"bare"), "nse", day), ("91", bytearray(b"bare"), "members", day), ("92", bytearray(b"PKx"), "nse", day)]
    found = markup.zip_members(spark.createDataFrame(rows, "path string, content binary, kind string, day date")).orderBy("source").collect()
    assert [r.error for r in found] == [*[e for *_, e in cases], None, "no_zip", "no_zip"] and found[0].payload == "x" and found[10].payload == "bare"


def unified(**more):
    own = dict.fromkeys(exchange.LAYOUTS["unified"], "") | {"TradDt": "2025-01-02", "BizDt": "2025-01-02", "Src": "NSE", "FinInstrmId": "1", "ISIN": "INF204KB14I2", "TckrSymb": "ABC", "SctySrs": "EQ", "FinInstrmNm": '"Fund, the"', "OpnPric": "1", "HghPric": "2", "LwPric": "1", "ClsPric": "1.5", "PrvsClsgPric": "1", "TtlTradgVol": "10", "TtlTrfVal": "15.5", "TtlNbOfTxsExctd": "3"}
    return ",".join((own | more).values())


def test_price_files(spark):
    head = {k: ",".join(c) for k, c in exchange.LAYOUTS.items()}
    old = "SYM,EQ,{},2,1,{},1.5,1,10,15.5,{},{}"
    cases = [
        ("NSE", "2025-01-02", [head["unified"], unified(), unified(FinInstrmId="2", HghPric="1"), unified(FinInstrmId="3", ClsPric="0"), unified(FinInstrmId="4", TradDt="2025-01-03"), unified(FinInstrmId="5", Src="BSE"), unified(FinInstrmId="6", ISIN="X"), unified(), unified(FinInstrmId="7", TtlTradgVol="1.5"), unified(FinInstrmId="8") + ",more"]),
        ("NSE", "2012-01-02", [head["nse"], old.format(1, 1.5, "02-JAN-2012", "7,DUMMY,"), old.format(0, 1.5, "02-JAN-2012", "7,INF204KB14I2,").replace("EQ", "E2"), old.format(1, 0, "02-JAN-12", "7,INE,").replace("EQ", "E3")]),
        ("NSE", "2010-01-02", [head["nse_old"], old.format(1, 1.5, "02-JAN-2010", "")]), ("NSE", "2012-01-02", [head["nse_old"], old.format(1, 1.5, "02-JAN-2012", "")]),
        ("BSE", "2012-01-02", [head["bse"], "500,  ,A,Q,1,2,1,1.5,1.5,,3,10,15.5,", "501,N,A,Q,1,2,1,1.5,x,1,3,10,15.5,"]), ("NSE", "2012-01-02", ["a,b", "1,2"]),
    ]
    rows = [(f"f{i}", e, dt.date.fromisoformat(d), "\n".join(x)) for i, (e, d, x) in enumerate(cases)]
    found = {}
    for r in exchange.prices(spark.createDataFrame(rows, "source string, exchange string, day date, payload string")).orderBy("source", "line").collect():
        found.setdefault(r.source, []).append(r)
    assert [(r.error, r.bar_issue) for r in found["f0"]] == [(None, None), (None, "inconsistent_bar"), ("price", None), ("day", None), ("exchange", None), ("isin", None), ("repeated", None), ("volume", None), ("columns", None)]
    assert (found["f0"][0].name, found["f0"][0].close, found["f0"][1].high, found["f0"][1].close) == ("Fund, the", 1.5, None, 1.5)
    assert [(r.error, r.isin, r.bar_issue, r.close_issue) for r in found["f1"]] == [(None, None, None, None), (None, "INF204KB14I2", "inconsistent_bar", None), (None, None, None, "zero_close")]
    assert found["f2"][0].error is None and found["f3"][0].error == "layout_of_another_day" and found["f5"][0].error == "unknown_layout"
    assert [(r.error, r.name, r.previous) for r in found["f4"]] == [(None, None, None), ("price", "N", 1.0)]


def test_fund_lists(spark):
    master = ",".join(exchange.MASTER) + '\nGOLD,Gold,"Gold, fund",02-Jan-07,1,INF204KB14I2,100,x,y\nGOLD,Gold,Gold,02-Jan-07,0,INF204KB14I3,100,x,y\nG,Gold,Gold,02-Jan-07,1,INF204KB14I2,100,x,y\n'
    assert [(r.symbol, r.name, r.error) for r in exchange.etf_master(files(spark, master)).orderBy("position").collect()] == [("GOLD", "Gold, fund", None), ("GOLD", "Gold", "lot"), ("G", "Gold", "repeated")]
    line = "N,EQ,{},Gold,1,1,1,1,1,10,10,1,2,1,Gold"
    daily = exchange.etf_daily(files(spark, "\n".join([",".join(exchange.DAILY), line.format("A"), line.format("B").replace("N,", "Y,", 1), line.format("A")])))
    assert [(r.symbol, r.error) for r in daily.orderBy("position").collect()] == [("A", None), ("B", "market"), ("A", "repeated")]
    listed = spark.createDataFrame([("NSE", "A", "I1", "2020-01-01"), ("NSE", "A", "I2", "2021-01-01"), ("NSE", "B", "I3", "2020-01-01")], "exchange string, security_id string, isin string, d string")
    assert [(r.security_id, r.isins, r.history) for r in exchange.identity_changes(listed).collect()] == [("A", 2, "2020-01-01 I1|2021-01-01 I2")]
    day = spark.createDataFrame([("2025-01-02", "A", "EQ"), ("2025-01-02", "B", "EQ")], "d string, symbol string, series string")
    prices = spark.createDataFrame([("2025-01-02", "A", "EQ", "I1", 1.5, None, None)], "d string, symbol string, series string, isin string, close double, close_issue string, error string")
    assert {r.symbol: r.identity for r in exchange.resolved_by_membership(day, prices).collect()} == {"A": "official", "B": "identity_unresolved"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x", 1.5), (2, None, 2.0)], "k long, t string, v double")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert sorted((r.k, r.t, r.v) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()) == [("1", "'=x", "1.5"), ("2", None, "2")]
    assert json.loads(sinks.manifest(df))["rows"] == 2 and sinks.manifest(df) == sinks.manifest(df.orderBy(F.desc("k")))
    store = sinks.Artifacts(str(tmp_path / "art"))
    digest = store.store(b"abc")
    assert store.store(b"abc") == digest and store.read(digest) == b"abc"
    store.path(digest).write_bytes(b"xyz")
    with pytest.raises(ValueError):
        store.read(digest)
    with pytest.raises(ValueError):
        store.path("../x")
    assert sinks.request_plan("2025-01-01", "2025-04-10") == [("2025-04-01", "2025-04-10"), ("2025-01-01", "2025-03-31")]


def test_incremental_store_keeps_late_corrections(spark, tmp_path):
    landing, store, checkpoint = (str(tmp_path / x) for x in ("landing", "store", "checkpoint"))
    spark.createDataFrame([(1, "2025-01-01", 10.0, 1), (1, "2025-01-02", 11.0, 2)], "code long, d string, v double, seq long").coalesce(1).write.json(landing)
    incremental.run_available(spark, landing, store, checkpoint)
    spark.createDataFrame([(1, "2025-01-01", 10.5, 3), (1, "2025-01-02", 11.0, 2), (1, "2025-01-02", -1.0, 4)], "code long, d string, v double, seq long").coalesce(1).write.mode("append").json(landing)
    incremental.run_available(spark, landing, store, checkpoint)
    assert {(str(r.d), r.v, r.revisions) for r in incremental.current_values(spark, store).collect()} == {("2025-01-01", 10.5, 2), ("2025-01-02", 11.0, 1)}


def test_plan_runs(spark):
    known = spark.createDataFrame([(1, "2025-01-10"), (2, "2025-01-10")], "code long, t string").select("code", F.col("t").cast("date").alias("last_day"))
    out = incremental.plan_runs(known, spark.createDataFrame([(1,), (2,), (3,)], "code long"), spark.createDataFrame([(2,)], "code long"))
    assert {r.code: (r.mode, str(r.from_day)) for r in out.collect()} == {1: ("overlap", "2025-01-03"), 2: ("retry", "2025-01-03"), 3: ("full", "None")}
