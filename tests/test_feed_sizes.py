"""Feeds at size: files that stay small, lines that repeat, work that stays linear."""

import datetime
import json
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F
from test_whole_tables import lines

from seriesloom.functions import labels
from seriesloom.operators import provenance, publication, quality, revisions, series
from seriesloom.plans import history_queries, reader_queries, rerun_queries, source_queries
from seriesloom.sources import exchange, feeds, markup

D = datetime.date


def both(spark, folder, query, sql, **tables):
    """The rows of a query over the tables, and of its SQL, each in the order of their text."""
    con = duckdb.connect()
    for name, rows in tables.items():
        rows.to_parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    df = query(spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, con.execute(f"select {columns} from ({sql})").fetchall()))


def test_index_prices_of_a_day_are_a_file(spark, tmp_path, monkeypatch):
    days = [D(2000, 1, 1), D(2000, 1, 2)] * 50
    orders = pd.DataFrame({"o_orderkey": range(100), "o_orderpriority": ["1-URGENT"] * 60 + ["5-LOW"] * 40, "o_orderdate": days, "o_totalprice": [1000.0 + i for i in range(100)]})
    read, files = feeds.index_prices, []
    monkeypatch.setattr(feeds, "index_prices", lambda f: files.append(f) or read(f))
    found, wanted = both(spark, tmp_path, source_queries.feed_index_prices, source_queries.PRICES_SQL, orders=orders)
    assert found == wanted
    assert sorted(p.payload.count("INDEX_NAME") for p in files[0].collect()) == [20, 20, 30, 30]


def test_price_files_of_a_month_stay_small(spark, tmp_path, monkeypatch):
    rows = lines(l_orderkey=list(range(1, 401)), l_linenumber=[i % 2 + 1 for i in range(400)], l_partkey=[i % 80 for i in range(400)])
    read, files = exchange.prices, []
    monkeypatch.setattr(exchange, "prices", lambda f: files.append(f) or read(f))
    monkeypatch.setattr(source_queries, "FILE_LINES", 20)
    found, wanted = both(spark, tmp_path, source_queries.exchange_prices, source_queries.EXCHANGE_SQL, lineitem=rows)
    assert found == wanted and any("'repeated'" in x for x in found)
    held = [re.findall(r'"(SYM\d+)"', r.payload) for r in files[0].collect()]
    assert sum(map(len, held)) == 400 and max(map(len, held)) <= 60
    assert sum(len(set(h)) for h in held) == 80 * len({d for d in rows.l_shipdate.astype(str).str[:7]})


def test_registrar_pages_of_lines_that_repeat(spark, tmp_path):
    rows = lines(l_orderkey=[1, 1, 1, 2, 12], l_linenumber=[1, 1, 3, 5, 1], l_partkey=7)
    found, wanted = both(spark, tmp_path, source_queries.registrar_pages, source_queries.PAGES_SQL, lineitem=rows)
    assert found == wanted and len(found) == 4


def test_catalogue_compares_names_by_hash(spark, tmp_path):
    customers = pd.DataFrame({"c_custkey": range(60), "c_nationkey": [i % 6 for i in range(60)], "c_mktsegment": "A", "c_name": [f"n{i}" for i in range(60)]})
    query = reader_queries.third_party_catalogue
    found, wanted = both(spark, tmp_path, query, reader_queries.CATALOGUE_SQL, customer=customers)
    assert found == wanted
    plan = query(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert re.search(r"array_distinct\(transform\(derived#\d+, lambdafunction\(to_json", plan)


def test_reconciled_rows_are_sorted_once(spark):
    days = [D(2000, 1, 1), D(2000, 1, 2)]
    rows = spark.createDataFrame([(1, days[i % 2], float(i // 4), 3 - i // 4, i) for i in range(12)], "code long, d date, amount double, tier int, seq long")
    out = revisions.reconcile(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.d, r.amount, r.tier, r.revision, r.state, r.events) for r in out.collect()) == [(d, 2.0, 1, 3, "current", 6) for d in days]
    assert len(re.findall(r"\bSort \[", plan)) == 2  # the rows, and the steps of the tiers


def test_filtered_gates_repeat_no_pattern(spark):
    rows = spark.createDataFrame([(1, D(2000, 1, 3), 1, "amount", 0.5, "Fund", "Fund - Growth Option"), (1, D(2000, 1, 3), 2, "amount", 0.5, "Fund", "Fund - IDCW")], "code long, d date, seq long, unit string, value double, scheme string, label string")
    gated = publication.normalise(rows, rows.select("code").distinct(), spark.createDataFrame([], publication.EVENT))
    found = quality.label_review_items(gated)
    assert [tuple(r) for r in found.collect()] == [("growth_or_cumulative", 1, 1, ["Fund"], ["Fund - Growth Option"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(labels.EDGE) <= 6  # thrice in the filter that is moved below, thrice in the row itself


def test_prices_of_all_layouts_are_read_once(spark):
    old = "\n".join(["  ", ",".join(exchange.LAYOUTS["nse_old"]), "", "S,EQ,1,2,1,1,1,1,10,1.5,02-JAN-2010,", "S,EQ,1,2,1,1,1,1,10,1.5,02-JAN-2010,"])
    files = spark.createDataFrame([("a", "NSE", D(2010, 1, 2), old), ("b", "BSE", D(2010, 1, 2), old)], "source string, exchange string, day date, payload string")
    found = exchange.prices(files)
    assert sorted((r.source, r.line, r.layout, r.close, r.error) for r in found.where("line is not null").collect()) == [("a", 3, "nse_old", 1.0, None), ("a", 4, "nse_old", 1.0, "repeated")]
    assert [(r.source, r.error) for r in found.where("line is null").collect()] == [("b", "layout_of_another_day")]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("Window") == 1


def test_plain_rows_of_pages_are_not_parsed_tag_by_tag(monkeypatch):
    plain = "<tr><td> a  b</td><td>c<br>d</td></tr>" * 1000
    odd = ["<table id='x'><tr><th>A</th><th>B</th></tr>", plain, "<tr><td class='comptitle'>t</td><td>&lt;</td></tr>", plain, "</table>"]
    begun, start = [], markup.Page.handle_starttag
    monkeypatch.setattr(markup.Page, "handle_starttag", lambda page, tag, attrs: begun.append(tag) or start(page, tag, attrs))
    assert markup.parsed("".join(odd)).tables == [("x", [["A", "B"], *[["a b", "c d"]] * 1000, ["t", "<"], *[["a b", "c d"]] * 1000])]
    assert len(begun) == 7
    for before in ("", "<!-- ", "<script>", "<table><tr><td>", "<table><a title='", "<textarea>", "<table>x &am", "<option>"):  # rows that are hidden, lost or within something else
        html = f"{before}<tr><td>1</td></tr> --></script>'></textarea><table><tr><td>2</td></tr></table>"
        whole, page = markup.Page(), markup.parsed(html)
        whole.feed(html)
        whole.close()
        assert (page.tables, page.open, page.options) == (whole.tables, whole.open, whole.options)


def test_lines_of_a_file_are_sorted_by_flat_keys(spark):
    rows = spark.createDataFrame([(1, (2, 1), "c"), (1, (1, 9), "b"), (1, (1, 2), "a")], "k long, place struct<a: int, b: int>, x string")
    files = source_queries.joined(rows, ["k"], F.col("x"), "place", "")
    assert [r.payload for r in files.collect()] == ["a\nb\nc"]
    assert re.search(r"o0, place#\d+\.a, o1, place#\d+\.b, x", files._jdf.queryExecution().analyzed().toString())  # no struct within a struct


def test_payout_records_are_parsed_for_kinds_only_where_keyed(spark):
    told = {k: "1" for k in feeds.PAYOUT_KEYS} | {"Div_year": "2020-01-02T00:00:00.000Z", "year": "2020"}
    rows = [told | {"SD_ID": "1"}, told | {"SD_ID": "2", "Plan": 5, "Option": None}, told | {"SD_ID": "3", "Plan": " ", "Option": {"a": 1}}, told | {"SD_ID": "4", "Plan": None, "Option": "x"}]
    found = feeds.payout_feed(spark.createDataFrame([("a", json.dumps({"data": rows})), ("b", '{"data": [ \n ]}')], "source string, payload string"))
    assert sorted((r.source, r.SD_ID, r.error) for r in found.collect()) == [("a", "1", None), ("a", "2", "Plan"), ("a", "3", "Option"), ("a", "4", None)]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert re.search(r"isnull\(Plan#\d+\) OR coalesce\(schema_of_variant", plan) and "regexp_replace" not in plan


def test_drill_down_follows_only_what_it_shows(spark, tmp_path):
    days = [D(2000, 1, 3) + datetime.timedelta(7 * (i // 2)) for i in range(120)]
    rows = lines(l_orderkey=range(120), l_linenumber=[i % 7 + 1 for i in range(120)], l_partkey=[i % 45 for i in range(120)], l_suppkey=1, l_shipdate=days, l_returnflag=["RAN"[i % 3] for i in range(120)]).astype({"l_linenumber": "int32"})
    query, made = history_queries.drill_down, []
    folder = tmp_path / "tables"
    folder.mkdir()
    tables = {"lineitem": rows, "part": pd.DataFrame({"p_partkey": range(50)}), "supplier": pd.DataFrame({"s_suppkey": [1]})}
    whole = provenance.drill_down
    provenance.drill_down = lambda revisions, records, *more: made.append(records) or whole(revisions, records, *more)
    try:
        found, wanted = both(spark, folder, query, history_queries.DRILL_SQL, **tables)
    finally:
        provenance.drill_down = whole
    assert found == wanted and len(found) == 50
    assert {r.event_day for records in made[0] for r in records.collect()} == set(days[20:])


def test_values_are_sorted_again_without_columns_that_nobody_asks_for(spark):
    text = next(iter(feeds.VALUE_HEADERS)) + "\n\nOpen Ended Schemes(Equity)\nOne\n1;-;-;F;2.5;02-Sep-2026\n1;-;-;F;2.5;02-Sep-2026;x\n1;-;-;;-1;03-Sep-2026\n2;-;-;F;-1;03-Sep-2026"
    found = feeds.value_feed(spark.createDataFrame([("a", text)], "source string, payload string")).select("code", "value", "error")
    assert [r.error for r in found.collect()] == [None, "field_count", "no_name", "bad_value"]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("row_number()")[1].splitlines()[1]
    assert "Project [source#" in plan and " AS __early#" in plan and " AS name#" not in plan and " AS raw_value#" not in plan


def test_nearest_points_are_sought_once_for_a_day(spark):
    days = [D(2020, 1, 1) + datetime.timedelta(i) for i in range(20)]
    marks = spark.createDataFrame([(f"{d}-{i}", "x", d) for d in days for i in range(50)], "id string, code string, t date")
    points = spark.createDataFrame([("x", D(2020, 1, 3), 1.0), ("x", D(2020, 1, 3), 0.5), ("x", D(2020, 1, 7), 2.0)], "code string, d date, v double")
    out = series.nearest(marks, points, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    near = {1: (2, 0.5), 2: (1, 0.5), 3: (0, 0.5), 4: (1, 0.5), 5: (2, 0.5), 6: (1, 2.0), 7: (0, 2.0), 8: (1, 2.0), 9: (2, 2.0)}
    assert sorted((r.id, r.off_days, r.v) for r in out.collect()) == sorted((f"{d}-{i}", *near[d.day]) for d in days[:9] for i in range(50))
    assert plan.count("Aggregate") == 2 and not re.search(r"Aggregate \[id#", plan)  # the days, and the nearest of each


def test_captures_are_compared_again_only_where_a_point_can_conflict(spark, monkeypatch):
    days = [D(2020, 1, 1) + datetime.timedelta(10 * i) for i in range(5)]
    name = "Balanced {} - IDCW - Direct Plan"
    metadata = spark.createDataFrame([(i, name.format(i), "HDFC Mutual Fund", "direct", "idcw") for i in range(1, 6)], "code long, name string, house string, plan string, option string")
    captures = spark.createDataFrame([(c, f"{n} Dir", "HDFC") for c, n in (("whole", "A"), ("missing", "B"), ("conflict", "C"), ("few", "D"), ("named", "Balanced 5"))], "capture string, name string, house string")
    values = {1: [1.0] * 5, 2: [2.0] * 4, 3: [3.0] * 4 + [9.0], 4: [4.0] * 2, 5: [5.0] * 5}
    nav = spark.createDataFrame([(c, d, v) for c, vs in values.items() for d, v in zip(days, vs)], "code long, d date, v double")
    points = spark.createDataFrame([(c, d, float(i)) for i, c in enumerate(["whole", "missing", "conflict", "few", "named"], 1) for d in days], "capture string, d date, value double")
    plain, pairs = publication.compared, []
    monkeypatch.setattr(publication, "compared", lambda p, *more: pairs.append(p) or plain(p, *more))
    found = publication.map_third_party(captures, points, metadata, nav)
    assert {r.capture: (r.state, r.code, r.matches) for r in found.collect()} == {"whole": ("mapped", 1, 5), "missing": ("mapped", 2, 4), "conflict": ("unresolved", None, 0), "few": ("unresolved", None, 0), "named": ("mapped", 5, 5)}
    assert sorted(map(tuple, pairs[0].collect())) == [("conflict", 3, False), ("missing", 2, False), ("named", 5, True)]


def test_even_samples_search_no_array(spark):
    rows = spark.range(13, 60).withColumnRenamed("id", "n").selectExpr("n", "explode(sequence(1, n)) as d")
    out = series.even_sample(rows, "n", ["d"])
    found = {r.n: sorted(r.ds) for r in out.groupBy("n").agg(F.collect_list("d").alias("ds")).collect()}
    assert found == {n: sorted({round(j * (n - 1) / 11) + 1 for j in range(12)}) for n in range(13, 60)}
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_second_run_starts_from_what_the_first_left(spark):
    plan = rerun_queries.registrar_rerun(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"row_number\(\) windowspecdefinition", plan)) <= 4  # the first run is read, not worked out again for each use
