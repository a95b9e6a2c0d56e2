"""Queries that cover whole tables: each against its SQL, on rows with small and large identifiers."""

import datetime

import duckdb
import pandas as pd

from seriesloom.plans import catalog_queries, report_queries, series_queries

D = datetime.date


def lines(**columns):
    base = {"l_orderkey": 1, "l_linenumber": 1, "l_suppkey": 1, "l_quantity": 1.0, "l_extendedprice": 100.25, "l_tax": 0.5, "l_discount": 0.5, "l_returnflag": "R", "l_linestatus": "F", "l_shipdate": D(2000, 1, 1)}
    return pd.DataFrame(base | columns)


def both(spark, folder, query, sql, **tables):
    """The sorted rows of a query over the tables, and of its SQL."""
    con = duckdb.connect()
    for name, rows in tables.items():
        rows.to_parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    df = query(spark, str(folder))
    return sorted(map(tuple, df.collect())), sorted(con.sql(f"select {', '.join(df.columns)} from ({sql})").fetchall())


def test_return_bases_of_late_orders(spark, tmp_path):
    rows = lines(l_orderkey=[500, 501, 100_000], l_discount=[0.5, 0.25, 0.0])
    found, wanted = both(spark, tmp_path, catalog_queries.return_bases, catalog_queries.BASES_SQL, lineitem=rows)
    assert found == wanted and {r[0] for r in found} == {500, 501, 100_000}


def test_alias_versions_of_all_users(spark, tmp_path):
    rows = pd.DataFrame({"user_id": [50, 51, 51, 51, 900], "event_id": [1, 2, 3, 4, 5], "event_type": ["x", "x", "x", "y", "z"]})
    query, sql = report_queries.alias_versions, report_queries.VERSIONS_SQL
    found, wanted = (sorted(map(str, x)) for x in both(spark, tmp_path, query, sql, events=rows))
    assert found == wanted and len(found) == 4


def test_identity_mapping_of_all_series(spark, tmp_path):
    days = [D(2000, m, 2) for m in (1, 2, 3)]
    rows = lines(l_suppkey=[20] * 3 + [21] * 3 + [900] * 3, l_shipdate=days * 3, l_orderkey=range(9))
    query, sql = catalog_queries.identity_mapping, catalog_queries.IDENTITY_SQL
    found, wanted = both(spark, tmp_path, query, sql, lineitem=rows)
    assert found == wanted == [(1020, 1, "mapped", 20), (1021, 1, "mapped", 21), (1900, 1, "mapped", 900)]


def test_scheme_distributions_of_all_series(spark, tmp_path):
    days = [D(2000, 1, 1) + datetime.timedelta(i) for i in range(60)]
    rows = lines(l_suppkey=[5] * 60 + [6] * 60 + [900], l_shipdate=[*days, *days, days[0]], l_orderkey=range(121))
    query, sql = report_queries.scheme_distributions, report_queries.DISTRIBUTIONS_SQL
    found, wanted = both(spark, tmp_path, query, sql, lineitem=rows)
    assert found == wanted and [sum(r[0] == c for r in found) for c in (5, 6, 900)] == [50, 50, 1]


def test_nearest_markers_of_all_series(spark, tmp_path):
    rows = lines(l_suppkey=[3, 4, 900, 901], l_shipdate=[D(2000, 1, 1), D(2000, 1, 2), D(2000, 1, 6), D(2001, 1, 1)])
    index = pd.DataFrame({"o_orderkey": [1, 2], "o_orderpriority": "1-URGENT", "o_orderdate": [D(2000, 1, 1), D(2000, 1, 3)], "o_totalprice": [10.0, 20.0]})
    query, sql = series_queries.nearest_markers, series_queries.NEAREST_SQL
    found, wanted = both(spark, tmp_path, query, sql, lineitem=rows, orders=index)
    assert found == wanted and [(r[0], r[2], r[4]) for r in found] == [("3-2000-01-01", 0, 10.0), ("4-2000-01-02", 1, 10.0), ("900-2000-01-06", 3, 20.0)]
