"""More feeds written from the sample tables and read back: third parties' histories, captures and catalogues, fund lists, notices, with SQL for what has to be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import publication
from ..sources import catalogues, exchange
from . import bindings as b
from .source_queries import LINE, joined, lines_by_day

HISTORY_HEAD = "<tr><th>Dividend Record Date</th><th>Dividend (&#8377; / Unit)</th><th>NAV (&#8377;)</th><th>Dividend Yield (%)</th></tr>"


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows of a payout history, the latest first: a tenth of the quantity over 50 and the line's number, some without value, some under a wrong yield."""
    li = lines_by_day(spark, sf_dir)
    q, n = F.col("l_quantity").cast("long"), F.col("seq") % 11
    value = F.when(n == 3, 0).otherwise(50 + F.col("l_linenumber"))
    hundredths = F.call_function("div", 2000 * q + 50 + F.col("l_linenumber"), 2 * (50 + F.col("l_linenumber"))) + F.when(n == 5, 1).otherwise(0)
    return li.withColumns({"q": q, "n": n, "value": value, "hundredths": hundredths, "place": F.struct((-F.unix_date("d")).alias("a"), "seq", "l_partkey")})


HISTORY_SQL = """hl AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS BIGINT) AS q, (l_orderkey * 8 + l_linenumber) % 11 AS n, lag(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey * 8 + l_linenumber, l_partkey) AS before FROM lineitem),
he AS (SELECT *, CASE WHEN n = 3 THEN 'bad_value' WHEN before = d THEN 'repeated_day' WHEN n = 5 THEN 'yield' END AS error, CASE WHEN before = d THEN 'repeated_day' WHEN n = 5 THEN 'yield' END AS jerror FROM hl)"""


def third_party_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories in pages, one for each series: falling days and yields that are true to two digits."""
    rows = history_lines(spark, sf_dir)
    shown = F.format_string("%d.%02d%%", F.call_function("div", F.col("hundredths"), F.lit(100)), F.col("hundredths") % 100)
    cells = [F.date_format("d", "dd-MM-yyyy"), F.format_string("%d.%d", F.call_function("div", F.col("q"), F.lit(10)), F.col("q") % 10), F.col("value").cast("string"), shown]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    head = f"<script>var scheme_name = 'One';</script><table><tr><td>menu</td></tr></table><table id='{catalogues.HISTORY_TABLE}'>{HISTORY_HEAD}"
    pages = joined(rows, ["l_suppkey"], row, "place", head).select("source", F.concat("payload", F.lit("</table>")).alias("payload"))
    return catalogues.history_pages(pages).groupBy(F.col("source").cast("long").alias("code"), "error").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amounts"), F.max("d").alias("latest"))


HISTORY_PAGES_SQL = f"WITH {HISTORY_SQL} SELECT code, error, count(*) AS n, CAST(sum(CAST(q AS DECIMAL(18, 1)) / 10) AS DOUBLE) AS amounts, max(d) AS latest FROM he GROUP BY ALL"


def third_party_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same histories as the interface answers them: values may be zero, yields hold to ten digits."""
    rows = history_lines(spark, sf_dir)
    exact = (F.col("q") * 10 / (50 + F.col("l_linenumber"))).cast("decimal(38,15)")
    told = F.when(F.col("n") == 5, exact + F.lit("0.001").cast("decimal(4,3)")).otherwise(exact).cast("decimal(38,15)")
    item = F.concat(
        F.lit('{"dividend_date": "'), F.date_format("d", "dd-MM-yyyy"), F.lit('", "net_asset_value": '), F.col("value").cast("string"), F.lit(', "dividend_value": '), (F.col("q").cast("decimal(18,1)") / 10).cast("decimal(18,1)").cast("string"),
        F.lit(', "dividend_yield": '), told.cast("string"), F.lit("}"),
    )
    files = joined(rows, ["l_suppkey"], item, "place", "").select("source", F.concat(F.lit("["), F.replace("payload", F.lit(LINE), F.lit(",")), F.lit("]")).alias("payload"))
    return catalogues.history_json(files).groupBy(F.col("source").cast("long").alias("code"), "error").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amounts"))


ANSWERS_SQL = f"WITH {HISTORY_SQL} SELECT code, jerror AS error, count(*) AS n, CAST(sum(CAST(q AS DECIMAL(18, 1)) / 10) AS DOUBLE) AS amounts FROM he GROUP BY ALL"


def third_party_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each series by what they are worth, with counts of implausible and future days."""
    li = lines_by_day(spark, sf_dir)
    value = F.when(F.col("l_linenumber") == 3, 0.0).otherwise(1.0)
    day = F.date_sub("d", F.when(F.col("seq") % 19 == 0, 14000).otherwise(0))
    rows = li.select("l_suppkey", day.alias("d"), F.round(F.col("l_discount") - 0.05, 2).alias("amount"), value.alias("value"))
    by = rows.groupBy(F.col("l_suppkey").cast("string").alias("item"), catalogues.row_quality(F.col("value"), F.col("amount")).alias("quality")).agg(F.count("*").alias("n"))
    counters = catalogues.row_counters(rows, "2001-06-30")
    return by.unionByName(counters.select(F.lit("all").alias("item"), F.inline(F.array(*[F.struct(F.lit(c).alias("quality"), F.col(c).alias("n")) for c in counters.columns]))))


QUALITY_SQL = """WITH r AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) - CASE WHEN (l_orderkey * 8 + l_linenumber) % 19 = 0 THEN 14000 ELSE 0 END AS d, round(l_discount - 0.05, 2) AS a, CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 END AS v FROM lineitem)
SELECT CAST(code AS VARCHAR) AS item, CASE WHEN v = 0 THEN 'zero_reference_nav' WHEN a > 0 THEN 'valid' WHEN a = 0 THEN 'zero_amount' ELSE 'negative_amount' END AS quality, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT 'all', k, n FROM (SELECT count(*) AS "rows", count(*) FILTER (WHERE a > 0) AS positive, count(*) FILTER (WHERE a = 0) AS zero, count(*) FILTER (WHERE a < 0) AS negative, count(*) FILTER (WHERE v = 0) AS zero_reference, count(*) FILTER (WHERE d < DATE '1964-01-01') AS implausible, count(*) FILTER (WHERE d > DATE '2001-06-30') AS future FROM r) UNPIVOT (n FOR k IN ("rows", positive, zero, negative, zero_reference, implausible, future))"""


def third_party_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of both versions, one for each customer, and what breaks their contract."""
    c = b.table(spark, sf_dir, "customer")
    n, host = F.col("c_custkey") % 10, f"https://www.{catalogues.THIRD_PARTY}.com"
    page = F.concat(F.lit("<script>var scheme_name = '"), F.when(n == 7, F.lit("Another")).otherwise(F.col("c_name")), F.lit("';</script>"))
    asked = F.concat(F.lit(host + catalogues.HISTORY_PATH), F.when(n == 5, F.lit("Other")).otherwise(F.url_encode("c_name")))
    when = F.when((n == 3) | (n == 4), "2026-08-01T00:00:00").otherwise("2026-08-01T00:00:00Z")
    payload_sum = lambda p: F.sha2(F.when((n == 8) | (n == 9), F.lit("x")).otherwise(p), 256)
    one = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.when(n == 1, "other").otherwise(catalogues.THIRD_PARTY).alias("provider"), asked.alias("requested_url"), F.lit(host + catalogues.HISTORY_PATH + "x").alias("source_url"), when.alias("captured_at"), F.lit("House").alias("amc_name"), F.col("c_name").alias("requested_scheme_name"), payload_sum(page).alias("source_payload_sha256"), page.alias("source_payload")))
    two = F.to_json(F.struct(F.lit(2).alias("schema_version"), F.lit(catalogues.THIRD_PARTY).alias("provider"), F.when(n == 2, "b").otherwise("a" * 64).alias("catalog_sha256"), F.when(n == 6, F.lit("http://x.com")).otherwise(host + catalogues.DETAIL_PATH).alias("source_url"), when.alias("captured_at"), F.lit("House").alias("amc_name"), F.lit("C").alias("category"), F.col("c_name").alias("requested_scheme_name"), payload_sum(F.lit("null")).alias("source_payload_sha256"), F.lit("null").alias("source_payload")))
    lines = c.select(F.col("c_custkey").cast("string").alias("source"), F.when(n % 2 == 1, one).otherwise(two).alias("value"))
    return catalogues.third_party_captures(lines).select(F.col("source").cast("long").alias("capture"), F.col("version").cast("long").alias("version"), "house", "name", "error")


CAPTURES_SQL = """SELECT c_custkey AS capture, CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 2 END AS version, 'House' AS house, c_name AS name, CASE c_custkey % 10 WHEN 1 THEN 'provider' WHEN 2 THEN 'catalogue' WHEN 3 THEN 'naive_time' WHEN 4 THEN 'naive_time' WHEN 5 THEN 'requested' WHEN 6 THEN 'url' WHEN 7 THEN 'rendered' WHEN 8 THEN 'checksum' WHEN 9 THEN 'checksum' END AS error FROM customer"""


def third_party_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue for each nation: its customers as schemes by market segment, every checksum and query complete but in some."""
    c = b.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("name"))
    said = lambda names: F.to_json(names)
    per = c.groupBy("n", "category").agg(F.sort_array(F.collect_list("name")).alias("names"))
    query = F.struct("category", F.sha2(F.when(F.col("n") % 5 == 1, F.lit("x")).otherwise(said(F.col("names"))), 256).alias("source_payload_sha256"), said(F.col("names")).alias("source_payload"))
    house = F.concat(F.lit("H"), "n")
    each = per.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("category", query.alias("q"), "names"))).alias("x"))
    names = F.transform("x", lambda x: x["category"])
    told = F.when(F.col("n") % 5 == 2, F.concat(names, F.array(F.lit("more")))).otherwise(names)
    queries = F.array(F.struct(F.when(F.col("n") % 5 == 3, "else").otherwise(house).alias("amc_name"), F.sha2(said(told), 256).alias("categories_payload_sha256"), said(told).alias("categories_payload"), F.transform("x", lambda x: x["q"]).alias("scheme_queries")))
    schemes = F.flatten(F.transform("x", lambda x: F.transform(x["names"], lambda s: F.struct(F.concat(F.lit("H"), F.col("n")).alias("amc_name"), x["category"].alias("category"), s.alias("scheme_name")))))
    landing = F.concat(F.lit(f"<select id='{catalogues.AMC_SELECT}'><option value=''>Choose</option><option value='"), house, F.lit("'>"), house, F.lit("</option></select>"))
    payload = F.to_json(F.struct(
        F.lit(2).alias("schema_version"), F.lit(catalogues.THIRD_PARTY).alias("provider"), F.lit("2026-08-01T00:00:00Z").alias("captured_at"), F.lit(f"https://www.{catalogues.THIRD_PARTY}.com/x").alias("source_url"), F.sha2(landing, 256).alias("source_payload_sha256"), landing.alias("source_payload"),
        queries.alias("queries"), F.when(F.col("n") % 5 == 4, F.slice(schemes, 1, F.size(schemes) - 1)).otherwise(schemes).alias("schemes"),
    ))
    files = each.select(F.col("n").cast("string").alias("source"), payload.alias("payload"))
    return catalogues.third_party_catalogue(files).select(F.col("source").cast("long").alias("nation"), "house", "category", "scheme", "error")


CATALOGUE_SQL = """SELECT c_nationkey AS nation, 'H' || c_nationkey AS house, c_mktsegment AS category, c_name AS scheme, NULL AS error FROM customer WHERE c_nationkey % 5 = 0
UNION ALL SELECT DISTINCT c_nationkey, NULL, NULL, NULL, CASE c_nationkey % 5 WHEN 1 THEN 'checksum' WHEN 2 THEN 'categories' WHEN 3 THEN 'queries' ELSE 'schemes' END FROM customer WHERE c_nationkey % 5 > 0"""


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def isin_of(key: Column) -> Column:
    return F.concat(F.lit("INF"), F.lpad(key.cast("string"), 9, "0"))


def fund_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing file of each brand: parts as funds, some without lot, day or a good identifier, some twice."""
    p = b.table(spark, sf_dir, "part")
    n, key = F.col("p_partkey") % 12, F.col("p_partkey")
    cells = [
        F.concat(F.lit("S"), key), F.when(n == 1, "").otherwise(F.col("p_type")), quoted(F.concat("p_name", F.lit(", fund"))), F.when(n == 2, "32-Jan-07").otherwise("02-Jan-07"), F.when(n == 3, "0").otherwise("1"), F.when(n == 4, "INF").otherwise(isin_of(F.when(n == 5, key - 1).otherwise(key))),
        F.when(n == 6, "-1").otherwise("10"), F.lit("x"), F.lit("y"),
    ]
    files = joined(p, ["p_brand"], F.concat_ws(",", *cells), "p_partkey", ",".join(exchange.MASTER) + LINE)
    return exchange.etf_master(files.select("source", "payload")).select("source", "symbol", "underlying", "name", "listed", "isin", "error")


MASTER_SQL = """WITH p AS (SELECT *, p_partkey % 12 AS n, 'INF' || lpad(CAST(CASE WHEN p_partkey % 12 = 5 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR), 9, '0') AS i FROM part),
e AS (SELECT *, CASE n WHEN 4 THEN 'isin' WHEN 3 THEN 'lot' WHEN 2 THEN 'day' WHEN 1 THEN 'no_name' WHEN 6 THEN 'face' END AS bad FROM p)
SELECT p_brand AS source, 'S' || p_partkey AS symbol, CASE WHEN n = 1 THEN '' ELSE p_type END AS underlying, p_name || ', fund' AS name, CASE WHEN n <> 2 THEN DATE '2007-01-02' END AS listed, CASE WHEN n = 4 THEN 'INF' ELSE i END AS isin,
  coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY p_brand, CASE WHEN n = 4 THEN 'INF' ELSE i END, bad IS NULL ORDER BY p_partkey) > 1 THEN 'repeated' END) AS error FROM e"""


def fund_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exchange's list of funds of each year met with its prices by symbol and series: what has no price or identifier is unresolved."""
    li = lines_by_day(spark, sf_dir).withColumns({"y": F.year("d"), "m": F.col("l_partkey") % 300}).groupBy("y", "m").agg(F.min("l_partkey").alias("key"), F.count("*").alias("k"))
    n = F.col("m") % 9
    symbol = F.concat(F.lit("S"), "m")
    cells = [F.when(n == 1, "Y").otherwise("N"), F.lit("EQ"), symbol, quoted(F.concat(F.lit("Fund, "), "m")), *[F.lit("1")] * 5, F.lit("10"), F.when(n == 2, "x").otherwise("10"), F.lit("1"), F.when(n == 3, "0").otherwise("2"), F.lit("1"), F.lit("Gold")]
    daily = exchange.etf_daily(joined(li, ["y"], F.concat_ws(",", *cells), "m", ",".join(exchange.DAILY) + LINE).select("source", "payload")).where("error is null")
    prices = li.where("m % 4 > 0").select(F.col("y").cast("string").alias("d"), symbol.alias("symbol"), F.lit("EQ").alias("series"), F.when(F.col("m") % 5 > 0, isin_of(F.col("m"))).alias("isin"), F.col("k").cast("double").alias("close"), F.lit(None).cast("string").alias("close_issue"), F.lit(None).cast("string").alias("error"))
    return exchange.resolved_by_membership(daily.withColumnRenamed("source", "d").select("d", "symbol", "series", "name"), prices).select("d", "symbol", "name", "isin", "close", "identity")


MEMBERSHIP_SQL = """WITH g AS (SELECT year(l_shipdate) AS y, l_partkey % 300 AS m, count(*) AS k FROM lineitem GROUP BY ALL)
SELECT CAST(y AS VARCHAR) AS d, 'S' || m AS symbol, 'Fund, ' || m AS name, CASE WHEN m % 4 > 0 AND m % 5 > 0 THEN 'INF' || lpad(CAST(m AS VARCHAR), 9, '0') END AS isin, CASE WHEN m % 4 > 0 THEN CAST(k AS DOUBLE) END AS close, CASE WHEN m % 4 > 0 AND m % 5 > 0 THEN 'official' ELSE 'identity_unresolved' END AS identity FROM g WHERE m % 9 NOT IN (1, 2, 3)"""


def house_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A house's notices, one for each supplier: two options that share one amount, some without it, without a day or of another issuer."""
    s = b.table(spark, sf_dir, "supplier")
    n, name = F.col("s_suppkey") % 6, F.concat(F.lit("HDFC Fund "), F.col("s_suppkey"))
    option = lambda plan, value: F.concat(name, F.lit(f" - {plan} Plan - IDCW Option (Payout and Reinvestment)"), value)
    amount = F.format_string("0.%03d ", (F.col("s_suppkey") % 900 + 50).cast("int"))
    payload = F.concat_ws(
        LINE, F.when(n == 1, "Other").otherwise(catalogues.NOTICE_MARKS[0]), F.concat(F.lit(f"the Distribution under Income {catalogues.NOTICE_MARKS[1]} is declared and Wednesday, "), F.when(n == 2, "Smarch").otherwise("February"), F.lit(" 25, 2026 is fixed as the Record Date")),
        F.lit("Name of the Scheme / Plan(s) / Option(s) Net Asset Value Amount of Distribution Face Value"), option("Regular", F.lit(" 38.386")), F.concat(F.when(n == 3, F.lit("")).otherwise(amount), F.lit("10.00")), option("Direct", F.when(n == 4, F.lit("")).otherwise(F.lit(" 45.270"))),
        F.lit("#Amount of distribution per unit will be lower."),
    )
    rows = catalogues.notices(s.select(F.col("s_suppkey").cast("string").alias("source"), payload.alias("payload")))
    return rows.select(F.col("source").cast("long").alias("code"), "name", "plan", "d", F.col("amount").cast("double").alias("amount"), "error")


NOTICES_SQL = """WITH s AS (SELECT s_suppkey AS code, s_suppkey % 6 AS n, 'HDFC Fund ' || s_suppkey AS name, (s_suppkey % 900 + 50) / 1000.0 AS amount FROM supplier)
SELECT code, name, unnest(['regular', 'direct']) AS plan, DATE '2026-02-25' AS d, CAST(amount AS DOUBLE) AS amount, NULL AS error FROM s WHERE n IN (0, 5)
UNION ALL SELECT code, NULL, NULL, CASE WHEN n <> 2 THEN DATE '2026-02-25' END, NULL, CASE n WHEN 1 THEN 'issuer' WHEN 2 THEN 'bad_date' WHEN 3 THEN 'amounts' ELSE 'no_value' END FROM s WHERE n BETWEEN 1 AND 4"""


def notice_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A house's own rows, which agree with what is current, on their way to events: linked, or inserted where nothing is current."""
    li = b.table(spark, sf_dir, "lineitem")
    amount = ((F.col("l_suppkey") + F.month("l_shipdate")) % 9 + 1) / 10
    day = F.trunc("l_shipdate", "MM")
    rows = li.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("code"), day.alias("d"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), amount.alias("amount"))
    held = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("code"), day.alias("d"), amount.alias("amount")).distinct()
    events = held.where("code % 4 > 0").select("code", "d", F.when(F.col("code") % 4 > 1, F.col("amount")).alias("amount"), F.lit(2).alias("tier"), F.lit(3).alias("revision"))
    told = publication.publish_notice(rows, events)
    return told.groupBy("code", "d", "action", F.col("revision").cast("long").alias("revision"), "amount").agg(F.count("*").alias("n"))


NOTICE_PUBLICATION_SQL = """WITH r AS (SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, count(*) AS n, ((any_value(l_suppkey) + any_value(month(l_shipdate))) % 9 + 1) / 10 AS amount FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
e AS (SELECT DISTINCT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_suppkey % 4 > 1 AS current FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 4 > 0),
j AS (SELECT r.*, coalesce(current, false) AS current, CASE WHEN e.code IS NULL THEN 0 ELSE 3 END AS rev FROM r LEFT JOIN e ON e.code = r.code AND e.d = r.d), a AS (SELECT code, d, amount, unnest(CASE WHEN current THEN [{'a': 'linked', 'v': rev, 'n': n}] WHEN n > 1 THEN [{'a': 'inserted', 'v': rev + 1, 'n': 1}, {'a': 'linked', 'v': rev + 1, 'n': n - 1}] ELSE [{'a': 'inserted', 'v': rev + 1, 'n': 1}] END) AS x FROM j)
SELECT code, d, x.a AS action, CAST(x.v AS BIGINT) AS revision, amount, x.n AS n FROM a"""


def missing_file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the exchange sends in place of a file, among the sample's own pages."""
    p = b.table(spark, sf_dir, "pages")
    home = F.concat(F.lit("  <!DOCTYPE html>"), *[F.concat(F.lit(" "), F.lit(m)) for m in catalogues.MISSING_FILE_MARKS], F.lit(" "), F.coalesce("html", F.lit("")))
    payload = F.when(F.col("page_id") % 3 == 0, home).when(F.col("page_id") % 3 == 1, F.col("html")).otherwise(F.replace(home, F.lit("<!DOCTYPE html>"), F.lit("")))
    return p.select("page_id", F.coalesce(catalogues.is_missing_file_page(payload), F.lit(False)).alias("missing"))


MISSING_SQL = "SELECT page_id, page_id % 3 = 0 AS missing FROM pages"

QUERIES = {
    "third_party_pages": (third_party_pages, HISTORY_PAGES_SQL),
    "third_party_answers": (third_party_answers, ANSWERS_SQL),
    "third_party_quality": (third_party_quality, QUALITY_SQL),
    "third_party_captures": (third_party_captures, CAPTURES_SQL),
    "third_party_catalogue": (third_party_catalogue, CATALOGUE_SQL),
    "fund_master": (fund_master, MASTER_SQL),
    "fund_membership": (fund_membership, MEMBERSHIP_SQL),
    "house_notices": (house_notices, NOTICES_SQL),
    "notice_publication": (notice_publication, NOTICE_PUBLICATION_SQL),
    "missing_file_pages": (missing_file_pages, MISSING_SQL),
}
