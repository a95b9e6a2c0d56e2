"""Queries over dated series, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import heatmaps, payouts, screener, series
from . import bindings as b
from .bindings import AS_OF, BENCH_SQL, MEMBER_SQL, NAV_SQL, PAYOUT_SQL


def sql_round(x: Column, places: int) -> Column:
    """x rounded as the SQL does: a product of doubles, not its decimal text, decides what is a half."""
    return F.round(x * 10**places) / 10**places


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at the output's precision; minus zero is zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def screener_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 1y returns of all series with status, staleness and final place."""
    found = b.members(spark, sf_dir).select("code", "name", "class").join(series.trailing(b.nav(spark, sf_dir), AS_OF, "1y"), "code")
    place = F.row_number().over(Window.partitionBy("status").orderBy(F.desc_nulls_last(F.round("return_pct", 6)), F.col("code").cast("string")))
    out = found.select("code", "name", "class", "start_day", "end_day", F.col("days").cast("long").alias("days"), F.col("stale_days").cast("long").alias("stale_days"), "status", "return_pct", place.cast("long").alias("place"))
    return rounded(out)


def endpoints_sql(source: str, months: int, table: str = "ep") -> str:
    start = f"(DATE '{AS_OF}' - INTERVAL {months} MONTH)::DATE"
    return f"""{table} AS (SELECT code, max(d) FILTER (WHERE d <= DATE '{AS_OF}') AS end_day, max_by(v, d) FILTER (WHERE d <= DATE '{AS_OF}') AS e_v,
  min(d) FILTER (WHERE d BETWEEN {start} AND {start} + 7) AS start_day, min_by(v, d) FILTER (WHERE d BETWEEN {start} AND {start} + 7) AS s_v FROM {source} GROUP BY code),
{table}2 AS (SELECT *, date_diff('day', start_day, end_day) AS days, date_diff('day', end_day, DATE '{AS_OF}') AS stale_days,
  CASE WHEN end_day IS NULL OR end_day < DATE '{AS_OF}' - 7 THEN 'stale_endpoint' WHEN start_day IS NULL THEN 'insufficient_history' WHEN start_day >= end_day THEN 'invalid_period' ELSE 'available' END AS status FROM {table})"""


ANNUAL_SQL = "(power(e_v / s_v, CAST(365 AS DOUBLE) / days) - 1) * 100"
SCREENER_SQL = f"""WITH {NAV_SQL}, {MEMBER_SQL}, {endpoints_sql("nav", 12)},
r AS (SELECT mem.code, name, class, start_day, end_day, days, stale_days, status, CASE WHEN status = 'available' THEN round({ANNUAL_SQL}, 6) END AS return_pct FROM mem JOIN ep2 USING (code))
SELECT *, row_number() OVER (PARTITION BY status ORDER BY return_pct DESC NULLS LAST, CAST(code AS VARCHAR)) AS place FROM r"""


def rolling_summary_1y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.rolling_summary(series.rolling(b.nav(spark, sf_dir), 1), ["code"]))


def rolling_sql(years: int, month_ends: bool, suffix: str = "") -> str:
    last = "max(d) OVER (PARTITION BY code, date_trunc('month', d))" if month_ends else "d"
    return f"""w{suffix} AS (SELECT code, d, v, {last} AS last_d, first_value(d) OVER win AS s_d, first_value(v) OVER win AS s_v FROM nav WINDOW win AS (PARTITION BY code ORDER BY d RANGE BETWEEN INTERVAL {years} YEAR PRECEDING AND CURRENT ROW)),
roll{suffix} AS (SELECT code, s_d AS start_day, d AS end_day, (power(v / s_v, CAST(365 AS DOUBLE) / date_diff('day', s_d, d)) - 1) * 100 AS r FROM w{suffix}
  WHERE d = last_d AND s_d < d AND s_d >= (d - INTERVAL {years} YEAR)::DATE AND s_d <= (d - INTERVAL {years} YEAR)::DATE + 7)"""


ROLLING_COLUMNS = """count(*) AS samples, min(end_day) AS first_end, max(end_day) AS last_end, round(max_by(r, end_day), 6) AS latest, round(min(r), 6) AS least, round(median(r), 6) AS median,
  round(avg(r), 6) AS mean, round(max(r), 6) AS most, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS positive_pct"""
ROLLING_1Y_SQL = f"WITH {NAV_SQL}, {rolling_sql(1, False)} SELECT code, {ROLLING_COLUMNS} FROM roll GROUP BY code"


def rolling_summary_monthly_3y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.rolling_summary(series.rolling(b.nav(spark, sf_dir), 3, month_ends=True), ["code"]))


ROLLING_3Y_SQL = f"WITH {NAV_SQL}, {rolling_sql(3, True)} SELECT code, {ROLLING_COLUMNS} FROM roll GROUP BY code"


def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.max_drawdown(b.nav(spark, sf_dir)))


DRAWDOWN_SQL = f"""WITH {NAV_SQL}, p AS (SELECT code, d, v, max(v) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM nav),
f AS (SELECT p.*, (v / peak - 1) * 100 AS fall FROM p), w AS (SELECT code, min(fall) AS worst FROM f GROUP BY code),
t AS (SELECT f.code, min(f.d) AS trough_day, min(f.fall) AS fall, min_by(f.peak, f.d) AS peak FROM f JOIN w ON f.code = w.code AND f.fall = w.worst GROUP BY f.code)
SELECT t.code, round(t.fall, 6) + 0.0 AS drawdown_pct, min(n.d) AS peak_day, min(t.trough_day) AS trough_day FROM t JOIN nav n ON n.code = t.code AND n.v = t.peak AND n.d <= t.trough_day GROUP BY t.code, t.fall"""


def since_inception(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.since_inception(b.nav(spark, sf_dir)))


INCEPTION_SQL = f"""WITH {NAV_SQL}, e AS (SELECT code, count(*) AS points, min(d) AS first_day, max(d) AS last_day, min_by(v, d) AS s_v, max_by(v, d) AS e_v FROM nav GROUP BY code)
SELECT code, points, first_day, last_day, round((e_v / s_v - 1) * 100, 6) AS total_pct, CASE WHEN last_day > first_day THEN round((power(e_v / s_v, CAST(365 AS DOUBLE) / date_diff('day', first_day, last_day)) - 1) * 100, 6) END AS annual_pct FROM e"""


def comparison_rebased(spark: SparkSession, sf_dir: str, codes: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Up to five series as multiples of their first value, in the order asked for."""
    if not codes or len(codes) > 5 or len(set(codes)) != len(codes):
        raise ValueError("one to five different codes")
    order = F.array_position(F.array(*[F.lit(c).cast("long") for c in codes]), F.col("code"))
    chosen = b.nav(spark, sf_dir).where(F.col("code").isin(*codes))
    return rounded(series.rebased(chosen).select(order.cast("long").alias("position"), "code", "d", "rebased"))


REBASED_SQL = f"WITH {NAV_SQL} SELECT code AS position, code, d, round(v / first_value(v) OVER (PARTITION BY code ORDER BY d) * 100, 6) AS rebased FROM nav WHERE code IN (1, 2, 3, 4, 5)"


def month_end_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.month_ends(b.nav(spark, sf_dir)), 8)


MONTH_END_SQL = f"WITH {NAV_SQL} SELECT code, CAST(date_trunc('month', d) AS DATE) AS month, max(d) AS d, round(max_by(v, d), 8) AS v FROM nav GROUP BY ALL"


def observation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between days, and whether a series' rows rise in the order in which the source has them."""
    rows = b.observations(spark, sf_dir).select("code", "d", (F.col("seq1") * 8 + F.col("seq2")).alias("seq"))
    return rounded(series.gaps(rows, "seq")).withColumn("largest_gap", F.col("largest_gap").cast("long"))


GAPS_SQL = f"""WITH {NAV_SQL}, g AS (SELECT code, date_diff('day', lag(d) OVER (PARTITION BY code ORDER BY d), d) AS gap FROM nav)
SELECT code, count(gap) AS steps, median(gap) AS median_gap, max(gap) AS largest_gap, (SELECT bool_and(up) FROM (SELECT d > lag(d) OVER (ORDER BY l_orderkey, l_linenumber) AS up FROM obs WHERE obs.code = g.code)) AS rising FROM g GROUP BY code"""


def heatmap_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of trailing 1y returns by class."""
    return rounded(heatmaps.fund_tiles(b.nav(spark, sf_dir), b.members(spark, sf_dir), AS_OF, ["1y"]))


def heatmap_rolling_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of rolling 1y returns that end with a month, by class."""
    return rounded(heatmaps.fund_tiles(b.nav(spark, sf_dir), b.members(spark, sf_dir), AS_OF, ["rolling_1y"]))


def heatmap_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of all seven trailing and four rolling periods, from one pass over the values for each kind."""
    return rounded(heatmaps.fund_tiles(b.nav(spark, sf_dir), b.members(spark, sf_dir), AS_OF, [*heatmaps.TRAILING, *heatmaps.ROLLING]))


PLACE_SQL = "row_number() OVER (PARTITION BY period ORDER BY value_pct DESC NULLS LAST, lower({0}), {1}) AS place"


def fund_tiles_sql(periods: list[str]) -> str:
    """Tiles from a part for each period: values of series with their status, then medians by class."""
    with_, parts = [NAV_SQL, MEMBER_SQL], []
    for i, p in enumerate(periods):
        if p in heatmaps.TRAILING:
            months = calendar.HORIZON_MONTHS[p]
            with_.append(endpoints_sql("nav", months, f"ep{i}_"))
            value = ANNUAL_SQL if months >= 12 else "(e_v / s_v - 1) * 100"
            parts.append(f"SELECT '{p}' AS period, class, product, coalesce(status, 'stale_endpoint') AS status, CASE WHEN status = 'available' THEN {value} END AS value, 1 AS samples, start_day AS fs, start_day AS ls, end_day AS fe, end_day AS le, stale_days FROM mem LEFT JOIN ep{i}_2 USING (code)")
        else:
            with_.append(rolling_sql(heatmaps.ROLLING[p], True, f"h{i}").replace("FROM nav WINDOW", f"FROM nav WHERE d <= DATE '{AS_OF}' WINDOW"))
            with_.append(f"rs{i} AS (SELECT code, median(r) AS m, count(*) AS n, min_by(start_day, end_day) AS fs, max_by(start_day, end_day) AS ls, min(end_day) AS fe, max(end_day) AS le FROM rollh{i} GROUP BY code)")
            with_.append(f"fr{i} AS (SELECT code, max(d) >= DATE '{AS_OF}' - 7 AS fresh FROM nav WHERE d <= DATE '{AS_OF}' GROUP BY code)")
            parts.append(f"SELECT '{p}' AS period, class, product, CASE WHEN NOT coalesce(fresh, false) THEN 'stale_endpoint' WHEN m IS NULL THEN 'insufficient_history' ELSE 'available' END AS status, m AS value, n AS samples, fs, ls, fe, le, date_diff('day', le, DATE '{AS_OF}') AS stale_days FROM mem LEFT JOIN fr{i} USING (code) LEFT JOIN rs{i} USING (code)")
    good = "FILTER (WHERE status = 'available')"
    tiles = f"""SELECT period, class, count(*) AS candidates, count(*) {good} AS constituents, count(*) FILTER (WHERE status = 'stale_endpoint') AS stale, count(*) FILTER (WHERE status = 'insufficient_history') AS too_short, CAST(coalesce(sum(samples) {good}, 0) AS BIGINT) AS samples,
  round(median(value) {good}, 6) AS value_pct, round(min(value) {good}, 6) AS least_pct, round(max(value) {good}, 6) AS most_pct, min(fs) {good} AS first_start, max(ls) {good} AS last_start, min(fe) {good} AS first_end, max(le) {good} AS last_end, max(stale_days) {good} AS most_stale_days,
  CASE WHEN count(DISTINCT product) = 1 THEN min(product) ELSE 'mixed' END AS product, CASE WHEN count(*) {good} > 0 THEN 'available' ELSE 'insufficient_history' END AS status, count(*) - count(*) {good} AS excluded, 'nav_only' AS basis FROM u GROUP BY ALL"""
    return f"WITH {', '.join(with_)}, u AS ({' UNION ALL '.join(parts)}), t AS ({tiles}) SELECT *, {PLACE_SQL.format('class', 'class')} FROM t"


def reference_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Instruments of each order priority by basis, and their values: price, gross and net apart."""
    base = b.benchmark(spark, sf_dir)
    kinds = {"price_index": F.col("v"), "gross_total_return_index": F.col("v") * 1.5, "net_total_return_index": F.col("v") + 1000}
    rows = None
    for kind, value in kinds.items():
        one = base.where(F.lit(True) if kind != "net_total_return_index" else F.col("d") > F.lit("1998-01-01").cast("date")).select(F.concat_ws("/", "code", F.lit(kind)).alias("code"), "d", value.alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    labels = b.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label")).distinct()
    instruments = labels.withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).withColumn("code", F.concat_ws("/", "label", "kind"))
    return rows, instruments


def reference_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the indices and, apart from them, of the gross and net benchmarks, over four periods."""
    values, instruments = reference_values(spark, sf_dir)
    parts = [heatmaps.reference_tiles(values, instruments, u, AS_OF, ["1m", "5y", "rolling_1y", "rolling_5y"]).withColumn("universe", F.lit(u)) for u in ("indices", "benchmarks")]
    return rounded(parts[0].unionByName(parts[1]))


def reference_sql() -> str:
    with_, parts = [BENCH_SQL], []
    kinds = (("price_index", "v", "price", "indices", "true"), ("gross_total_return_index", "v * 1.5", "gross_total_return", "benchmarks", "true"), ("net_total_return_index", "v + 1000", "net_total_return", "benchmarks", "d > DATE '1998-01-01'"))
    rows = " UNION ALL ".join(f"SELECT code || '/{k}' AS code, d, {v} AS v FROM bench WHERE {c} AND d <= DATE '{AS_OF}'" for k, v, _, _, c in kinds)
    names_ = " UNION ALL ".join(f"SELECT DISTINCT o_orderpriority || '/{k}' AS code, o_orderpriority AS label, '{basis}' AS basis, '{u}' AS universe FROM orders" for k, _, basis, u, _ in kinds)
    with_ += [f"nav AS ({rows})", f"ins AS ({names_})", "lastd AS (SELECT code, max(d) AS last_day FROM nav GROUP BY code)"]
    for i, p in enumerate(["1m", "5y", "rolling_1y", "rolling_5y"]):
        if p in heatmaps.TRAILING:
            months = calendar.HORIZON_MONTHS[p]
            with_.append(endpoints_sql("nav", months, f"ep{i}_"))
            value = ANNUAL_SQL if months >= 12 else "(e_v / s_v - 1) * 100"
            ok = "status = 'available'"
            parts.append(f"SELECT '{p}' AS period, code, label, basis, universe, coalesce(status, 'stale_endpoint') AS status, CASE WHEN {ok} THEN {value} END AS a, CASE WHEN {ok} THEN {value} END AS b, CASE WHEN {ok} THEN {value} END AS c, CASE WHEN {ok} THEN 1 ELSE 0 END AS samples, CASE WHEN {ok} THEN start_day END AS fs, CASE WHEN {ok} THEN start_day END AS ls, end_day AS fe, end_day AS le, stale_days FROM ins LEFT JOIN ep{i}_2 USING (code)")
        else:
            with_.append(rolling_sql(heatmaps.ROLLING[p], False, f"h{i}"))
            with_.append(f"rs{i} AS (SELECT code, median(r) AS m, min(r) AS lo, max(r) AS hi, count(*) AS n, min_by(start_day, end_day) AS fs, max_by(start_day, end_day) AS ls, min(end_day) AS fe, max(end_day) AS le FROM rollh{i} GROUP BY code)")
            with_.append(f"st{i} AS (SELECT ins.code, label, basis, universe, last_day, rs{i}.* EXCLUDE (code), CASE WHEN last_day IS NULL OR last_day < DATE '{AS_OF}' - 7 THEN 'stale_endpoint' WHEN m IS NULL THEN 'insufficient_history' ELSE 'available' END AS status FROM ins LEFT JOIN lastd ON lastd.code = ins.code LEFT JOIN rs{i} ON rs{i}.code = ins.code)")
            ok = "status = 'available'"
            parts.append(f"SELECT '{p}', code, label, basis, universe, status, CASE WHEN {ok} THEN m END, CASE WHEN {ok} THEN lo END, CASE WHEN {ok} THEN hi END, CASE WHEN {ok} THEN n ELSE 0 END, CASE WHEN {ok} THEN fs END, CASE WHEN {ok} THEN ls END, CASE WHEN {ok} THEN fe ELSE last_day END, CASE WHEN {ok} THEN le ELSE last_day END, date_diff('day', last_day, DATE '{AS_OF}') FROM st{i}")
    shown = "period, code, label, basis, universe, status, round(a, 6) AS value_pct, round(b, 6) AS least_pct, round(c, 6) AS most_pct, CAST(samples AS BIGINT) AS samples, fs AS first_start, ls AS last_start, fe AS first_end, le AS last_end, CAST(stale_days AS BIGINT) AS most_stale_days"
    return f"WITH {', '.join(with_)}, u AS ({' UNION ALL '.join(parts)}), t AS (SELECT {shown} FROM u) SELECT *, row_number() OVER (PARTITION BY universe, period ORDER BY value_pct DESC NULLS LAST, lower(label), code) AS place FROM t"


def screened_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with plan, option and identifier: every third pays out, every other is direct, some lack an identifier."""
    code = F.col("code")
    return b.members(spark, sf_dir).withColumns({"plan": F.when(code % 2 == 0, "direct").otherwise("regular"), "option": F.when(code % 3 == 0, "idcw").otherwise("growth"), "isin": F.when(code % 5 > 0, F.concat(F.lit("INF"), F.lpad(code.cast("string"), 8, "0"), F.lit("1")))})


def screener_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct growth series of two classes by their yearly return, and those left out with their reasons."""
    found = screener.candidates(screened_members(spark, sf_dir), classes=["ASIA", "EUROPE", "AMERICA"], plan="direct", option="growth", search="0")
    rows = screener.screened(found, b.nav(spark, sf_dir), None, AS_OF)
    out = screener.page(rows, by_payouts=False, limit=20)
    return rounded(out.select("part", "place", "code", "name", "class", "start_day", "end_day", "stale_days", "status", "reason_detail", "total_pct", "return_pct", "first_day", "candidates", "total", "stale", "too_short", "no_payouts"))


def screened_sql(option: str, plan: str, classes: str) -> str:
    return f"""{NAV_SQL}, {PAYOUT_SQL}, {MEMBER_SQL}, {endpoints_sql("nav", 12)}, fd AS (SELECT code, min(d) AS first_day FROM nav GROUP BY code), pd AS (SELECT code, sum(amount) AS paid, count(*) AS events FROM pay WHERE d > (DATE '{AS_OF}' - INTERVAL 1 YEAR)::DATE AND d <= DATE '{AS_OF}' GROUP BY code),
c AS (SELECT * FROM mem WHERE class IN ({classes}) AND code % 2 = {0 if plan == "direct" else 1} AND (code % 3 = 0) = {"true" if option == "idcw" else "false"}{" AND code % 5 > 0" if option == "idcw" else ""}),
s AS (SELECT c.code, name, class, start_day, end_day, stale_days, s_v, e_v, days, first_day, paid, events, CASE WHEN coalesce(status, 'stale_endpoint') = 'available' AND {"paid IS NULL" if option == "idcw" else "false"} THEN 'no_payout_events' ELSE coalesce(status, 'stale_endpoint') END AS status FROM c LEFT JOIN ep2 USING (code) LEFT JOIN fd USING (code) LEFT JOIN pd USING (code)),
dt AS (SELECT *, CASE status WHEN 'stale_endpoint' THEN CASE WHEN end_day IS NULL THEN 'no valid value on or before {AS_OF}' ELSE 'the latest valid value of ' || end_day || ' is before ' || (DATE '{AS_OF}' - 7) END WHEN 'insufficient_history' THEN 'no valid first value from 2000-06-30 to 2000-07-07' WHEN 'invalid_period' THEN 'first and last value are of one day' WHEN 'no_payout_events' THEN 'no current payout after 2000-06-30 and up to {AS_OF}' END AS reason_detail FROM s),
x AS (SELECT code, row_number() OVER (ORDER BY status, name, CAST(code AS VARCHAR)) AS place FROM dt WHERE status <> 'available'),
n AS (SELECT count(*) AS candidates, count(*) FILTER (WHERE status = 'available') AS total, count(*) FILTER (WHERE status = 'stale_endpoint') AS stale, count(*) FILTER (WHERE status = 'insufficient_history') AS too_short, count(*) FILTER (WHERE status = 'no_payout_events') AS no_payouts FROM dt)"""


SCREENER_PAGE_SQL = f"""WITH {screened_sql("growth", "direct", "'ASIA', 'EUROPE', 'AMERICA'")}, k AS (SELECT code, row_number() OVER (ORDER BY {ANNUAL_SQL} DESC, CAST(code AS VARCHAR)) AS place FROM dt WHERE status = 'available'),
p AS (SELECT 'ranked' AS part, * FROM k WHERE place <= 20 UNION ALL SELECT 'excluded', * FROM x WHERE place <= 25)
SELECT part, place, code, name, class, start_day, end_day, stale_days, status, reason_detail, CASE WHEN status IN ('available', 'no_payout_events') THEN round((e_v / s_v - 1) * 100, 6) END AS total_pct, CASE WHEN status IN ('available', 'no_payout_events') THEN round({ANNUAL_SQL}, 6) END AS return_pct, first_day, n.* FROM p JOIN dt USING (code), n"""


def income_screener_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular payout series of all classes by yield and number of payouts, and those left out."""
    found = screener.candidates(screened_members(spark, sf_dir), classes=["ASIA", "EUROPE", "AMERICA", "AFRICA", "MIDDLE EAST"], plan="regular", option="idcw")
    rows = screener.screened(found, b.nav(spark, sf_dir), b.payouts(spark, sf_dir), AS_OF).withColumn("yield_pct", F.round("yield_pct", 6))
    out = screener.page(rows, by_payouts=True, limit=10, offset=2)
    return rounded(out.select("part", "place", "code", "status", "reason_detail", "events", "yield_pct", "yield_rank", "events_rank", "score", "candidates", "total", "no_payouts"))


INCOME_PAGE_SQL = f"""WITH {screened_sql("idcw", "regular", "'ASIA', 'EUROPE', 'AMERICA', 'AFRICA', 'MIDDLE EAST'")}, g AS (SELECT code, events, round(paid / e_v * 100, 6) AS yield_pct FROM dt WHERE status = 'available'),
k AS (SELECT *, rank() OVER (ORDER BY yield_pct DESC) AS yield_rank, rank() OVER (ORDER BY events DESC) AS events_rank, ((1 - percent_rank() OVER (ORDER BY yield_pct DESC)) * 100 + (1 - percent_rank() OVER (ORDER BY events DESC)) * 100) / 2 AS score FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, yield_pct DESC, events DESC, CAST(code AS VARCHAR)) AS place FROM k)
SELECT 'ranked' AS part, place, code, 'available' AS status, NULL AS reason_detail, events, yield_pct, yield_rank, events_rank, round(score, 6) AS score, candidates, total, no_payouts FROM r, n WHERE place BETWEEN 3 AND 12
UNION ALL SELECT 'excluded', place, dt.code, status, reason_detail, events, NULL, NULL, NULL, NULL, candidates, total, no_payouts FROM x JOIN dt USING (code), n WHERE place <= 25"""


def benchmark_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 1y performance of each index, with what it rests on."""
    found = series.trailing(b.benchmark(spark, sf_dir), AS_OF, "1y")
    return rounded(found.select("code", "start_day", "end_day", "start_value", "end_value", F.col("days").cast("long").alias("days"), F.col("stale_days").cast("long").alias("stale_days"), "status", "return_pct"))


BENCHMARK_SQL = f"""WITH {BENCH_SQL}, {endpoints_sql("bench", 12)}
SELECT code, start_day, end_day, round(s_v, 6) AS start_value, round(e_v, 6) AS end_value, days, stale_days, status, CASE WHEN status = 'available' THEN round({ANNUAL_SQL}, 6) END AS return_pct FROM ep2"""


def benchmark_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing returns of each index over short horizons; those under a year are not annualised."""
    return rounded(series.trailing_horizons(b.benchmark(spark, sf_dir), AS_OF, ["1m", "3m", "6m", "3y"]).select("code", "horizon", "status", "return_pct"))


BENCHMARK_HORIZONS_SQL = f"WITH {BENCH_SQL}, " + ", ".join(endpoints_sql("bench", m, f"ep{m}_") for m in (1, 3, 6, 36)) + " " + " UNION ALL ".join(
    f"SELECT code, '{h}' AS horizon, status, CASE WHEN status = 'available' THEN round({'(e_v / s_v - 1) * 100' if m < 12 else ANNUAL_SQL}, 6) END AS return_pct FROM ep{m}_2" for h, m in (("1m", 1), ("3m", 3), ("6m", 6), ("3y", 36))
)


def benchmark_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and counts of each index, by distinct days."""
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderdate").cast("date").alias("d"))
    return o.groupBy("code").agg(F.count_distinct("d").alias("days"), F.count("*").alias("revisions"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


BENCHMARK_SERIES_SQL = "SELECT o_orderpriority AS code, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, count(*) AS revisions, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1"


def payout_composite_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by the mean of the percentile scores of payout yield and number of events."""
    found = payouts.trailing_yield(b.payouts(spark, sf_dir), b.nav(spark, sf_dir), AS_OF).where("status = 'available'")
    exact = found.withColumn("yield_pct", F.round("yield_pct", 6))
    return rounded(payouts.composite_rank(exact).select("code", "events", "yield_pct", "yield_rank", "events_rank", "yield_score", "events_score", "score", "place"))


YIELD_SQL = f"""y AS (SELECT code, count(*) AS events, sum(amount) AS paid FROM pay WHERE d > (DATE '{AS_OF}' - INTERVAL 1 YEAR)::DATE AND d <= DATE '{AS_OF}' GROUP BY code),
l AS (SELECT code, max(d) AS value_day, max_by(v, d) AS value FROM nav WHERE d <= DATE '{AS_OF}' GROUP BY code),
yl AS (SELECT l.code, events, paid, value_day, value, CASE WHEN value_day < DATE '{AS_OF}' - 7 THEN 'stale_endpoint' WHEN events IS NULL THEN 'no_payout_events' ELSE 'available' END AS status FROM l LEFT JOIN y USING (code))"""
RANK_SQL = f"""WITH {NAV_SQL}, {PAYOUT_SQL}, {YIELD_SQL}, g AS (SELECT code, events, round(paid / value * 100, 6) AS yield_pct FROM yl WHERE status = 'available'),
k AS (SELECT *, rank() OVER (ORDER BY yield_pct DESC) AS yield_rank, rank() OVER (ORDER BY events DESC) AS events_rank, (1 - percent_rank() OVER (ORDER BY yield_pct DESC)) * 100 AS ys, (1 - percent_rank() OVER (ORDER BY events DESC)) * 100 AS es FROM g)
SELECT code, events, yield_pct, yield_rank, events_rank, round(ys, 6) AS yield_score, round(es, 6) AS events_score, round((ys + es) / 2, 6) AS score,
  row_number() OVER (ORDER BY (ys + es) / 2 DESC, yield_pct DESC, events DESC, CAST(code AS VARCHAR)) AS place FROM k"""


def payout_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing payout yield of every series, with why there is none."""
    return rounded(payouts.trailing_yield(b.payouts(spark, sf_dir), b.nav(spark, sf_dir), AS_OF), 8)


PAYOUT_YIELD_SQL = f"WITH {NAV_SQL}, {PAYOUT_SQL}, {YIELD_SQL} SELECT code, events, round(paid, 8) AS paid, value_day, round(value, 8) AS value, status, CASE WHEN status = 'available' THEN round(paid / value * 100, 8) END AS yield_pct FROM yl"


def payout_yield_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payout sums of the five years up to five cut-offs, one column each, oldest first."""
    cuts = spark.range(1).select(F.posexplode(calendar.yearly_cutoffs(AS_OF)).alias("i", "cut"))
    inside = b.payouts(spark, sf_dir).join(F.broadcast(cuts), (F.col("d") > F.add_months("cut", -12)) & (F.col("d") <= F.col("cut")))  # five rows
    return rounded(inside.groupBy("code").pivot("i", [0, 1, 2, 3, 4]).agg(F.sum("amount")).select("code", *[F.col(str(i)).alias(f"paid_{i}") for i in range(5)]))


HISTORY_SQL = f"WITH {NAV_SQL}, {PAYOUT_SQL} SELECT code, " + ", ".join(
    f"round(sum(amount) FILTER (WHERE d > (DATE '{AS_OF}' - INTERVAL {5 - i} YEAR)::DATE AND d <= (DATE '{AS_OF}' - INTERVAL {4 - i} YEAR)::DATE), 6) AS paid_{i}" for i in range(5)
) + f" FROM pay WHERE d > (DATE '{AS_OF}' - INTERVAL 5 YEAR)::DATE AND d <= DATE '{AS_OF}' GROUP BY code"


NAMED = [" Monthly IDCW", " Quarterly IDCW", " Daily IDCW", "", "", " Half-Yearly Payout"]  # what names state, by turns, in the sample


def payout_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with payouts of 60, in each of five years, and the frequency that names and history support."""
    name = F.concat("name", F.element_at(F.array(*map(F.lit, NAMED)), (F.col("code") % 6 + 1).cast("int")))
    found = payouts.payout_frequency(b.payouts(spark, sf_dir), b.members(spark, sf_dir).select("code", name.alias("name")), "1996-07-01", AS_OF)
    return rounded(found.withColumn("blocks", F.array_join(F.transform("blocks", lambda x: x.cast("string")), "|")))


def frequency_sql(name: str) -> str:
    return f"""fi AS (SELECT code, d, date_trunc('month', d) AS m, CAST(floor(date_diff('month', DATE '1996-07-01', date_trunc('month', d)) / 12.0) AS INT) AS block FROM pay WHERE d >= DATE '1996-07-01' AND d <= DATE '{AS_OF}'),
fb AS (SELECT s_suppkey AS code, k.block, count(DISTINCT m) AS n FROM supplier CROSS JOIN (SELECT CAST(unnest(range(5)) AS INT) AS block) k LEFT JOIN fi ON fi.code = s_suppkey AND fi.block = k.block GROUP BY ALL),
ft AS (SELECT code, CAST(sum(n) AS BIGINT) AS months, min(n) AS least, string_agg(CAST(n AS VARCHAR), '|' ORDER BY block) AS blocks FROM fb GROUP BY code),
fg AS (SELECT code, count(*) AS events, median(gap) AS median_gap FROM (SELECT code, date_diff('day', lag(d) OVER (PARTITION BY code ORDER BY d), d) AS gap FROM fi) GROUP BY code),
fn AS (SELECT s_suppkey AS code, {name} AS name FROM supplier),
fa AS (SELECT ft.code, name, months, blocks, coalesce(events, 0) AS events, median_gap, months >= 48 AND least >= 8 AS mo, months >= 16 AND least >= 3 AS qu FROM ft JOIN fn USING (code) LEFT JOIN fg USING (code)),
fz AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)\\bmonth(ly)?\\b') THEN CASE WHEN mo THEN 'scheme_name_monthly' ELSE 'monthly_consistency_failed' END WHEN regexp_matches(name, '(?i)\\bquarter(ly)?\\b') THEN CASE WHEN qu THEN 'scheme_name_quarterly' ELSE 'quarterly_consistency_failed' END
  WHEN regexp_matches(name, '(?i)\\b(daily|weekly|fortnightly|annual|annually|half[ -]?yearly|semi[ -]?annual)\\b') THEN 'explicit_other_frequency' WHEN mo AND median_gap BETWEEN 20 AND 45 THEN 'observed_monthly_cadence' WHEN qu AND median_gap BETWEEN 60 AND 120 THEN 'observed_quarterly_cadence' ELSE 'no_supported_monthly_or_quarterly_cadence' END AS basis FROM fa),
fq AS (SELECT code, name, months, events, median_gap, blocks, basis, CASE WHEN basis IN ('scheme_name_monthly', 'observed_monthly_cadence') THEN 'monthly' WHEN basis IN ('scheme_name_quarterly', 'observed_quarterly_cadence') THEN 'quarterly' END AS frequency FROM fz)"""


FREQUENCY_SQL = frequency_sql("s_name")
CADENCE_SQL = f"WITH {NAV_SQL}, {PAYOUT_SQL}, {frequency_sql(f's_name || {NAMED}[s_suppkey % 6 + 1]')} SELECT * FROM fq"


def nearest_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each payout, the nearest index point within a week."""
    marks = b.payouts(spark, sf_dir).select(F.concat_ws("-", "code", "d").alias("id"), F.lit("1-URGENT").alias("code"), F.col("d").alias("t"))
    out = series.nearest(marks, b.benchmark(spark, sf_dir), 7)
    return rounded(out).withColumn("off_days", F.col("off_days").cast("long"))


NEAREST_SQL = f"""WITH {NAV_SQL}, {PAYOUT_SQL}, {BENCH_SQL}, m AS (SELECT CAST(code AS VARCHAR) || '-' || CAST(d AS VARCHAR) AS id, d AS t FROM pay),
j AS (SELECT id, t, abs(date_diff('day', t, d)) AS off_days, d, v, row_number() OVER (PARTITION BY id ORDER BY abs(date_diff('day', t, d)), d) AS rn FROM m JOIN bench ON bench.code = '1-URGENT' AND d BETWEEN t - 7 AND t + 7)
SELECT id, t, off_days, d, round(v, 6) AS v FROM j WHERE rn = 1"""


def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve evenly spaced points of each series."""
    return rounded(series.even_sample(b.nav(spark, sf_dir), "code", ["d"]), 8)


SAMPLE_SQL = f"""WITH {NAV_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM nav), k AS (SELECT unnest(range(12)) AS j)
SELECT DISTINCT code, d, round(v, 8) AS v FROM n, k WHERE n <= 12 OR i = round_even(j * (n - 1) / 11, 0)"""

QUERIES = {
    "screener_trailing": (screener_trailing, SCREENER_SQL),
    "rolling_summary_1y": (rolling_summary_1y, ROLLING_1Y_SQL),
    "rolling_summary_monthly_3y": (rolling_summary_monthly_3y, ROLLING_3Y_SQL),
    "max_drawdown": (max_drawdown, DRAWDOWN_SQL),
    "since_inception": (since_inception, INCEPTION_SQL),
    "comparison_rebased": (comparison_rebased, REBASED_SQL),
    "month_end_values": (month_end_values, MONTH_END_SQL),
    "observation_gaps": (observation_gaps, GAPS_SQL),
    "heatmap_trailing": (heatmap_trailing, fund_tiles_sql(["1y"])),
    "heatmap_rolling_monthly": (heatmap_rolling_monthly, fund_tiles_sql(["rolling_1y"])),
    "heatmap_periods": (heatmap_periods, fund_tiles_sql([*heatmaps.TRAILING, *heatmaps.ROLLING])),
    "reference_heatmap": (reference_heatmap, reference_sql()),
    "screener_page": (screener_page, SCREENER_PAGE_SQL),
    "income_screener_page": (income_screener_page, INCOME_PAGE_SQL),
    "benchmark_performance": (benchmark_performance, BENCHMARK_SQL),
    "benchmark_horizons": (benchmark_horizons, BENCHMARK_HORIZONS_SQL),
    "benchmark_series": (benchmark_series, BENCHMARK_SERIES_SQL),
    "payout_composite_rank": (payout_composite_rank, RANK_SQL),
    "payout_yield": (payout_yield, PAYOUT_YIELD_SQL),
    "payout_yield_history": (payout_yield_history, HISTORY_SQL),
    "payout_cadence": (payout_cadence, CADENCE_SQL),
    "nearest_markers": (nearest_markers, NEAREST_SQL),
    "even_samples": (even_samples, SAMPLE_SQL),
}
