"""Details that readers ask for one by one: comparisons, whole performances, reviews that are due, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import returns, text
from ..operators import comparison, heatmaps, quality, series
from . import bindings as b
from . import publication_queries as p
from .series_queries import ROLLING_COLUMNS, rolling_sql, rounded

START, END = "1999-01-01", "2000-12-31"


def fund_comparison(spark: SparkSession, sf_dir: str, klass: str = "EUROPE") -> DataFrame:
    """The five first series of a class side by side, the last of them first."""
    members = b.members(spark, sf_dir)
    codes = [r.code for r in members.where(F.col("class") == klass).orderBy("code").limit(comparison.MOST).collect()][::-1]
    return rounded(comparison.side_by_side(members, b.nav(spark, sf_dir), b.payouts(spark, sf_dir), codes, START, END))


COMPARISON_SQL = f"""WITH {b.NAV_SQL}, {b.PAYOUT_SQL}, {b.MEMBER_SQL}, c AS (SELECT code, name, row_number() OVER (ORDER BY code) AS k FROM mem WHERE class = 'EUROPE' QUALIFY row_number() OVER (ORDER BY code) <= 5), k AS (SELECT code, name, (SELECT max(k) FROM c) + 1 - k AS position FROM c)
SELECT position, k.code, name, 'point' AS part, d, round(v, 6) AS value, round(v / first_value(v) OVER (PARTITION BY k.code ORDER BY d) * 100, 6) AS rebased, CAST(NULL AS DOUBLE) AS amount FROM k JOIN nav ON nav.code = k.code WHERE d BETWEEN DATE '{START}' AND DATE '{END}'
UNION ALL SELECT position, k.code, name, 'payout', d, NULL, NULL, round(amount, 6) FROM k JOIN pay ON pay.code = k.code WHERE d BETWEEN DATE '{START}' AND DATE '{END}'"""


def scheme_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every series: rolling returns over one, three, five and ten years, beside since inception and its worst fall."""
    nav = b.nav(spark, sf_dir)
    rolled = series.rolling_summary(series.rolling_years(nav, (1, 3, 5, 10)), ["code", "years"])
    lengths = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))).alias("years"))
    whole = series.since_inception(nav).join(series.max_drawdown(nav), "code").crossJoin(F.broadcast(lengths))  # four rows
    out = whole.join(rolled, ["code", "years"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return rounded(out.withColumn("years", F.col("years").cast("long")))


PERFORMANCE_SQL = f"""WITH {b.NAV_SQL}, {", ".join(rolling_sql(y, False, f"_{y}") for y in (1, 3, 5, 10))}, ro AS ({" UNION ALL ".join(f"SELECT code, {y} AS years, {ROLLING_COLUMNS} FROM roll_{y} GROUP BY code" for y in (1, 3, 5, 10))}),
si AS (SELECT code, count(*) AS points, min(d) AS first_day, max(d) AS last_day, min_by(v, d) AS s, max_by(v, d) AS e FROM nav GROUP BY code),
pk AS (SELECT code, d, v, max(v) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM nav), wo AS (SELECT code, min(v / peak - 1) AS fall, arg_min(d, struct_pack(f := v / peak - 1, d := d)) AS trough_day, arg_min(peak, struct_pack(f := v / peak - 1, d := d)) AS peak FROM pk GROUP BY code),
dd AS (SELECT wo.code, round(any_value(fall) * 100, 6) + 0.0 AS drawdown_pct, min(nav.d) AS peak_day, any_value(trough_day) AS trough_day FROM wo JOIN nav ON nav.code = wo.code AND nav.v = wo.peak AND nav.d <= wo.trough_day GROUP BY wo.code)
SELECT si.code, y.years, points, first_day, last_day, round((e / s - 1) * 100, 6) AS total_pct, round((power(e / s, CAST(365 AS DOUBLE) / nullif(date_diff('day', first_day, last_day), 0)) - 1) * 100, 6) AS annual_pct, drawdown_pct, peak_day, trough_day, coalesce(samples, 0) AS samples, first_end, last_end, latest, least, median, mean, most, positive_pct
FROM si JOIN dd ON dd.code = si.code CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS years) y LEFT JOIN ro ON ro.code = si.code AND ro.years = y.years"""


def label_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options whose labels wait for a review, by what the labels say."""
    found = quality.label_review_items(p.gated_lines(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, "|") for c in ("schemes", "labels")})


KIND_SQL = "CASE gate WHEN 'explicit_bonus_option' THEN 'bonus' WHEN 'explicit_growth_or_cumulative_option' THEN 'growth_or_cumulative' WHEN 'ambiguous_bonus_or_distribution_option' THEN 'bonus_or_distribution' WHEN 'conflicting_option_labels' THEN 'conflicting' WHEN 'unknown_option_label' THEN 'unknown' END"
LABEL_REVIEWS_SQL = f"WITH {p.GATED_SQL} SELECT {KIND_SQL} AS classification, code, count(*) AS records, string_agg(DISTINCT scheme, '|' ORDER BY scheme) AS schemes, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM gt WHERE {KIND_SQL} IS NOT NULL GROUP BY ALL"


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of payout rows that no option has, with the latest of their reviews: orders of the customer of that number."""
    rows = p.labelled_lines(spark, sf_dir).withColumns({"fund": F.concat(F.lit("m"), F.col("code") % 5), "scheme_code": F.concat(F.lit("s"), F.col("seq") % 3)})
    status = F.when(F.col("o_orderstatus") == "F", "mapped").when(F.col("o_orderstatus") == "O", "source_only").otherwise("source_error")
    reviews = b.table(spark, sf_dir, "orders").where("o_custkey % 22 > 0").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").alias("reviewed_at"), F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("evidence"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") + 1).alias("matched"))
    return quality.unresolved_identifiers(rows, p.known_options(spark, sf_dir), reviews)


IDENTIFIER_SQL = f"""{p.GATED_SQL}, rv AS (SELECT o_custkey AS code, o_orderkey AS review, CASE o_orderstatus WHEN 'F' THEN 'mapped' WHEN 'O' THEN 'source_only' ELSE 'source_error' END AS status, o_orderpriority AS evidence, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 END AS matched FROM orders WHERE o_custkey % 22 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
ui AS (SELECT code, count(*) AS records, string_agg(DISTINCT 'm' || code % 5, '|') AS funds, string_agg(DISTINCT 's' || seq % 3, '|' ORDER BY 's' || seq % 3) AS scheme_codes, count(DISTINCT scheme) AS schemes, count(DISTINCT label) AS labels, min(d) AS first_day, max(d) AS last_day FROM gt WHERE NOT known GROUP BY code)"""


def unresolved_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers(spark, sf_dir)
    return found.withColumns({**{c: F.array_join(c, "|") for c in ("funds", "scheme_codes")}, **{c: F.size(c).cast("long") for c in ("schemes", "labels")}})


UNRESOLVED_SQL = f"WITH {IDENTIFIER_SQL} SELECT ui.*, status, review, evidence, matched FROM ui LEFT JOIN rv ON rv.code = ui.code"


def identifier_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved identifiers by the state of their review."""
    return quality.review_counts(identifiers(spark, sf_dir))


REVIEW_COUNTS_SQL = f"WITH {IDENTIFIER_SQL} SELECT s.item, count(ui.code) AS n FROM (SELECT unnest({[*quality.REVIEW_STATES]}) AS item) s LEFT JOIN (SELECT ui.code, coalesce(status, 'unreviewed') AS item FROM ui LEFT JOIN rv ON rv.code = ui.code) ui ON ui.item = s.item GROUP BY s.item"


def latest_payout_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata version of each series whose last value is under a payout option's."""
    obs = b.observations(spark, sf_dir)
    version = F.concat_ws("-", "code", "l_returnflag")
    nav = series.current(obs.withColumn("version", version), ["code", "d"], ["seq1", "seq2", "version"], ["version"])
    options = obs.groupBy("code").agg(F.max("d").alias("last_day"))
    metadata = obs.select(version.alias("version"), F.when(F.col("l_returnflag") == "N", "growth").otherwise("idcw").alias("option")).distinct()
    return quality.latest_payout_options(options, nav, metadata)


LATEST_OPTIONS_SQL = """SELECT code, version FROM (SELECT l_suppkey AS code, l_suppkey || '-' || l_returnflag AS version, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey || '-' || l_returnflag DESC) AS k FROM lineitem) WHERE k = 1 AND l_returnflag <> 'N'"""


def heatmap_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of two trailing periods with their place on a symmetric scale of colours, and labels in title case."""
    tiles = heatmaps.fund_tiles(b.nav(spark, sf_dir), b.members(spark, sf_dir), "2001-06-30", ["1y", "3y"])
    scale = tiles.groupBy("period").agg(returns.colour_scale(F.col("value_pct")).alias("scale"))
    return rounded(tiles.join(scale, "period").select("period", text.titled(F.lower("class"), F.col("product")).alias("label"), (F.col("value_pct") / F.col("scale")).alias("colour"), "scale"))


def tile_sql(months: int) -> str:
    return f"""SELECT code, max(d) FILTER (WHERE d <= DATE '2001-06-30') AS e_d, max_by(v, d) FILTER (WHERE d <= DATE '2001-06-30') AS e_v, min(d) FILTER (WHERE d BETWEEN DATE '2001-06-30' - INTERVAL {months} MONTH AND DATE '2001-06-30' - INTERVAL {months} MONTH + INTERVAL 7 DAY) AS s_d,
  min_by(v, d) FILTER (WHERE d BETWEEN DATE '2001-06-30' - INTERVAL {months} MONTH AND DATE '2001-06-30' - INTERVAL {months} MONTH + INTERVAL 7 DAY) AS s_v FROM nav GROUP BY code"""


COLOURS_SQL = f"""WITH {b.NAV_SQL}, {b.MEMBER_SQL}, e AS (SELECT '1y' AS period, * FROM ({tile_sql(12)}) UNION ALL SELECT '3y', * FROM ({tile_sql(36)})),
t AS (SELECT period, class, CASE WHEN count(DISTINCT product) = 1 THEN min(product) ELSE 'mixed' END AS product, median(CASE WHEN e_d >= DATE '2001-06-23' AND s_d < e_d THEN (power(e_v / s_v, CAST(365 AS DOUBLE) / date_diff('day', s_d, e_d)) - 1) * 100 END) AS v FROM mem CROSS JOIN (SELECT unnest(['1y', '3y']) AS period) p LEFT JOIN e USING (code, period) GROUP BY period, class),
s AS (SELECT period, greatest(1, max(abs(v))) AS scale FROM t GROUP BY period)
SELECT t.period, array_to_string(list_transform(string_split(lower(class) || ' ' || replace(product, '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS label, round(v / scale, 6) AS colour, round(scale, 6) AS scale FROM t JOIN s ON s.period = t.period"""

QUERIES = {
    "fund_comparison": (fund_comparison, COMPARISON_SQL),
    "scheme_performance": (scheme_performance, PERFORMANCE_SQL),
    "label_reviews": (label_reviews, LABEL_REVIEWS_SQL),
    "unresolved_identifiers": (unresolved_identifiers, UNRESOLVED_SQL),
    "identifier_review_counts": (identifier_review_counts, REVIEW_COUNTS_SQL),
    "latest_payout_options": (latest_payout_options, LATEST_OPTIONS_SQL),
    "heatmap_colours": (heatmap_colours, COLOURS_SQL),
}
