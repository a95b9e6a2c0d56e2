"""Reports and drill-downs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ledgers, payouts, series, similarity
from . import bindings as b
from .bindings import AS_OF, BENCH_SQL, MEMBER_SQL, NAV_SQL, PAYOUT_SQL
from .series_queries import YIELD_SQL, rolling_sql, rounded, sql_round


def label_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names alike by words or by blocks of characters."""
    return similarity.proposals(b.table(spark, sf_dir, "part").select(F.col("p_name").alias("label")), 0.82)


def scheme_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 50 payout days of each series, with revisions and every source beside each."""
    obs = b.observations(spark, sf_dir).where("l_returnflag = 'R'").withColumn("amount", sql_round(F.col("l_discount") * F.col("v"), 6))
    source = F.concat_ws(":", F.lpad(F.col("seq1").cast("string"), 12, "0"), F.col("seq2").cast("string"), F.col("l_linestatus"))
    days = obs.groupBy("code", "d").agg(F.count("*").alias("revisions"), F.max_by("amount", F.struct("seq1", "seq2")).alias("amount"), F.array_join(F.sort_array(F.collect_list(source)), "|").alias("provenance"))
    latest = Window.partitionBy("code").orderBy(F.desc("d"))
    return days.withColumn("n", F.row_number().over(latest)).where("n <= 50").drop("n")


DISTRIBUTIONS_SQL = f"""WITH {NAV_SQL}, o AS (SELECT code, d, round(l_discount * v, 6) AS amount, l_orderkey, l_linenumber, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || ':' || l_linenumber || ':' || l_linestatus AS src FROM obs WHERE l_returnflag = 'R'),
g AS (SELECT code, d, count(*) AS revisions, max_by(amount, l_orderkey * 100 + l_linenumber) AS amount, string_agg(src, '|' ORDER BY src) AS provenance FROM o GROUP BY ALL)
SELECT code, d, revisions, amount, provenance FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS n FROM g) WHERE n <= 50"""


def scheme_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each house with first and last day over their series."""
    last = b.nav(spark, sf_dir).groupBy("code").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return b.members(spark, sf_dir).join(last, "code").groupBy("house", "class").agg(F.count("*").alias("series"), F.min("lo").alias("first_day"), F.max("hi").alias("last_day"))


CATEGORIES_SQL = f"WITH {NAV_SQL}, {MEMBER_SQL}, l AS (SELECT code, min(d) AS lo, max(d) AS hi FROM nav GROUP BY code) SELECT house, class, count(*) AS series, min(lo) AS first_day, max(hi) AS last_day FROM mem JOIN l USING (code) GROUP BY ALL"


def latest_rolling_by_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rolling return of each series over one, three and five years, one column each."""
    each = series.rolling_years(b.nav(spark, sf_dir), (1, 3, 5)).groupBy("code").agg(*[F.max_by(F.when(F.col("years") == y, F.col("r")), F.when(F.col("years") == y, F.col("end_day"))).alias(f"r{y}") for y in (1, 3, 5)])
    return rounded(b.members(spark, sf_dir).select("code").join(each, "code", "left"))


LATEST_ROLLING_SQL = "SELECT s_suppkey AS code, " + ", ".join(f"r{y}" for y in (1, 3, 5)) + " FROM supplier " + " ".join(
    f"LEFT JOIN (WITH {NAV_SQL}, {rolling_sql(y, False)} SELECT code, round(max_by(r, end_day), 6) AS r{y} FROM roll GROUP BY code) x{y} ON x{y}.code = s_suppkey" for y in (1, 3, 5)
)


def income_screener(spark: SparkSession, sf_dir: str, size: int = 20, offset: int = 10) -> DataFrame:
    """A page of the payout ranking, then every exclusion with its reason."""
    found = payouts.trailing_yield(b.payouts(spark, sf_dir), b.nav(spark, sf_dir), AS_OF)
    good = found.where("status = 'available'").withColumn("yield_pct", F.round("yield_pct", 6))
    ranked = payouts.composite_rank(good).where(F.col("place").between(offset + 1, offset + size))
    page = ranked.select(F.lit("ranked").alias("part"), "code", "place", "yield_pct", "status")
    out = found.where("status <> 'available'").select(F.lit("excluded").alias("part"), "code", F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("yield_pct"), "status")
    return rounded(page.unionByName(out))


INCOME_SCREENER_SQL = f"""WITH {NAV_SQL}, {PAYOUT_SQL}, {YIELD_SQL}, g AS (SELECT code, events, round(paid / value * 100, 6) AS yield_pct FROM yl WHERE status = 'available'),
k AS (SELECT *, ((1 - percent_rank() OVER (ORDER BY yield_pct DESC)) * 100 + (1 - percent_rank() OVER (ORDER BY events DESC)) * 100) / 2 AS score FROM g),
p AS (SELECT code, yield_pct, row_number() OVER (ORDER BY score DESC, yield_pct DESC, events DESC, CAST(code AS VARCHAR)) AS place FROM k)
SELECT 'ranked' AS part, code, place, yield_pct, 'available' AS status FROM p WHERE place BETWEEN 11 AND 30 UNION ALL SELECT 'excluded', code, NULL, NULL, status FROM yl WHERE status <> 'available'"""


def alias_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each user's last kind of event: only changes count."""
    e = b.table(spark, sf_dir, "events")
    out = ledgers.versions(e.select("user_id", "event_id", "event_type"), "user_id", ["event_id"], ["event_type"])
    return out.select("user_id", "event_id", "event_type", F.col("revision").cast("long").alias("revision"), "valid_from", "valid_to")


VERSIONS_SQL = """WITH c AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM c WHERE p IS NULL OR p <> event_type"""


def catalogue_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a declared and a derived list have apart from each other."""
    li, ps = b.table(spark, sf_dir, "lineitem"), b.table(spark, sf_dir, "part")
    declared, derived = ps.select(F.col("p_partkey").alias("k")), li.where("l_discount > 0.09").select(F.col("l_partkey").alias("k"))
    missing = declared.subtract(derived).select(F.lit("missing").alias("side"), "k")
    return missing.union(derived.subtract(declared).select(F.lit("extra").alias("side"), "k"))


COMPLETENESS_SQL = "SELECT 'missing' AS side, k FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) UNION ALL SELECT 'extra', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.09 EXCEPT SELECT p_partkey FROM part)"


def benchmark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of each index by year."""
    return b.benchmark(spark, sf_dir).groupBy("code", F.year("d").cast("long").alias("year")).agg(F.count("*").alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


BENCHMARK_COVERAGE_SQL = f"WITH {BENCH_SQL} SELECT code, year(d) AS year, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM bench GROUP BY ALL"


def shared_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that several part types claim, with the types in order."""
    return ledgers.shared_members(b.table(spark, sf_dir, "part"), "p_type", "p_size")


CLAIMS_SQL = "SELECT p_size, count(DISTINCT p_type) AS groups, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS claimed_by FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1"


QUERIES = {
    "label_proposals": (label_proposals, ""),
    "scheme_distributions": (scheme_distributions, DISTRIBUTIONS_SQL),
    "scheme_categories": (scheme_categories, CATEGORIES_SQL),
    "latest_rolling_by_years": (latest_rolling_by_years, LATEST_ROLLING_SQL),
    "income_screener": (income_screener, INCOME_SCREENER_SQL),
    "alias_versions": (alias_versions, VERSIONS_SQL),
    "catalogue_completeness": (catalogue_completeness, COMPLETENESS_SQL),
    "benchmark_coverage": (benchmark_coverage, BENCHMARK_COVERAGE_SQL),
    "shared_claims": (shared_claims, CLAIMS_SQL),
}
