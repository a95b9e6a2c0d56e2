"""What runs again and again: batches of observations and their statistics, requests to sources, identities of listings, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identities, observations, sync
from ..sources.shared import written
from . import bindings as b

FIRST, LAST = "1995-01-01", "2001-12-31"


def batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Lines in three batches of orders, the last line of each series and day in each: the seventh lines' values are 0, the sixth's no numbers."""
    li = b.table(spark, sf_dir, "lineitem")
    v = F.when(F.col("l_linenumber") == 7, 0.0).when(F.col("l_linenumber") < 6, F.col("l_extendedprice") / F.col("l_quantity"))
    isin = F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit("INF"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 8, "0"), F.when(F.col("l_partkey") % 4 == 1, "x").otherwise("1")))
    rows = li.select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("d"), (F.col("l_orderkey") % 3).alias("batch"), F.struct("l_orderkey", "l_linenumber", "l_partkey", v.alias("v"), isin.alias("isin")).alias("x"))
    last = rows.groupBy("code", "d", "batch").agg(F.max("x").alias("x")).select("code", "d", "batch", "x.v", F.col("x.isin").alias("isin_payout_or_growth"))
    return [last.where(F.col("batch") == i).drop("batch") for i in range(3)]


BATCH_SQL = """lb AS (SELECT code, d, batch, v, isin FROM (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, l_orderkey % 3 AS batch, CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber < 6 THEN l_extendedprice / l_quantity END AS v, CASE WHEN l_partkey % 4 > 0 THEN 'INF' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 8, '0') || CASE WHEN l_partkey % 4 = 1 THEN 'x' ELSE '1' END END AS isin,
  row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE), l_orderkey % 3 ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice / l_quantity DESC) AS k FROM lineitem) WHERE k = 1)"""


def observation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bounds of every series after three batches, each of which changes what the one before has left."""
    current, held = spark.createDataFrame([], observations.CURRENT), spark.createDataFrame([], observations.STATISTICS)
    for batch in batches(spark, sf_dir):
        told = written(observations.publish(current, batch))
        current = written(observations.revised(current, told))
        held = written(observations.statistics_after(held, told, current))
    return held


STATISTICS_SQL = f"""WITH {BATCH_SQL}, c AS (SELECT code, d, v FROM lb WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, d ORDER BY batch DESC) = 1), s AS (SELECT code, min(d) AS first_seen, max(d) AS last_seen FROM lb GROUP BY code),
g AS (SELECT code, count(*) FILTER (WHERE v > 0) AS valid, count(*) FILTER (WHERE v <= 0) AS error, min(d) FILTER (WHERE v > 0) AS first_valid, max(d) FILTER (WHERE v > 0) AS last_valid FROM c GROUP BY code)
SELECT s.code, coalesce(valid, 0) AS valid, coalesce(error, 0) AS error, first_valid, last_valid, first_seen, last_seen FROM s LEFT JOIN g ON g.code = s.code"""


def observation_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the third batch does to the revisions of the first two."""
    one, two, three = batches(spark, sf_dir)
    current = observations.revised(spark.createDataFrame([], observations.CURRENT), observations.publish(spark.createDataFrame([], observations.CURRENT), one))
    current = observations.revised(current, observations.publish(current, two))
    return observations.publish(current, three).select("code", "d", "status", "action", F.col("revision").cast("long").alias("revision"), "was_status")


PUBLICATION_SQL = f"""WITH {BATCH_SQL}, h AS (SELECT code, d, batch, v, v > 0 AS good, lag(v) OVER w AS pv FROM lb WHERE v IS NOT NULL AND batch < 2 WINDOW w AS (PARTITION BY code, d ORDER BY batch)),
c AS (SELECT code, d, arg_max(v, batch) AS v, count(*) FILTER (WHERE pv IS NULL OR pv <> v) AS revision FROM h GROUP BY code, d)
SELECT lb.code, lb.d, CASE WHEN lb.v IS NOT NULL THEN CASE WHEN lb.v > 0 THEN 'valid' ELSE 'error' END END AS status, CASE WHEN lb.v IS NULL THEN 'invalid' WHEN c.v IS NULL THEN 'inserted' WHEN c.v = lb.v THEN 'unchanged' ELSE 'revised' END AS action,
  CASE WHEN lb.v IS NOT NULL THEN coalesce(revision, 0) + CASE WHEN c.v = lb.v THEN 0 ELSE 1 END END AS revision, CASE WHEN c.v > 0 THEN 'valid' WHEN c.v <= 0 THEN 'error' END AS was_status FROM lb LEFT JOIN c ON c.code = lb.code AND c.d = lb.d WHERE batch = 2"""


def observation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all three batches: values and identifiers."""
    none = spark.createDataFrame([], observations.CURRENT)
    every = [observations.issues(observations.publish(none, batch)).withColumn("batch", F.lit(i)) for i, batch in enumerate(batches(spark, sf_dir))]
    return reduce(DataFrame.unionByName, every).select("batch", "code", "d", "issue", "severity")


ISSUES_SQL = f"""WITH {BATCH_SQL} SELECT CAST(batch AS INTEGER) AS batch, code, d, 'INVALID_NAV_VALUE' AS issue, 'error' AS severity FROM lb WHERE v IS NULL UNION ALL SELECT batch, code, d, 'NON_POSITIVE_NAV', 'error' FROM lb WHERE v <= 0
UNION ALL SELECT batch, code, d, 'INVALID_ISIN_PAYOUT_OR_GROWTH', 'warning' FROM lb WHERE NOT regexp_full_match(isin, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]')"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("source"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, finished lines as requests that were answered: from their day on, for as many days as their quantity."""
    d = F.col("l_shipdate").cast("date")
    return b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_linestatus = 'F'").select(
        F.concat(F.lit("f"), "l_suppkey").alias("source"), d.alias("start_day"), F.date_add(d, F.col("l_quantity").cast("int")).alias("end_day"), F.when(F.col("l_linenumber") > 1, d).alias("latest_found")
    )


ANSWERED_SQL = "an AS (SELECT 'f' || l_suppkey AS source, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS e, CASE WHEN l_linenumber > 1 THEN CAST(l_shipdate AS DATE) END AS found FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F')"


def sync_full_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most 90 days over the days that no source has answered for."""
    coverage = sync.covered(spark.createDataFrame([], sync.COVERAGE), answered(spark, sf_dir))
    return sync.requests(sources(spark, sf_dir), coverage, spark.createDataFrame([], sync.CHECKPOINT), "full", FIRST, LAST)


FULL_SQL = f"""WITH {ANSWERED_SQL}, sd AS (SELECT 'f' || s_suppkey AS source, CAST(unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY)) AS DATE) AS d FROM supplier),
cd AS (SELECT DISTINCT source, CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM an), u AS (SELECT sd.source, sd.d FROM sd ANTI JOIN cd ON cd.source = sd.source AND cd.d = sd.d),
i AS (SELECT source, d, d - CAST(row_number() OVER (PARTITION BY source ORDER BY d) AS INTEGER) AS k FROM u)
SELECT source, min(d) AS start_day, max(d) AS end_day FROM (SELECT source, k, d, (d - min(d) OVER (PARTITION BY source, k)) // 90 AS w FROM i) GROUP BY source, k, w"""


def sync_incremental_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows from each checkpoint on, its last seven days again."""
    held = sync.advanced(spark.createDataFrame([], sync.CHECKPOINT), answered(spark, sf_dir).where("source not like '%3'"))
    return sync.requests(sources(spark, sf_dir), spark.createDataFrame([], sync.COVERAGE), held, "incremental", FIRST, LAST)


INCREMENTAL_SQL = f"""WITH {ANSWERED_SQL}, c AS (SELECT source, max(e) AS done FROM an WHERE source NOT LIKE '%3' GROUP BY source), s AS (SELECT 'f' || s_suppkey AS source, greatest(DATE '{FIRST}', c.done - 6) AS lo FROM supplier LEFT JOIN c ON c.source = 'f' || s_suppkey),
d AS (SELECT source, lo, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), TIMESTAMP '{LAST}', INTERVAL 1 DAY)) AS DATE) AS d FROM s) SELECT source, min(d) AS start_day, max(d) AS end_day FROM d GROUP BY source, (d - lo) // 90"""


def sync_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints after requests in two rounds."""
    rows = answered(spark, sf_dir)
    once = sync.advanced(spark.createDataFrame([], sync.CHECKPOINT), rows.where("day(start_day) <= 15"))
    return sync.advanced(once, rows.where("day(start_day) > 15"))


CHECKPOINTS_SQL = f"WITH {ANSWERED_SQL} SELECT source, max(e) AS completed_through, max(found) AS latest_found FROM an GROUP BY source"


def index_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's prices and total returns of each index, asked for by either of its names; what has a checkpoint is skipped."""
    o = b.table(spark, sf_dir, "orders")
    name = F.col("o_orderpriority")
    mappings = o.select(F.concat(F.lit("Index "), name).alias("display_name"), name.alias("trading_name")).distinct()
    wanted = o.select(F.when(F.col("o_orderkey") % 2 == 0, F.upper(F.concat(F.lit(" index "), name))).otherwise(F.lower(name)).alias("name")).distinct()
    year = F.year("o_orderdate")
    done = o.where("o_orderstatus = 'F' and o_orderkey % 40 = o_custkey % 40").select(F.concat_ws("|", name, F.when(F.col("o_orderkey") % 3 == 0, "price").otherwise("total_return")).alias("source"), F.date_add(F.lit(FIRST).cast("date"), ((year - 1995) * 365).cast("int")).alias("start_day"))
    return sync.index_requests(sync.index_names(wanted, mappings), done, "full", FIRST, LAST)


INDEX_SQL = f"""WITH n AS (SELECT DISTINCT o_orderpriority AS name FROM orders), s AS (SELECT name || '|' || kind AS source, DATE '{FIRST}' + CAST(i * 365 AS INTEGER) AS start_day FROM n, (SELECT unnest(['price', 'total_return']) AS kind), (SELECT unnest(range(8)) AS i)),
c AS (SELECT DISTINCT o_orderpriority || '|' || CASE WHEN o_orderkey % 3 = 0 THEN 'price' ELSE 'total_return' END AS source, DATE '{FIRST}' + CAST((year(o_orderdate) - 1995) * 365 AS INTEGER) AS start_day FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 40 = o_custkey % 40)
SELECT s.source, s.start_day, least(s.start_day + 364, DATE '{LAST}') AS end_day, CASE WHEN c.source IS NULL THEN 'pending' ELSE 'skipped' END AS state FROM s LEFT JOIN c ON c.source = s.source AND c.start_day = s.start_day WHERE s.start_day <= DATE '{LAST}'"""


def daily_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each exchange and day, the latest first; what has been answered with rows or as empty is skipped, what was not published is asked for again."""
    o = b.table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderkey") % 5 == 0, "not_published").when(F.col("o_orderkey") % 5 == 1, "transport").when(F.col("o_orderkey") % 5 == 2, "missing").when(F.col("o_orderkey") % 5 == 3, "empty").otherwise("rows")
    answers = o.where("o_orderpriority = '1-URGENT'").select(F.when(F.col("o_custkey") % 2 == 0, "NSE").otherwise("BSE").alias("source"), F.col("o_orderdate").cast("date").alias("start_day"), outcome.alias("outcome")).withColumn("end_day", F.col("start_day"))
    return sync.daily_requests(answers.select("source"), sync.triaged(answers).where("checkpointed"), "full", FIRST, LAST).select("source", "start_day", "state", "place")


DAILY_SQL = f"""WITH a AS (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS source, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 5 >= 3),
p AS (SELECT source, CAST(unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT unnest(['NSE', 'BSE']) AS source))
SELECT p.source, p.d AS start_day, CASE WHEN a.d IS NULL THEN 'pending' ELSE 'skipped' END AS state, CAST(DATE '{LAST}' - p.d AS INTEGER) AS place FROM p LEFT JOIN a ON a.source = p.source AND a.d = p.d"""


def answer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers leave behind: issues by severity, requests that count as done or failed, and checkpoints."""
    o = b.table(spark, sf_dir, "orders")
    names = list(sync.OUTCOMES)
    outcome = F.element_at(F.array(*map(F.lit, names)), (F.col("o_custkey") % len(names) + 1).cast("int"))
    answers = o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("start_day"), F.col("o_orderdate").cast("date").alias("end_day"), outcome.alias("outcome"))
    return sync.triaged(answers).groupBy("source", "issue", "severity").agg(F.count("*").alias("n"), F.count_if("completed").alias("completed"), F.count_if("failed").alias("failed"), F.count_if("checkpointed").alias("checkpoints"))


ANSWERS_SQL = """WITH a AS (SELECT o_orderpriority AS source, o_custkey % 5 AS k FROM orders) SELECT source, CASE k WHEN 1 THEN 'empty_source_period' WHEN 2 THEN 'empty_trading_day' WHEN 3 THEN 'empty_trading_day' WHEN 4 THEN 'download_failure' END AS issue, CASE WHEN k IN (1, 2, 3) THEN 'info' WHEN k = 4 THEN 'error' END AS severity,
  count(*) AS n, count(*) FILTER (WHERE k < 4) AS completed, count(*) FILTER (WHERE k = 4) AS failed, count(*) FILTER (WHERE k < 2) AS checkpoints FROM a GROUP BY ALL"""


def family_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as families of a nation's fund: renamed ones and those with open issues are asked for again."""
    c, o = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "orders")
    key = [F.col("c_nationkey").cast("string").alias("fund"), F.col("c_custkey").cast("string").alias("family")]
    universe = c.select(*key, F.col("c_name").alias("name"))
    held = c.where("c_custkey % 10 > 0").select(*key, F.when(F.col("c_custkey") % 7 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("name"))
    open_ = o.where("o_orderstatus = 'P'").join(c, F.col("o_custkey") == F.col("c_custkey")).select(*key)
    return sync.family_requests(universe, held, open_, "full", retry=True)


FAMILY_SQL = """SELECT CAST(c_nationkey AS VARCHAR) AS fund, CAST(c_custkey AS VARCHAR) AS family, c_name AS name, CASE WHEN c_custkey % 10 = 0 OR (c_custkey % 7 = 0 AND lower(c_name) <> c_name) THEN 'pending' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'retry' ELSE 'skipped' END AS state FROM customer"""

ROSTER_DAY = "1998-06-15"


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as prices of sixty security ids, two thirds without ISIN, some under an ISIN of another."""
    k = F.col("l_partkey") % 60
    isin = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("I"), F.when(F.col("l_partkey") % 11 == 0, (k + 1) % 60).otherwise(k)))
    return b.table(spark, sf_dir, "lineitem").select(F.lit("BSE").alias("exchange"), F.concat(F.lit("S"), k).alias("security_id"), isin.alias("isin"), F.concat(F.lit("SYM"), k).alias("symbol"), F.col("l_linestatus").alias("series"), F.col("l_shipdate").cast("date").alias("d"))


QUOTES_SQL = "qt AS (SELECT l_partkey % 60 AS k, CASE WHEN l_partkey % 3 = 0 THEN CASE WHEN l_partkey % 11 = 0 THEN (l_partkey % 60 + 1) % 60 ELSE l_partkey % 60 END END AS i, l_linestatus AS series, CAST(l_shipdate AS DATE) AS d FROM lineitem)"


def identity_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Instruments, listings and a roster as they stood: parts by their key's remainder."""
    ids = b.table(spark, sf_dir, "part").select((F.col("p_partkey") % 60).alias("id")).distinct()
    text = lambda p: F.concat(F.lit(p), F.col("id"))
    instruments = ids.where("id % 4 = 0").select(F.lit("nse").alias("provider"), F.lit("etf").alias("kind"), text("I").alias("identifier"), text("Old ").alias("name"), F.lit("Gold").alias("family"), text("I").alias("isin"), text("SYM").alias("symbol"), F.lit(None).cast("string").alias("series"))
    listing = lambda p: ids.select(F.lit("BSE").alias("exchange"), text("S").alias("security_id"), text(p).alias("isin"), text("SYM").alias("symbol"), F.lit("A").alias("series"), "id")
    listings = listing("I").where("id % 5 < 2").unionByName(listing("J").where("id % 10 = 1")).drop("id")
    category = F.when(F.col("id") % 2 == 0, F.lit("Equity"))
    roster = ids.where("id % 3 > 0 or id % 2 = 1").select(text("S").alias("security_id"), text("Fund ").alias("name"), category.alias("category"), text("ALIAS").alias("alias"), F.lit(ROSTER_DAY).cast("date").alias("day"))
    return instruments, listings, roster


def listing_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by what has found their instrument and what their identity is worth: official only on the roster's day."""
    instruments, listings, roster = identity_tables(spark, sf_dir)
    told = identities.resolved(quotes(spark, sf_dir), instruments, listings, roster)
    return told.groupBy("security_id", "instrument", "found_by", "identity", "issue").agg(F.count("*").alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


RESOLVED_SQL = f"""{QUOTES_SQL}, rq AS (SELECT *, k % 3 > 0 OR k % 2 = 1 AS listed, CASE WHEN i % 4 = 0 THEN 'isin' WHEN k % 5 < 2 AND k % 10 <> 1 THEN 'listing' WHEN (k % 3 > 0 OR k % 2 = 1) AND i IS NOT NULL THEN 'roster' END AS found_by FROM qt),
rs AS (SELECT *, CASE found_by WHEN 'listing' THEN 'I' || k WHEN 'isin' THEN 'I' || i WHEN 'roster' THEN 'I' || i END AS instrument FROM rq)"""
RESOLUTION_SQL = f"""WITH {RESOLVED_SQL} SELECT 'S' || k AS security_id, instrument, found_by, CASE WHEN found_by IS NULL THEN CASE WHEN listed THEN 'identity_unresolved' END WHEN listed AND d = DATE '{ROSTER_DAY}' THEN 'official' ELSE 'provisional_current_mapping' END AS identity,
  CASE WHEN found_by IS NULL AND listed THEN 'identity_unresolved' END AS issue, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM rs GROUP BY ALL"""


def instrument_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments after a day: made from the roster, named by the listing file, and those of the indices."""
    instruments, listings, roster = identity_tables(spark, sf_dir)
    told = identities.resolved(quotes(spark, sf_dir), instruments, listings, roster)
    after = identities.with_roster(instruments, told, roster)
    p = b.table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 80).alias("id")).agg(F.min(F.struct("p_partkey", "p_name", "p_type", "p_brand")).alias("x")).where("id % 8 = 0").select("id", "x.*")
    after = identities.with_master(after, p.select(F.concat(F.lit("I"), "id").alias("isin"), F.col("p_name").alias("name"), F.col("p_type").alias("underlying"), F.col("p_brand").alias("symbol")))
    indices = b.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("trading_name"), F.initcap("o_orderpriority").alias("display_name")).distinct()
    return identities.with_indices(after, indices)


INSTRUMENT_SQL = f"""WITH {RESOLVED_SQL}, o AS (SELECT DISTINCT p_partkey % 60 AS id FROM part), st AS (SELECT 'nse' AS provider, 'I' || id AS isin, 'I' || id AS identifier, 'Old ' || id AS name, 'Gold' AS family, 'SYM' || id AS symbol, CAST(NULL AS VARCHAR) AS series FROM o WHERE id % 4 = 0),
mk AS (SELECT 'bse' AS provider, 'I' || i AS isin, 'S' || k AS identifier, 'Fund ' || k AS name, CASE WHEN k % 2 = 0 THEN 'BSE Equity ETF' ELSE '{identities.NO_CATEGORY}' END AS family, 'ALIAS' || k AS symbol, series FROM rs WHERE found_by = 'roster' QUALIFY row_number() OVER (PARTITION BY i ORDER BY 'S' || k, d, series) = 1),
al AS (SELECT * FROM st UNION ALL SELECT * FROM mk), ma AS (SELECT 'I' || p_partkey % 80 AS isin, p_name, p_type, p_brand FROM part WHERE p_partkey % 80 % 8 = 0 QUALIFY row_number() OVER (PARTITION BY p_partkey % 80 ORDER BY p_partkey) = 1)
SELECT coalesce(al.provider, 'nse') AS provider, 'etf' AS kind, coalesce(al.identifier, ma.isin) AS identifier, coalesce(p_name, name) AS name, coalesce(p_type, family) AS family, coalesce(al.isin, ma.isin) AS isin, coalesce(p_brand, symbol) AS symbol, series FROM al FULL JOIN ma ON ma.isin = al.isin
UNION ALL SELECT 'nifty_indices', kind, n, initcap_n || suffix, initcap_n, NULL, NULL, NULL FROM (SELECT DISTINCT o_orderpriority AS n, array_to_string(list_transform(string_split(o_orderpriority, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS initcap_n FROM orders), (VALUES ('price_index', ''), ('gross_total_return_index', ' TRI'), ('net_total_return_index', ' NTR')) AS v(kind, suffix)"""


def listing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings after a day, with the identities that a security id had before where the day brought a new one."""
    instruments, listings, roster = identity_tables(spark, sf_dir)
    after = identities.with_prices(listings, identities.resolved(quotes(spark, sf_dir), instruments, listings, roster))
    return after.join(identities.identity_changes(listings, after), ["exchange", "security_id", "isin"], "left").select("security_id", "isin", "symbol", "prior")


LISTING_SQL = f"""WITH {RESOLVED_SQL}, o AS (SELECT DISTINCT p_partkey % 60 AS id FROM part), l AS (SELECT 'S' || id AS security_id, 'I' || id AS isin, 'SYM' || id AS symbol FROM o WHERE id % 5 < 2 UNION ALL SELECT 'S' || id, 'J' || id, 'SYM' || id FROM o WHERE id % 10 = 1),
n AS (SELECT DISTINCT 'S' || k AS security_id, instrument AS isin, 'SYM' || k AS symbol FROM rs WHERE instrument IS NOT NULL AND i IS NOT NULL), p AS (SELECT security_id, string_agg(isin, '|' ORDER BY isin) AS prior FROM l GROUP BY security_id)
SELECT security_id, isin, symbol, CAST(NULL AS VARCHAR) AS prior FROM l UNION ALL SELECT n.security_id, n.isin, n.symbol, p.prior FROM n ANTI JOIN l ON l.security_id = n.security_id AND l.isin = n.isin LEFT JOIN p ON p.security_id = n.security_id"""

QUERIES = {
    "observation_statistics": (observation_statistics, STATISTICS_SQL),
    "observation_publication": (observation_publication, PUBLICATION_SQL),
    "observation_issues": (observation_issues, ISSUES_SQL),
    "sync_full_requests": (sync_full_requests, FULL_SQL),
    "sync_incremental_requests": (sync_incremental_requests, INCREMENTAL_SQL),
    "sync_checkpoints": (sync_checkpoints, CHECKPOINTS_SQL),
    "index_requests": (index_requests, INDEX_SQL),
    "daily_requests": (daily_requests, DAILY_SQL),
    "answer_issues": (answer_issues, ANSWERS_SQL),
    "family_requests": (family_requests, FAMILY_SQL),
    "listing_resolution": (listing_resolution, RESOLUTION_SQL),
    "instrument_table": (instrument_table, INSTRUMENT_SQL),
    "listing_table": (listing_table, LISTING_SQL),
}
