"""Queries over catalogues, coverage, identity, quality and merges, with their SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, names, text
from ..operators import classification, intervals, payouts, revisions, series
from . import bindings as b
from .bindings import AS_OF, MEMBER_SQL, NAV_SQL, PAYOUT_SQL
from .series_queries import FREQUENCY_SQL, endpoints_sql, rolling_sql, rounded, sql_round


def scheme_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series with its names, first and last day and last value, also when that one is not valid."""
    last = b.nav(spark, sf_dir).groupBy("code").agg(F.min("d").alias("first_day"), F.max(F.struct("d", "v")).alias("x"))
    return rounded(b.members(spark, sf_dir).join(last, "code").select("code", "name", "house", "class", "product", "first_day", F.col("x.d").alias("last_day"), F.col("x.v").alias("last_value")), 8)


SNAPSHOT_SQL = f"WITH {NAV_SQL}, {MEMBER_SQL} SELECT mem.code, name, house, class, product, min(d) AS first_day, max(d) AS last_day, round(max_by(v, d), 8) AS last_value FROM mem JOIN nav USING (code) GROUP BY ALL"


def scheme_browser(spark: SparkSession, sf_dir: str, term: str = "00000002", size: int = 25, offset: int = 0) -> DataFrame:
    """A page of the series whose name or code contains a term in any case, with the total beside it."""
    m = b.members(spark, sf_dir)
    found = m.where(F.lower("name").contains(term.lower()) | F.col("code").cast("string").contains(term))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.lower("name"), "code").offset(offset).limit(size).join(F.broadcast(total)).select("code", "name", "house", "class", "total")  # one row of totals


BROWSER_SQL = f"WITH {MEMBER_SQL}, f AS (SELECT * FROM mem WHERE contains(lower(name), '00000002') OR contains(CAST(code AS VARCHAR), '00000002')) SELECT code, name, house, class, (SELECT count(*) FROM f) AS total FROM f ORDER BY lower(name), code LIMIT 25"


def classification_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with products and counts in display order; members without a class drop out."""
    m = b.members(spark, sf_dir).where("class is not null")
    order = F.when(F.col("product") == "mutual_fund", 1).otherwise(2)
    return m.groupBy("class", "product").agg(F.count("*").alias("n"), F.count_distinct("house").alias("houses")).withColumn("display", order.cast("long"))


FACETS_SQL = f"WITH {MEMBER_SQL} SELECT class, product, count(*) AS n, count(DISTINCT house) AS houses, CAST(CASE WHEN product = 'mutual_fund' THEN 1 ELSE 2 END AS BIGINT) AS display FROM mem WHERE class IS NOT NULL GROUP BY ALL"


def fund_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every house with its number of series, its last checkpoint, and whether it is fully covered; houses without any too."""
    houses = b.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("house"))
    counts = b.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("series"))
    c = b.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"))
    checkpoints = c.agg(F.max("c_custkey").alias("checkpoint"), F.count_if(F.col("c_acctbal") < 0).alias("open_items"))
    covered = checkpoints.where("open_items = 0").select("n_nationkey", F.lit(True).alias("covered"))
    out = houses.join(counts, "n_nationkey", "left").join(checkpoints.drop("open_items"), "n_nationkey", "left").join(covered, "n_nationkey", "left")
    return out.select("house", F.coalesce("series", F.lit(0)).alias("series"), "checkpoint", F.col("covered").isNotNull().alias("fully_covered"))


HOUSES_SQL = """WITH c AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), p AS (SELECT c_nationkey AS k, max(c_custkey) AS checkpoint, count(*) FILTER (WHERE c_acctbal < 0) AS o FROM customer GROUP BY 1)
SELECT n_name AS house, coalesce(n, 0) AS series, checkpoint, coalesce(o = 0, false) AS fully_covered FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN p ON p.k = n_nationkey"""


def classifications_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with candidates and series that have both points of a 1y return; classes without any drop out."""
    ok = series.endpoints(b.nav(spark, sf_dir), AS_OF, "1y").where("status = 'available'").select("code", F.lit(1).alias("ok"))
    counts = b.members(spark, sf_dir).join(ok, "code", "left").groupBy("class").agg(F.count("*").alias("candidates"), F.count("ok").alias("eligible"))
    return counts.where("eligible > 0").withColumn("excluded", F.col("candidates") - F.col("eligible"))


ELIGIBLE_SQL = f"WITH {NAV_SQL}, {MEMBER_SQL}, {endpoints_sql('nav', 12)}, c AS (SELECT class, count(*) AS candidates, count(*) FILTER (WHERE status = 'available') AS eligible FROM mem LEFT JOIN ep2 USING (code) GROUP BY class) SELECT *, candidates - eligible AS excluded FROM c WHERE eligible > 0"


def data_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bounds of the store in one row."""
    obs = b.observations(spark, sf_dir)
    return obs.agg(F.count("*").alias("revisions"), F.count_distinct("code", "d").alias("current"), F.count_distinct("code").alias("series"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count_if(F.col("v") <= 0).alias("not_positive"))


COVERAGE_SQL = f"WITH {NAV_SQL} SELECT (SELECT count(*) FROM obs) AS revisions, count(*) AS current, count(DISTINCT code) AS series, min(d) AS first_day, max(d) AS last_day, (SELECT count(*) FROM obs WHERE v <= 0) AS not_positive FROM nav"


def coverage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring days with events of each user."""
    days = b.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("first_day"), F.col("ts").cast("date").alias("last_day")).distinct()
    return intervals.islands(days, "user_id", "first_day", "last_day")


ISLANDS_SQL = """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), g AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS k FROM d)
SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS parts FROM g GROUP BY user_id, k"""


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without events between two runs of a user."""
    return intervals.uncovered(coverage_islands(spark, sf_dir), "user_id", "first_day", "last_day")


COVERAGE_GAPS_SQL = """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), n AS (SELECT user_id, d, lead(d) OVER (PARTITION BY user_id ORDER BY d) AS nx FROM d)
SELECT user_id, d + 1 AS gap_start, nx - 1 AS gap_end FROM n WHERE nx > d + 1"""


def quality_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by type: distinct observations, occurrences, series and days."""
    e = b.table(spark, sf_dir, "events").select("event_type", "user_id", F.col("ts").cast("date").alias("d"))
    return revisions.quality_counts(e, ["event_type"], ["user_id", "d"], "user_id", "d")


QUALITY_SQL = """WITH o AS (SELECT event_type, user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, count(*) AS observations, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT user_id) AS schemes, min(d) AS first_day, max(d) AS last_day FROM o GROUP BY event_type"""


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and weekday half, with conditional sums."""
    e = b.table(spark, sf_dir, "events")
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.sum(F.when(F.col("value") <= 50, F.col("value"))).alias("low_sum"), F.max("value").alias("most")), 4)


ISSUES_SQL = "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, round(sum(value) FILTER (WHERE value <= 50), 4) AS low_sum, round(max(value), 4) AS most FROM events GROUP BY 1"


def left_anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers none of whose orders is pending."""
    c, o = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


ANTI_SQL = "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"


def semi_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with any returned line."""
    s, li = b.table(spark, sf_dir, "supplier"), b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return s.join(li, s["s_suppkey"] == li["l_suppkey"], "left_semi").select("s_suppkey", "s_name")


SEMI_SQL = "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')"


def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, by time and id."""
    e = b.table(spark, sf_dir, "events")
    return rounded(e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x")).select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("event_type"), F.col("x.value").alias("value")), 4)


LATEST_SQL = "SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (code, day) pairs that any of three kinds of sources name."""
    obs = b.observations(spark, sf_dir)
    parts = [obs.where(c).select("code", "d") for c in ("l_returnflag = 'R'", "l_returnflag = 'A'", "l_discount > 0.05")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


UNION_SQL = f"WITH {NAV_SQL} SELECT code, d FROM obs WHERE l_returnflag = 'R' UNION SELECT code, d FROM obs WHERE l_returnflag = 'A' UNION SELECT code, d FROM obs WHERE l_discount > 0.05"


def multi_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bounds of each series over three sources, added up."""
    obs = b.observations(spark, sf_dir)
    return revisions.merged_coverage(*[obs.where(F.col("l_returnflag") == f) for f in ("R", "A", "N")])


MULTI_SQL = f"WITH {NAV_SQL} SELECT code, count(*) AS n, min(d) AS first_day, max(d) AS last_day, count(DISTINCT l_returnflag) AS sources FROM obs GROUP BY code"


def gate_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels dealt into gates that leave none out, with their total beside each."""
    p = b.table(spark, sf_dir, "part")
    gate = F.when(F.col("p_type").rlike("(?i)promo"), "promo").when(F.col("p_type").rlike("(?i)(brass|copper)$"), "base_metal").when(F.col("p_size") > 25, "large").otherwise("rest")
    counts = p.select(gate.alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy()))  # four rows


GATE_SQL = "WITH g AS (SELECT CASE WHEN regexp_matches(p_type, '(?i)promo') THEN 'promo' WHEN regexp_matches(p_type, '(?i)(brass|copper)$') THEN 'base_metal' WHEN p_size > 25 THEN 'large' ELSE 'rest' END AS gate FROM part) SELECT gate, count(*) AS n, (SELECT count(*) FROM g) AS total FROM g GROUP BY gate"


def similarity_jaccard(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Pairs of distinct part names by the Jaccard similarity of their words, through shared words."""
    types = b.table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct().withColumn("t", text.tokens(F.col("label")))
    words = types.select("label", F.size("t").alias("n"), F.explode("t").alias("w"))
    left, right = words.select(F.col("label").alias("a"), F.col("n").alias("na"), "w"), words.select(F.col("label").alias("b"), F.col("n").alias("nb"), "w")
    pairs = left.join(right, "w").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("same"))
    score = F.round(F.col("same") / (F.col("na") + F.col("nb") - F.col("same")), 6)
    return pairs.select("a", "b", score.alias("score")).where(F.col("score") >= threshold)


JACCARD_SQL = """WITH t AS (SELECT DISTINCT p_name AS label FROM part), w AS (SELECT label, list_distinct(list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM t),
p AS (SELECT a.label AS a, b.label AS b, len(list_intersect(a.t, b.t)) AS same, len(a.t) AS na, len(b.t) AS nb FROM w a JOIN w b ON a.label < b.label)
SELECT a, b, round(same / (na + nb - same), 6) AS score FROM p WHERE round(same / (na + nb - same), 6) >= 0.3"""


# classification labels of the sample, around a part's name, by turns
LABELS = ["Open Ended Schemes(Equity Schemes - Midcap {})", " open ended Schemes ( Equity Scheme -  Large and  mid cap {} )", "Close Ended Schemes ( Debt Scheme - {} Index Fund )", "Interval Fund Schemes( Other ETF {} )", "Hybrid schemes - {} (Growth)", "Open Ended Schemes ( Other Scheme - Gold ETF )"]


def classification_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part")
    form = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select(F.replace(form, F.lit("{}"), F.col("p_name")).alias("label"))


def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw classification label with its identifier, canonical form, kind of match, structure, product and short name."""
    found = classification.labelled(classification_labels(spark, sf_dir))
    return found.withColumn("short", names.short_name(F.col("shown")))


LABELLED_SQL = f"""l AS (SELECT DISTINCT replace({LABELS}[p_partkey % 6 + 1], '{{}}', p_name) AS label FROM part), w AS (SELECT label, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS t FROM l),
x AS (SELECT label, trim(regexp_replace(regexp_replace(regexp_replace(t, '\\s*\\(\\s*', ' ( ', 'g'), '\\s*\\)\\s*', ' )', 'g'), '\\s+', ' ', 'g')) AS t FROM w),
c AS (SELECT label, regexp_replace(regexp_replace(regexp_replace(t, '(?i)\\b(Equity|Hybrid) Schemes(\\s*-)', '\\1 Scheme\\2', 'g'), '(?i)\\bMidcap\\b', 'Mid Cap', 'g'), '(?i)\\bLarge\\s+and\\s+Mid\\s+Cap\\b', 'Large & Mid Cap', 'g') AS shown FROM x),
k AS (SELECT label, shown, lower(shown) AS key FROM c),
d AS (SELECT label, 'amfi-' || substr(sha256(key), 1, 32) AS classification, shown,
  CASE WHEN label = shown THEN 'exact' WHEN regexp_matches(lower(label) || '#' || key, 'equity schemes -|hybrid schemes -|midcap| large and mid cap') THEN 'terminology' ELSE 'formatting' END AS "match",
  CASE WHEN starts_with(key, 'open ended schemes') THEN 'open_ended' WHEN starts_with(key, 'close ended schemes') THEN 'close_ended' WHEN starts_with(key, 'interval fund schemes') THEN 'interval' ELSE 'other' END AS structure,
  CASE WHEN regexp_matches(key, 'exchange traded fund|gold etf|other  ?etf') THEN 'etf' WHEN contains(key, 'index fund') THEN 'index_fund' ELSE 'mutual_fund' END AS product FROM k)"""
SHORT_SQL = """CASE WHEN regexp_matches(shown, '^(?i)(open ended schemes|close ended schemes|interval fund schemes)\\s*\\(.*\\)$') THEN trim(regexp_extract(shown, '\\((.*)\\)$', 1)) ELSE shown END"""
LABEL_SQL = f"""WITH {LABELLED_SQL}, i AS (SELECT *, {SHORT_SQL} AS inn FROM d),
j AS (SELECT *, regexp_replace(inn, '^.*?\\)\\s*-\\s*', '') AS r FROM i)
SELECT label, classification, shown, "match", structure, product, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(lower(inn), '^(debt scheme|equity scheme|hybrid scheme|other scheme)') THEN CASE WHEN r <> inn THEN r ELSE regexp_replace(inn, '^[^-]+\\s+-\\s+', '') END ELSE inn END, '\\s*\\(\\s*', ' (', 'g'), '\\s*\\)\\s*', ')', 'g'), '\\s+', ' ', 'g')) AS short FROM j"""


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels by kind of match, structure and product, with the classifications that they make."""
    found = classification.labelled(classification_labels(spark, sf_dir))
    return found.groupBy("match", "structure", "product").agg(F.count("*").alias("labels"), F.count_distinct("classification").alias("classifications"))


CLASSES_SQL = f'WITH {LABELLED_SQL} SELECT "match", structure, product, count(*) AS labels, count(DISTINCT classification) AS classifications FROM d GROUP BY ALL'


def plan_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan and option of names with stated qualifiers beside some of them."""
    p = b.table(spark, sf_dir, "part")
    tail = F.element_at(F.array(*map(F.lit, [" - Direct Plan-Growth", " Regular  IDCW", "-DIRECT-Dividend payout", " Bonus", " Growth Dividend", ""])), (F.col("p_partkey") % 6 + 1).cast("int"))
    plan = F.when(F.col("p_partkey") % 5 == 0, "Regular Plan").when(F.col("p_partkey") % 5 == 1, "Institutional")
    option = F.when(F.col("p_partkey") % 7 == 0, "IDCW-Re-investment").when(F.col("p_partkey") % 7 == 1, "Income Distribution cum").when(F.col("p_partkey") % 7 == 2, "Other")
    return p.select("p_partkey", text.plan_and_option(F.concat("p_name", tail), plan, option).alias("x")).select("p_partkey", "x.*")


PLAN_SQL = """WITH n AS (SELECT p_partkey, replace(lower(p_name || [' - Direct Plan-Growth', ' Regular  IDCW', '-DIRECT-Dividend payout', ' Bonus', ' Growth Dividend', ''][p_partkey % 6 + 1]), '-', ' ') AS w, p_partkey % 5 AS a, p_partkey % 7 AS o FROM part)
SELECT p_partkey, CASE a WHEN 0 THEN 'regular' WHEN 1 THEN 'unknown' ELSE CASE WHEN regexp_matches(w, '\\bdirect\\b') THEN 'direct' WHEN regexp_matches(w, '\\bregular\\b') THEN 'regular' ELSE 'unknown' END END AS plan,
  CASE o WHEN 0 THEN 'idcw' WHEN 1 THEN 'idcw' WHEN 2 THEN 'unknown' ELSE CASE WHEN regexp_matches(w, '\\b(idcw|dividend)\\b') THEN 'idcw' WHEN regexp_matches(w, '\\bgrowth\\b') THEN 'growth' WHEN regexp_matches(w, '\\bbonus\\b') THEN 'bonus' ELSE 'unknown' END END AS option,
  'amfi_plan_' || CASE WHEN a < 2 THEN 'explicit' ELSE 'name_heuristic' END || '_option_' || CASE WHEN o < 3 THEN 'explicit' ELSE 'name_heuristic' END || '_v1' AS method FROM n"""


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed field from a JSON column, with rows whose keys are not those expected told apart."""
    e = b.table(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    good = keys.isNotNull() & (keys == F.array(F.lit("k")))
    return e.groupBy(F.when(good, "valid").otherwise("drifted").alias("state")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total"))


JSON_SQL = "SELECT CASE WHEN json_keys(props) = ['k'] THEN 'valid' ELSE 'drifted' END AS state, count(*) AS n, CAST(sum(TRY_CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1"


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title and the numbers of links and paragraphs of each page."""
    p = b.table(spark, sf_dir, "pages")
    count = lambda tag: F.size(F.split("html", tag)) - 1
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count("<a ").cast("long").alias("links"), count("<p>").cast("long").alias("paragraphs"))


TITLES_SQL = "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(string_split(html, '<a ')) - 1 AS links, len(string_split(html, '<p>')) - 1 AS paragraphs FROM pages"


def revision_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature of each series' metadata, over its values in order."""
    m = b.members(spark, sf_dir)
    return m.select("code", text.row_hash(F.col("code"), F.col("name"), F.col("house"), F.col("class")).alias("signature"))


HASH_SQL = f"WITH {MEMBER_SQL} SELECT code, sha256(concat_ws(chr(31), CAST(code AS VARCHAR), name, house, class)) AS signature FROM mem"


def nav_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later batch does to the current values: inserted, revised, unchanged, quarantined or absent."""
    obs = b.observations(spark, sf_dir)
    old = series.current(obs.where("l_linestatus = 'F'"), ["code", "d"], ["seq1", "seq2"], ["v"])
    new = series.current(obs.where("l_linestatus = 'O'").withColumn("v", F.when(F.col("l_discount") > 0.08, -F.col("v")).otherwise(F.col("v"))), ["code", "d"], ["seq1", "seq2"], ["v"])
    return rounded(revisions.merge_actions(old, new, ["code", "d"], "v"), 8)


MERGE_SQL = f"""WITH {NAV_SQL}, o AS (SELECT code, d, v FROM (SELECT *, row_number() OVER (PARTITION BY code, d ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM obs WHERE l_linestatus = 'F') WHERE rn = 1),
n AS (SELECT code, d, CASE WHEN l_discount > 0.08 THEN -v ELSE v END AS v FROM (SELECT *, row_number() OVER (PARTITION BY code, d ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM obs WHERE l_linestatus = 'O') WHERE rn = 1)
SELECT coalesce(o.code, n.code) AS code, coalesce(o.d, n.d) AS d, round(o.v, 8) AS old, round(n.v, 8) AS new,
  CASE WHEN n.code IS NULL THEN 'absent' WHEN n.v IS NULL OR n.v <= 0 THEN 'quarantined' WHEN o.code IS NULL THEN 'inserted' WHEN o.v = n.v THEN 'unchanged' ELSE 'revised' END AS action FROM o FULL JOIN n ON o.code = n.code AND o.d = n.d"""


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two order years: added, removed, with another segment of orders, or the same."""
    o = b.table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus")
    at = lambda y: o.where(F.col("y") == y).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("status"))
    return revisions.snapshot_diff(at(1996), at(1997), "o_custkey", ["status"])


CHANGES_SQL = """WITH a AS (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.s IS NOT DISTINCT FROM b.s THEN 'same' ELSE 'renamed' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey"""


def source_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest authority that ever named each payout day, and how many sources did."""
    source = F.when(F.col("l_returnflag") == "R", "regulator").when(F.col("l_returnflag") == "A", "registrar").otherwise("third_party")
    rows = b.observations(spark, sf_dir).withColumn("source", source).withColumn("tier", revisions.tier_of("source"))
    return rows.groupBy("code", "d").agg(F.min("tier").cast("long").alias("tier"), F.count_distinct("source").alias("sources"))


TIERS_SQL = f"WITH {NAV_SQL} SELECT code, d, CAST(min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS BIGINT) AS tier, count(DISTINCT l_returnflag) AS sources FROM obs GROUP BY ALL"


def ordered_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every payout day keeps after its rows, in order of arrival, are reconciled by tier."""
    source = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    rows = b.observations(spark, sf_dir).select("code", "d", (F.floor(F.col("v") * F.col("l_discount") * 100 + 0.5) / 100).alias("amount"), source.alias("tier"), (F.col("seq1") * 8 + F.col("seq2")).alias("seq"))
    return revisions.reconcile(rows)


RECONCILIATION_SQL = f"""WITH {NAV_SQL}, r AS (SELECT code, d, floor(v * l_discount * 100 + 0.5) / 100 AS amount, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS tier, l_orderkey * 8 + l_linenumber AS seq FROM obs),
f AS (SELECT *, min(seq) FILTER (WHERE tier = 1) OVER e AS s1, min(seq) FILTER (WHERE tier = 2) OVER e AS s2, min(seq) FILTER (WHERE tier = 3) OVER e AS s3 FROM r WINDOW e AS (PARTITION BY code, d)),
t AS (SELECT code, d, tier, min_by(amount, seq) AS a, min(seq) AS s, bool_or(amount <> first) AS clash FROM (SELECT *, first_value(amount) OVER (PARTITION BY code, d, tier ORDER BY seq) AS first FROM f WHERE seq < coalesce(CASE WHEN tier > 1 THEN s1 END, 9e18) AND seq < coalesce(CASE WHEN tier > 2 THEN s2 END, 9e18)) GROUP BY ALL),
n AS (SELECT *, lag(a) OVER (PARTITION BY code, d ORDER BY s) AS pa, lag(clash) OVER (PARTITION BY code, d ORDER BY s) AS pc FROM t),
g AS (SELECT code, d, CAST(count(*) FILTER (WHERE pa IS NULL OR pc OR pa <> a) AS INT) AS revision, max_by(a, s) AS a, max_by(tier, s) AS tier, max_by(clash, s) AS clash FROM n GROUP BY ALL)
SELECT g.code, g.d, CASE WHEN NOT clash THEN a END AS amount, tier, revision, CASE WHEN clash THEN 'conflict' ELSE 'current' END AS state, (SELECT count(*) FROM r WHERE r.code = g.code AND r.d = g.d) AS events FROM g"""


def identity_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by exact (day, value) evidence: mapped, ambiguous or unresolved."""
    nav = b.nav(spark, sf_dir)
    left = nav.select((F.col("code") + 1000).alias("candidate"), "code", "d", F.when((F.col("code") % 5 == 0) & (F.dayofmonth("d") == 1), F.col("v") + 1).otherwise(F.col("v")).alias("value"))
    return revisions.mapping_state(revisions.identity_evidence(left, nav))


IDENTITY_SQL = f"""WITH {NAV_SQL}, c AS (SELECT code + 1000 AS candidate, code, d, CASE WHEN code % 5 = 0 AND day(d) = 1 THEN v + 1 ELSE v END AS value FROM nav),
e AS (SELECT candidate, c.code, count(*) FILTER (WHERE value = v) AS m, count(*) FILTER (WHERE value <> v) AS x, date_diff('day', min(c.d) FILTER (WHERE value = v), max(c.d) FILTER (WHERE value = v)) AS span FROM c JOIN nav ON nav.code = c.code AND nav.d = c.d GROUP BY ALL),
q AS (SELECT *, m >= 3 AND x = 0 AND coalesce(span, 0) >= 30 AS ok FROM e)
SELECT candidate, count(*) FILTER (WHERE ok) AS qualified, CASE WHEN count(*) FILTER (WHERE ok) = 1 THEN 'mapped' WHEN count(*) FILTER (WHERE ok) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state, CASE WHEN count(*) FILTER (WHERE ok) = 1 THEN max(code) FILTER (WHERE ok) END AS code FROM q GROUP BY candidate"""


def backlog_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten users with most failed events."""
    e = b.table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


BACKLOG_SQL = "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10"


def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority with a column for each status."""
    o = b.table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


PROVIDER_SQL = "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1"


def return_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, gross and net observations of each order as rows; a missing one gives none."""
    li = b.table(spark, sf_dir, "lineitem")
    wide = li.select("l_orderkey", "l_linenumber", sql_round(F.col("l_extendedprice"), 2).alias("price"), sql_round(F.col("l_extendedprice") * (1 + F.col("l_tax")), 2).alias("gross"), F.when(F.col("l_discount") > 0, sql_round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)).alias("net"))
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["price", "gross", "net"], "basis", "value").where("value is not null").groupBy("l_orderkey", "basis").agg(F.count("*").alias("n"), sql_round(F.max("value"), 2).alias("most"))


BASES_SQL = """WITH w AS (SELECT l_orderkey, round(l_extendedprice, 2) AS price, round(l_extendedprice * (1 + l_tax), 2) AS gross, CASE WHEN l_discount > 0 THEN round(l_extendedprice * (1 - l_discount), 2) END AS net FROM lineitem),
u AS (SELECT l_orderkey, 'price' AS basis, price AS value FROM w UNION ALL SELECT l_orderkey, 'gross', gross FROM w UNION ALL SELECT l_orderkey, 'net', net FROM w) SELECT l_orderkey, basis, count(*) AS n, round(max(value), 2) AS most FROM u WHERE value IS NOT NULL GROUP BY ALL"""


def lifecycle_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose parts state more than one size, with the sizes in order."""
    p = b.table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.count_distinct("p_size").alias("sizes"), F.array_join(F.sort_array(F.collect_set("p_size").cast("array<int>")).cast("array<string>"), "|").alias("listed")).where("sizes > 1")


LIFECYCLE_SQL = "SELECT p_brand, count(DISTINCT p_size) AS sizes, array_to_string(list_sort(list_distinct(list(p_size))), '|') AS listed FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1"


def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90-day request windows that cover each series' days."""
    span = b.nav(spark, sf_dir).groupBy("code").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return span.select("code", F.explode(calendar.fixed_windows(F.col("lo"), F.col("hi"), 90)).alias("w")).select("code", "w.*")


WINDOWS_SQL = f"""WITH {NAV_SQL}, s AS (SELECT code, min(d) AS lo, max(d) AS hi FROM nav GROUP BY code), w AS (SELECT code, hi, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 90 DAY)) AS DATE) AS window_start FROM s)
SELECT code, window_start, least(window_start + 89, hi) AS window_end FROM w"""


def income_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row for each series: yields at five cut-offs, cadence and rolling medians, as text for a spreadsheet."""
    nav, pay, m = b.nav(spark, sf_dir), b.payouts(spark, sf_dir), b.members(spark, sf_dir)
    cuts = spark.range(1).select(F.posexplode(calendar.yearly_cutoffs(AS_OF)).alias("i", "cut"))
    inside = pay.join(F.broadcast(cuts), (F.col("d") > F.add_months("cut", -12)) & (F.col("d") <= F.col("cut")))  # five rows
    paid = inside.groupBy("code").pivot("i", [0, 1, 2, 3, 4]).agg(F.sum("amount")).select("code", *[F.col(str(i)).alias(f"p{i}") for i in range(5)])
    day = lambda i: F.add_months(calendar.date(AS_OF), -12 * (4 - i))
    ends = nav.groupBy("code").agg(*[F.max(F.when(F.col("d").between(F.date_sub(day(i), 7), day(i)), F.struct("d", "v"))).alias(f"e{i}") for i in range(5)])
    wide = paid.join(ends, "code", "full")
    yields = wide.select("code", *[text.trimmed_number(F.round(F.coalesce(F.col(f"p{i}"), F.lit(0.0)) / F.col(f"e{i}.v") * 100, 6)).alias(f"yield_{i}") for i in range(5)])
    roll = series.rolling_years(nav, (1, 3, 5), month_ends=True).groupBy("code").pivot("years", [1, 3, 5]).agg(F.median("r"))
    medians = roll.select("code", *[text.trimmed_number(F.round(str(y), 6)).alias(f"median_{y}y") for y in (1, 3, 5)])
    start = (date.fromisoformat(AS_OF).replace(day=1) - timedelta(days=365 * 5 - 31)).replace(day=1).isoformat()
    kind = payouts.payout_frequency(pay, m.select("code", "name"), start, AS_OF).select("code", "frequency", "basis", F.array_join(F.transform("blocks", lambda x: x.cast("string")), "|").alias("blocks"))
    out = m.join(yields, "code", "left").join(medians, "code", "left").join(kind, "code", "left")
    return out.select("code", text.safe_cell(F.concat(F.lit("="), F.col("name"))).alias("name"), "house", *[f"yield_{i}" for i in range(5)], *[f"median_{y}y" for y in (1, 3, 5)], "frequency", "basis", "blocks")


def trimmed_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.6f', round({x}, 6)), '0+$', ''), '\\.$', '')"


EXPORT_SQL = f"""WITH {NAV_SQL}, {PAYOUT_SQL}, {MEMBER_SQL}, cu AS (SELECT i, (DATE '{AS_OF}' - to_years(4 - i))::DATE AS cut FROM (SELECT CAST(unnest(range(5)) AS INT) AS i)),
py AS (SELECT code, i, sum(amount) AS p FROM pay JOIN cu ON d > (cut - INTERVAL 1 YEAR)::DATE AND d <= cut GROUP BY ALL), nv AS (SELECT code, i, max_by(v, d) AS v FROM nav JOIN cu ON d BETWEEN cut - 7 AND cut GROUP BY ALL),
yl AS (SELECT nv.code, nv.i, {trimmed_sql("coalesce(p, 0) / v * 100")} AS y FROM nv LEFT JOIN py ON py.code = nv.code AND py.i = nv.i),
{", ".join(rolling_sql(y, True, str(y)) for y in (1, 3, 5))},
md AS (SELECT code, 1 AS y, median(r) AS m FROM roll1 GROUP BY 1 UNION ALL SELECT code, 3, median(r) FROM roll3 GROUP BY 1 UNION ALL SELECT code, 5, median(r) FROM roll5 GROUP BY 1), {FREQUENCY_SQL}
SELECT mem.code, '''' || '=' || mem.name AS name, house, {", ".join(f"(SELECT y FROM yl WHERE yl.code = mem.code AND i = {i}) AS yield_{i}" for i in range(5))}, {", ".join(f"(SELECT {trimmed_sql('m')} FROM md WHERE md.code = mem.code AND y = {y}) AS median_{y}y" for y in (1, 3, 5))},
  fq.frequency, fq.basis, fq.blocks FROM mem JOIN fq ON fq.code = mem.code"""


QUERIES = {
    "scheme_snapshot": (scheme_snapshot, SNAPSHOT_SQL),
    "scheme_browser": (scheme_browser, BROWSER_SQL),
    "classification_facets": (classification_facets, FACETS_SQL),
    "fund_houses": (fund_houses, HOUSES_SQL),
    "classifications_eligible": (classifications_eligible, ELIGIBLE_SQL),
    "data_coverage": (data_coverage, COVERAGE_SQL),
    "coverage_islands": (coverage_islands, ISLANDS_SQL),
    "coverage_gaps": (coverage_gaps, COVERAGE_GAPS_SQL),
    "quality_two_level": (quality_two_level, QUALITY_SQL),
    "issue_counts": (issue_counts, ISSUES_SQL),
    "left_anti_unmatched": (left_anti_unmatched, ANTI_SQL),
    "semi_members": (semi_members, SEMI_SQL),
    "latest_review": (latest_review, LATEST_SQL),
    "source_union": (source_union, UNION_SQL),
    "multi_source_coverage": (multi_source_coverage, MULTI_SQL),
    "gate_partition": (gate_partition, GATE_SQL),
    "similarity_jaccard": (similarity_jaccard, JACCARD_SQL),
    "label_rules": (label_rules, LABEL_SQL),
    "json_props": (json_props, JSON_SQL),
    "page_titles": (page_titles, TITLES_SQL),
    "revision_hashes": (revision_hashes, HASH_SQL),
    "nav_merge": (nav_merge, MERGE_SQL),
    "snapshot_changes": (snapshot_changes, CHANGES_SQL),
    "source_tiers": (source_tiers, TIERS_SQL),
    "ordered_reconciliation": (ordered_reconciliation, RECONCILIATION_SQL),
    "classification_report": (classification_report, CLASSES_SQL),
    "plan_options": (plan_options, PLAN_SQL),
    "identity_mapping": (identity_mapping, IDENTITY_SQL),
    "backlog_top": (backlog_top, BACKLOG_SQL),
    "provider_summary": (provider_summary, PROVIDER_SQL),
    "return_bases": (return_bases, BASES_SQL),
    "lifecycle_conflicts": (lifecycle_conflicts, LIFECYCLE_SQL),
    "request_windows": (request_windows, WINDOWS_SQL),
    "income_export": (income_export, EXPORT_SQL),
}
