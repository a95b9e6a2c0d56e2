"""State over time: families from snapshot to snapshot, aliases and who holds what, repaired revisions, events with all their provenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aliases, lifecycle, provenance, publication, repairs
from . import bindings as b
from . import publication_queries as p

# families and launches


def memberships(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers with orders in a year as families of their nation's fund in that year's snapshot, under the last of their statuses; and the snapshots."""
    o, c = b.table(spark, sf_dir, "orders"), b.table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("fund"), F.year("o_orderdate").alias("snapshot"), F.col("c_custkey").alias("family")).agg(F.max("o_orderstatus").alias("name"))
    return rows, rows.select("fund", "snapshot").distinct()


MEMBER_SQL = """ms AS (SELECT c_nationkey AS fund, year(o_orderdate) AS snapshot, c_custkey AS family, max(o_orderstatus) AS name FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
pl AS (SELECT fund, snapshot, row_number() OVER (PARTITION BY fund ORDER BY snapshot) AS place, count(*) OVER (PARTITION BY fund) AS last FROM (SELECT DISTINCT fund, snapshot FROM ms)),
mp AS (SELECT ms.fund, family, name, place, last, lag(place) OVER w AS before, lag(name) OVER w AS old, lead(place) OVER w AS after FROM ms JOIN pl ON pl.fund = ms.fund AND pl.snapshot = ms.snapshot WINDOW w AS (PARTITION BY ms.fund, family ORDER BY place)),
ch AS (SELECT fund, family, CAST(place AS INTEGER) AS place, 'added' AS change, NULL AS old_name, name FROM mp WHERE place > 1 AND (before IS NULL OR before < place - 1) UNION ALL SELECT fund, family, CAST(place AS INTEGER), 'renamed', old, name FROM mp WHERE old <> name
  UNION ALL SELECT fund, family, CAST(place + 1 AS INTEGER), 'removed', name, NULL FROM mp WHERE place < last AND (after IS NULL OR after > place + 1))"""


def lifecycle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families added, removed and renamed from one snapshot of their fund to the next."""
    return lifecycle.changes(*memberships(spark, sf_dir))


CHANGES_SQL = f"WITH {MEMBER_SQL} SELECT * FROM ch"


def lifecycle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed families, and new names of those that had been looked up before."""
    rows, snapshots = memberships(spark, sf_dir)
    return lifecycle.issues(lifecycle.changes(rows, snapshots), rows.where("family % 3 > 0"))


LIFECYCLE_ISSUES_SQL = f"WITH {MEMBER_SQL} SELECT fund, family, place, CASE change WHEN 'removed' THEN 'catalog_member_removed' ELSE 'name_changed_without_effective_date' END AS issue FROM ch WHERE change = 'removed' OR (change = 'renamed' AND family % 3 > 0)"


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers about their customer: the day is the year's first, none for low priorities, and some answers are about another fund."""
    o = b.table(spark, sf_dir, "orders")
    return o.select(
        F.when(F.col("o_orderkey") % 50 == 0, "g").otherwise("f").alias("fund"), F.col("o_custkey").alias("family"), F.lit("f").alias("asked_fund"), F.col("o_custkey").alias("asked_family"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.trunc("o_orderdate", "YEAR")).alias("day"), F.col("o_orderkey").alias("seq"),
    )


def launch_rounds(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    """Events and issues of even orders, and then of odd ones beside the events of the first round."""
    rows = details(spark, sf_dir)
    first = lifecycle.launches(rows.where("seq % 2 = 0"))
    return [first, lifecycle.launches(rows.where("seq % 2 = 1"), first[0])]


LAUNCH_SQL = """dt AS (SELECT o_custkey AS family, o_orderkey AS seq, o_orderkey % 2 AS round, o_orderkey % 50 > 0 AS fits, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS day FROM orders),
le AS (SELECT * FROM (SELECT family, day, round, min(seq) AS seq FROM dt WHERE fits AND day IS NOT NULL GROUP BY family, day, round) QUALIFY round = min(round) OVER (PARTITION BY family, day))"""


def launch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launch days by the round that has brought them."""
    one, two = (e for e, _ in launch_rounds(spark, sf_dir))
    return one.withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))


LAUNCHES_SQL = f"WITH {LAUNCH_SQL} SELECT 'f' AS fund, family, day, seq, CAST(round + 1 AS INTEGER) AS round FROM le"


def launch_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicting and missing launch days, and answers about others."""
    one, two = (i for _, i in launch_rounds(spark, sf_dir))
    return one.unionByName(two)


LAUNCH_ISSUES_SQL = f"""WITH {LAUNCH_SQL} SELECT 'f' AS fund, family, seq, CASE WHEN NOT fits THEN 'identity_mismatch' ELSE 'missing_launch_date' END AS issue FROM dt WHERE NOT fits OR day IS NULL
UNION ALL SELECT 'f', family, seq, 'launch_date_conflict' FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round, seq, day) AS k FROM le) WHERE k > 1"""

# aliases


def alias_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers as classifications, an alias for each market segment and nation, its members, and a change for each."""
    c = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("classification"), F.col("c_mktsegment").alias("structure"), F.col("c_name").alias("shown"), "c_nationkey", "c_custkey")
    key = F.concat_ws("-", "structure", "c_nationkey")
    n = F.col("c_nationkey")
    stored = c.select("structure", "c_nationkey").distinct().select(key.alias("alias"), F.concat(F.lit("Group "), n).alias("name"), F.concat(F.lit("group "), n).alias("folded"), "structure", F.lit("active").alias("status"), (n % 3 + 1).cast("int").alias("version"))
    held = c.where("c_custkey % 4 = 0").select("classification", key.alias("alias"))
    wanted = c.groupBy("structure", "c_nationkey").agg(F.sort_array(F.collect_list(F.when(F.col("c_custkey") % 4 < 2, F.col("classification")))).alias("members"), F.min(F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey"))).alias("least"))
    expected = n % 3 + 1 + F.when(n % 7 == 3, 1).otherwise(0)
    name = F.when(n % 11 == 5, "  ").when(n % 5 == 0, F.concat(F.lit(" group   "), n + 1)).otherwise(F.concat(F.lit("Set "), n))
    more = F.when(n % 6 == 2, F.array(F.concat(F.lit("c"), (F.floor(F.coalesce("least", F.lit(0)) / 4) * 4 + 4)))).when(n % 8 == 7, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))
    changes = wanted.select(
        F.xxhash64("structure", "c_nationkey").alias("seq"), key.alias("alias"), expected.cast("int").alias("expected"), name.alias("name"), "structure", F.lit("active").alias("status"), F.array_distinct(F.concat("members", more)).alias("members"),
        F.when(n % 13 == 6, " ok ").otherwise("because").alias("reason"),
    )
    return c.select("classification", "structure", "shown"), stored, held, stored.limit(0).select("alias", "version", "name", "folded", "structure", "status", F.array("alias").alias("members"), F.col("name").alias("reason")), changes


ALIAS_SQL = """cl AS (SELECT 'c' || c_custkey AS classification, c_mktsegment AS structure, c_name AS shown, c_nationkey AS n, c_custkey AS k FROM customer), st AS (SELECT DISTINCT structure || '-' || n AS alias, structure, n, 'group ' || n AS folded, CAST(n % 3 + 1 AS INTEGER) AS version FROM cl),
hd AS (SELECT classification, structure || '-' || n AS alias FROM cl WHERE k % 4 = 0), ws AS (SELECT structure, n, min(CASE WHEN k % 4 = 0 THEN k END) AS least FROM cl GROUP BY ALL),
mb AS (SELECT DISTINCT structure, n, classification FROM (SELECT structure, n, classification FROM cl WHERE k % 4 < 2 UNION ALL SELECT structure, n, CASE WHEN n % 6 = 2 THEN 'c' || (coalesce(least, 0) // 4 * 4 + 4) ELSE 'none' END FROM ws WHERE n % 6 = 2 OR n % 8 = 7)),
fl AS (SELECT mb.structure, mb.n, count(*) AS members, bool_or(cl.classification IS NULL) AS unknown, bool_or(coalesce(cl.structure <> mb.structure, false)) AS unlike, bool_or(coalesce(hd.alias <> mb.structure || '-' || mb.n, false)) AS held FROM mb LEFT JOIN cl ON cl.classification = mb.classification LEFT JOIN hd ON hd.classification = mb.classification GROUP BY ALL),
nm AS (SELECT structure, n, CASE WHEN n % 11 = 5 THEN '' WHEN n % 5 = 0 THEN 'group ' || (n + 1) ELSE 'Set ' || n END AS name FROM ws),
oc AS (SELECT ws.structure, ws.n, nm.name, CASE WHEN ws.n % 13 = 6 THEN 'reason' WHEN ws.n % 7 = 3 THEN 'stale' WHEN nm.name = '' THEN 'blank_name' WHEN coalesce(fl.members, 0) = 0 THEN 'no_members' WHEN fl.members > 200 THEN 'too_many_members'
  WHEN st.alias IS NOT NULL THEN 'name_taken' WHEN unknown THEN 'unknown_members' WHEN unlike THEN 'other_structure' WHEN held THEN 'members_taken' WHEN lt.structure IS NOT NULL THEN 'contested' ELSE 'updated' END AS outcome
  FROM ws JOIN nm ON nm.structure = ws.structure AND nm.n = ws.n LEFT JOIN fl ON fl.structure = ws.structure AND fl.n = ws.n LEFT JOIN st ON st.structure = ws.structure AND st.folded = lower(nm.name) AND st.n <> ws.n
  LEFT JOIN (SELECT DISTINCT mb.structure, mb.n FROM mb JOIN (SELECT classification FROM mb GROUP BY classification HAVING count(*) > 1) d ON d.classification = mb.classification) lt ON lt.structure = ws.structure AND lt.n = ws.n)"""


def alias_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the changes to aliases; of those that contest a member all but the first are refused, and are told together here."""
    classes, stored, held, _, changes = alias_store(spark, sf_dir)
    told = aliases.judged(changes, stored, held, classes)
    shared = told.select("alias", F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("n"), F.collect_set("alias").alias("a")).where("n > 1").select(F.explode("a").alias("alias")).distinct().withColumn("shared", F.lit(True))
    seen = F.when(F.col("outcome").isin("contested", "updated") & F.coalesce("shared", F.lit(False)), "updated or contested").otherwise(F.col("outcome"))
    return told.join(shared, "alias", "left").select("alias", "name", seen.alias("outcome"))


ALIAS_CHANGES_SQL = f"WITH {ALIAS_SQL} SELECT structure || '-' || n AS alias, name, CASE WHEN outcome = 'contested' THEN 'updated or contested' ELSE outcome END AS outcome FROM oc"


def alias_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aliases after those changes that contest nothing, with their sources and revisions."""
    classes, stored, held, past, changes = alias_store(spark, sf_dir)
    told = aliases.judged(changes.where("alias not like '%-2' and alias not like '%-8' and alias not like '%-14' and alias not like '%-20'"), stored, held, classes)
    out = aliases.listed(*aliases.applied(told, stored, held, past), classes)
    return out.select("alias", "name", "status", "version", F.coalesce(F.array_join("sources.classification", "|"), F.lit("")).alias("sources"), F.coalesce(F.size("revisions"), F.lit(0)).cast("long").alias("revisions"))


ALIAS_LISTING_SQL = f"""WITH {ALIAS_SQL}, g AS (SELECT oc.* FROM oc WHERE outcome IN ('updated', 'contested') AND n % 6 <> 2), m AS (SELECT mb.structure || '-' || mb.n AS alias, mb.classification FROM mb JOIN g ON g.structure = mb.structure AND g.n = mb.n UNION ALL SELECT hd.alias, hd.classification FROM hd WHERE hd.alias NOT IN (SELECT structure || '-' || n FROM g)),
s AS (SELECT m.alias, string_agg(m.classification, '|' ORDER BY shown, m.classification) AS sources FROM m JOIN cl ON cl.classification = m.classification GROUP BY m.alias)
SELECT st.alias, CASE WHEN g.n IS NULL THEN 'Group ' || st.n ELSE g.name END AS name, 'active' AS status, CAST(st.version + CASE WHEN g.n IS NULL THEN 0 ELSE 1 END AS INTEGER) AS version, coalesce(s.sources, '') AS sources, CAST(CASE WHEN g.n IS NULL THEN 0 ELSE 1 END AS BIGINT) AS revisions
FROM st LEFT JOIN g ON g.structure = st.structure AND g.n = st.n LEFT JOIN s ON s.alias = st.alias"""

# repairs


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by series and week, numbered, each with a sequence number of its own."""
    own = Window.partitionBy("code", "d").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    rows = b.table(spark, sf_dir, "lineitem").withColumns({"code": F.col("l_suppkey"), "d": F.trunc("l_shipdate", "WEEK")}).withColumn("revision", F.row_number().over(own))
    return rows.withColumn("seq", F.col("code") * 10**12 + F.unix_date("d").cast("long") * 10**6 + F.col("revision"))


WEEKLY_SQL = """wk AS (SELECT *, code * 1000000000000 + date_diff('day', DATE '1970-01-01', d) * 1000000 + revision AS seq FROM (SELECT *, l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d,
  row_number() OVER (PARTITION BY l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) AS revision FROM lineitem))"""


def repaired_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions after those are gone that only repeat the one before at the end, with their links."""
    rows = weekly(spark, sf_dir).withColumn("v", F.floor(F.col("l_discount") * 20).cast("double"))
    revisions = rows.select("code", "d", "v", F.lit("valid").alias("status"), "revision")
    links = rows.select("code", "d", "revision", (F.col("l_orderkey") % 3).alias("batch"))
    kept, moved = repairs.collapsed(revisions, links)
    return kept.join(moved.groupBy("code", "d", "revision").agg(F.array_join(F.sort_array(F.collect_list("batch")), "|").alias("batches")), ["code", "d", "revision"], "left").drop("status")


REPAIRED_SQL = f"""WITH {WEEKLY_SQL}, r AS (SELECT code, d, revision, floor(l_discount * 20) AS v, l_orderkey % 3 AS batch, last_value(floor(l_discount * 20)) OVER (PARTITION BY code, d ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM wk),
t AS (SELECT *, coalesce(max(revision) FILTER (WHERE v <> fin) OVER (PARTITION BY code, d), 0) + 1 AS head FROM r), i AS (SELECT *, least(revision, head) AS into_ FROM t), l AS (SELECT code, d, into_, string_agg(DISTINCT CAST(batch AS VARCHAR), '|' ORDER BY CAST(batch AS VARCHAR)) AS batches FROM i GROUP BY ALL)
SELECT i.code, i.d, CAST(i.revision AS INTEGER) AS revision, CAST(i.v AS DOUBLE) AS v, batches FROM i JOIN l ON l.code = i.code AND l.d = i.d AND l.into_ = i.revision WHERE i.revision = i.into_"""


def retracted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind events of days before there were funds, which are taken back: every tenth series' days are set so far back."""
    rows = weekly(spark, sf_dir)
    shifted = rows.withColumn("d", F.when(F.col("code") % 10 == 9, F.date_sub("d", 13000)).otherwise(F.col("d"))).withColumn("source", F.when(F.col("l_returnflag") == "A", publication.REGISTRAR).otherwise(publication.THIRD_PARTY))
    links = shifted.select("source", "seq", "code", "d", F.lit(1).alias("revision"))
    events = shifted.groupBy("code", "d").agg(F.max("l_discount").alias("amount")).select("code", "d", "amount", F.lit(2).alias("tier"), F.lit(1).alias("revision"))
    reviews = shifted.where("source = 'third_party'").select("seq", F.concat(F.lit("r"), "code").alias("review"))
    left, tied, issues = repairs.retracted(events, links, reviews)
    counts = left.groupBy("code").agg(F.count("*").alias("n")).select(F.lit("event").alias("source"), F.col("code").alias("seq"), F.col("n").cast("string").alias("review"), F.lit(None).cast("string").alias("issue"))
    return issues.unionByName(counts).unionByName(tied.groupBy("code").agg(F.count("*").alias("n")).select(F.lit("link").alias("source"), F.col("code").alias("seq"), F.col("n").cast("string").alias("review"), F.lit(None).cast("string").alias("issue")))


RETRACTED_SQL = f"""WITH {WEEKLY_SQL}, x AS (SELECT code, seq, CASE WHEN code % 10 = 9 THEN d - 13000 ELSE d END AS d, CASE WHEN l_returnflag = 'A' THEN 'registrar' ELSE 'third_party' END AS source FROM wk)
SELECT source, seq, CASE WHEN source = 'third_party' THEN 'r' || code END AS review, 'implausible_record_date' AS issue FROM x WHERE d < DATE '1964-01-01' UNION ALL SELECT 'event', code, CAST(count(DISTINCT d) AS VARCHAR), NULL FROM x WHERE d >= DATE '1964-01-01' GROUP BY code
UNION ALL SELECT 'link', code, CAST(count(*) AS VARCHAR), NULL FROM x WHERE d >= DATE '1964-01-01' GROUP BY code"""

# drill-down and blockers


def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fifty events of every series: revisions and, in the order of their retrieval, the rows of four kinds of sources behind each."""
    li = weekly(spark, sf_dir).withColumn("revision", F.col("l_linenumber") % 2 + 1)
    n = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", "regulator").when(F.col("l_returnflag") == "A", "registrar").when(n <= 4, "third_party").otherwise("fund_house")
    rows = li.withColumns({"source": kind, "batch": F.concat(F.lit("b"), F.col("l_orderkey") % 50), "capture": F.concat(F.lit("k"), F.col("l_partkey") % 40), "raw": F.col("l_linenumber").cast("string"), "signature": F.sha2(F.col("seq").cast("string"), 256)})
    latest = F.max("revision").over(Window.partitionBy("code", "d"))
    revisions = rows.groupBy("code", "d", "revision").agg(F.max("l_discount").alias("amount"), F.max("l_shipdate").alias("at")).withColumn("current", F.col("revision") == latest)
    rows = rows.join(provenance.page_of(revisions).select("code", "d"), ["code", "d"], "left_semi")  # what is not shown is not followed to its sources
    links = rows.select("source", "seq", "code", "d", "revision")
    numbers = b.table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("i")).distinct()
    batches = numbers.select(F.concat(F.lit("b"), "i").alias("batch"), F.concat(F.lit("https://x/"), "i").alias("url"), F.timestamp_seconds(F.lit(1577836800) + F.col("i") % 7 * 3600).alias("retrieved_at"), F.lit("v1").alias("parser"), F.sha2(F.concat(F.lit("artifact"), "i"), 256).alias("sha256"))
    mine = lambda k: rows.where(F.col("source") == k).drop("source")
    regulator = mine("regulator").select("seq", (F.col("code") % 7).alias("fund"), F.lit("s").alias("scheme"), F.col("code").cast("string").alias("option"), F.lit("Fund").alias("scheme_name"), F.lit("Fund - IDCW").alias("shown_name"), "d", "raw", F.lit("amount").alias("unit"), "signature")
    seen = mine("regulator").select("seq", F.explode(F.when(n % 3 == 0, F.array("batch", F.concat(F.lit("b"), (F.col("l_orderkey") + 1) % 50))).otherwise(F.array("batch"))).alias("batch"))
    notice = mine("fund_house").select("seq", F.lit("hdfc").alias("provider"), F.col("code").cast("string").alias("option"), F.lit("Fund").alias("scheme_name"), F.lit("direct").alias("plan"), F.lit("IDCW").alias("label"), "d", "raw", F.lit("inr_per_unit").alias("unit"), "signature", F.concat(F.lit("b"), F.col("l_partkey") % 50).alias("identity_batch"))
    entries = numbers.where("i < 40").select(F.concat(F.lit("k"), "i").alias("capture"), F.concat(F.lit("e"), F.col("i") % 5).alias("entry"), F.lit("cams").alias("provider"), F.lit("f").alias("fund"), F.lit("s").alias("scheme"), F.lit("Fund").alias("scheme_name"), F.lit("direct").alias("plan"), F.lit("payout").alias("variant"), F.lit("monthly").alias("frequency"),
        F.lit("https://c").alias("url"), F.timestamp_seconds(F.lit(1577836800) + F.col("i") % 5 * 7200).alias("captured_at"), F.concat(F.lit("b"), "i").alias("batch"))
    reviews = entries.where("capture <> 'k3'").select("capture", F.concat(F.lit("evidence of "), "capture").alias("evidence"))
    catalogue = entries.select("entry", F.concat(F.lit("Entry "), "entry").alias("scheme_name")).distinct()
    told = lambda k: mine(k).select("seq", "capture", "d", "raw", "signature")
    records = [
        provenance.from_regulator(links, regulator, seen, batches), provenance.from_notices(links, notice, mine("fund_house").select("seq", "batch"), batches), provenance.from_registrars(links, told("registrar"), entries.drop("entry", "frequency"), reviews, batches),
        provenance.from_third_party(links, told("third_party"), entries.drop("provider", "fund", "scheme", "scheme_name"), catalogue, reviews, batches),
    ]
    out = provenance.drill_down(revisions, records, assessed_briefly(spark, sf_dir))
    one = lambda s: F.concat_ws("/", s["kind"], s["seq"].cast("string"), s["shown_name"], s["batch"], F.substring(s["sha256"], 1, 8), F.substring(s["identity_sha256"], 1, 8), s["identity_evidence"])
    text = F.array_join(F.transform("revisions", lambda r: F.concat(r["revision"].cast("string"), F.when(r["current"], "*").otherwise(""), F.lit(":"), F.array_join(F.transform(r["sources"], one), ","))), ";")
    return out.select("code", "total", "d", F.col("place").cast("long").alias("place"), F.aggregate("revisions", F.lit(0.0), lambda a, r: a + r["amount"]).alias("amounts"), text.alias("revisions"), F.col("coverage.status").alias("coverage"))


def assessed_briefly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.lit("events_present").alias("status"))


DRILL_SQL = f"""WITH {WEEKLY_SQL}, q AS (SELECT code, d, l_linenumber % 2 + 1 AS revision, seq, l_discount, l_orderkey, l_partkey, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'amfi_distribution_api' WHEN l_returnflag = 'A' THEN 'rta_distribution_history' WHEN l_linenumber <= 4 THEN 'third_party_distribution_history' ELSE 'amc_distribution_notice' END AS kind FROM wk),
s AS (SELECT code, d, revision, seq, kind, unnest(CASE WHEN kind LIKE 'rta%' OR kind LIKE 'third%' THEN [l_partkey % 40] WHEN kind LIKE 'amfi%' AND n % 3 = 0 THEN [l_orderkey % 50, (l_orderkey + 1) % 50] ELSE [l_orderkey % 50] END) AS i, l_partkey % 50 AS pi FROM q),
t AS (SELECT *, CASE WHEN kind LIKE 'rta%' OR kind LIKE 'third%' THEN i % 5 * 2 ELSE i % 7 END AS h, kind || '/' || seq || '/' || CASE WHEN kind LIKE 'amfi%' THEN 'Fund - IDCW' WHEN kind LIKE 'amc%' THEN 'Fund - Direct Plan - IDCW' WHEN kind LIKE 'rta%' THEN 'Fund - Direct - Payout' ELSE 'Entry e' || (i % 5) || ' - Direct - Payout - Monthly' END
  || '/b' || i || '/' || substr(sha256('artifact' || i), 1, 8) || CASE WHEN kind LIKE 'amfi%' THEN '' WHEN kind LIKE 'amc%' THEN '/' || substr(sha256('artifact' || pi), 1, 8) ELSE '/' || substr(sha256('artifact' || i), 1, 8) || CASE WHEN i = 3 THEN '' ELSE '/evidence of k' || i END END AS x FROM s),
r AS (SELECT code, d, revision, string_agg(x, ',' ORDER BY h, 'b' || i, kind, seq) AS xs FROM t GROUP BY ALL), a AS (SELECT code, d, revision, max(l_discount) AS amount FROM q GROUP BY ALL), m AS (SELECT *, revision = max(revision) OVER (PARTITION BY code, d) AS current FROM a),
e AS (SELECT m.code, m.d, sum(amount) AS amounts, string_agg(m.revision || CASE WHEN current THEN '*' ELSE '' END || ':' || coalesce(xs, ''), ';' ORDER BY m.revision DESC) AS revisions FROM m LEFT JOIN r ON r.code = m.code AND r.d = m.d AND r.revision = m.revision GROUP BY m.code, m.d)
SELECT * FROM (SELECT code, count(*) OVER (PARTITION BY code) AS total, d, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS place, amounts, revisions, CASE WHEN code IN (SELECT s_suppkey FROM supplier) THEN 'events_present' END AS coverage FROM e) WHERE place <= 50"""


def blocked_option_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options whose rows are all held back: the regulator's by gate, and those of another source."""
    li = b.table(spark, sf_dir, "lineitem")
    rows = li.where("l_returnflag <> 'A'").select(F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "WEEK").alias("d"), "l_discount", "l_returnflag")
    ev = p.events_before(spark, sf_dir)
    linked = rows.where("l_returnflag = 'R'").join(ev.where("amount is not null").select("code", "d", "amount"), ["code", "d"]).where("amount = l_discount")
    options = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    found = publication.blocked_options(publication.coverage(options, rows, linked, ev), p.gated_lines(spark, sf_dir), options)
    gates = F.array_join(F.transform(F.map_entries("gates"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), "|")
    return found.withColumn("gates", gates)


BLOCKED_SQL = f"""WITH {p.EVENTS_SQL}, {p.GATED_SQL}, rw AS (SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem WHERE l_returnflag <> 'A'), sr AS (SELECT code, count(*) AS n, min(d) AS lo, max(d) AS hi FROM rw GROUP BY code),
gn AS (SELECT code, gate, count(*) AS n FROM gt GROUP BY ALL), gs AS (SELECT code, CAST(sum(n) AS BIGINT) AS n, string_agg(gate || '=' || n, '|' ORDER BY gate) AS gates FROM gn GROUP BY code)
SELECT s_suppkey AS code, s_name AS name, sr.n AS source_rows, sr.n AS blocked_rows, coalesce(gs.n, 0) AS regulator_rows, sr.n - coalesce(gs.n, 0) AS other_rows, lo AS first_day, hi AS last_day, coalesce(gates, '') AS gates
FROM supplier JOIN sr ON sr.code = s_suppkey LEFT JOIN gs ON gs.code = s_suppkey WHERE s_suppkey NOT IN (SELECT code FROM ev WHERE amount IS NOT NULL)"""

QUERIES = {
    "lifecycle_changes": (lifecycle_changes, CHANGES_SQL),
    "lifecycle_issues": (lifecycle_issues, LIFECYCLE_ISSUES_SQL),
    "launch_events": (launch_events, LAUNCHES_SQL),
    "launch_issues": (launch_issues, LAUNCH_ISSUES_SQL),
    "alias_changes": (alias_changes, ALIAS_CHANGES_SQL),
    "alias_listing": (alias_listing, ALIAS_LISTING_SQL),
    "repaired_revisions": (repaired_revisions, REPAIRED_SQL),
    "retracted_rows": (retracted_rows, RETRACTED_SQL),
    "drill_down": (drill_down, DRILL_SQL),
    "blocked_option_report": (blocked_option_report, BLOCKED_SQL),
}
