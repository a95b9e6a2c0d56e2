"""Payouts on their way from source rows to events, and the reports about them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import publication
from . import bindings as b

# what a label adds to its scheme's name, by turns, in the sample
SUFFIXES = [" - IDCW", " - IDCW", " - IDCW Payout", " - IDCW", " - Growth Option", " (Bonus / Dividend)", " Daily", "Growth - Bonus Option"]


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as the regulator's payout rows: week as day, arrival by order, units by line, labels by part."""
    p, li = b.table(spark, sf_dir, "part"), b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    parts = p.select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("scheme"), F.concat("p_name", suffix).alias("label"))
    unit = F.when(F.col("l_linenumber") == 7, "ratio").when(F.col("l_linenumber") == 6, "percentage").otherwise("amount")
    rows = li.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "WEEK").alias("d"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), unit.alias("unit"),
        F.when(F.col("l_linenumber") < 7, F.col("l_discount")).alias("value"), "scheme", "label",
    )


def known_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "supplier").where("s_suppkey % 11 <> 0").select(F.col("s_suppkey").alias("code"))


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '(?i){pattern}')"


PHRASES = "\\bidcw\\b|\\bincome\\s+distribution\\s+cum\\s+capital\\s+withdrawal\\b"
DIVIDENDS = "\\b(dividend|div)\\b"
GATED_SQL = f"""ln AS (SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_orderkey * 8 + l_linenumber AS seq, CASE l_linenumber WHEN 7 THEN 'ratio' WHEN 6 THEN 'percentage' ELSE 'amount' END AS unit,
  CASE WHEN l_linenumber < 7 THEN l_discount END AS value, CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE p_name END AS scheme, p_name || {[*SUFFIXES]}[p_partkey % 8 + 1] AS label FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
lb AS (SELECT *, CASE WHEN starts_with(lower(label), lower(scheme)) AND NOT regexp_matches(substr(label, length(scheme) + 1, 1), '[A-Za-z0-9]') THEN trim(substr(label, length(scheme) + 1), ' -:;/()[]') ELSE '' END AS own, rtrim(label, ' -:;/()[]') AS tail FROM ln),
lc AS (SELECT *, CASE WHEN own <> '' THEN {matches('own', PHRASES)} OR {matches('own', DIVIDENDS)} ELSE {matches('label', PHRASES)} OR ({matches('label', DIVIDENDS)} AND NOT {matches('scheme', DIVIDENDS)})
    OR {matches('tail', '(?:' + chr(92) + 'bdiv(?:idend)?|' + chr(92) + 'bidcw)(?:' + chr(92) + 's+(?:opt(?:ion)?|payout|reinvestment))?$')} OR {matches('label', 'bonus' + chr(92) + 's*/' + chr(92) + 's*(dividend|idcw)')} OR {matches('label', chr(92) + 'bdividend' + chr(92) + 's+(opt|option|plan|payout|reinvestment)' + chr(92) + 'b')} END AS pays,
  CASE WHEN own <> '' THEN {matches('own', chr(92) + 'bbonus' + chr(92) + 'b')} ELSE ({matches('label', chr(92) + 'bbonus' + chr(92) + 'b')} AND NOT {matches('scheme', chr(92) + 'bbonus' + chr(92) + 'b')}) OR {matches('tail', chr(92) + 'bbonus(' + chr(92) + 's+option)?$')} OR {matches('label', 'bonus' + chr(92) + 's*/' + chr(92) + 's*(dividend|idcw)')} END AS bonus,
  CASE WHEN own <> '' THEN {matches('own', chr(92) + 'b(growth|cumulative)' + chr(92) + 'b')} ELSE ({matches('label', chr(92) + 'b(growth|cumulative)' + chr(92) + 'b')} AND NOT {matches('scheme', chr(92) + 'b(growth|cumulative)' + chr(92) + 'b')}) OR {matches('tail', chr(92) + 'b(growth|cumulative)(' + chr(92) + 's+option)?$')} END AS grows FROM lb),
gt AS (SELECT *, code % 11 <> 0 AS known, CASE WHEN code % 11 = 0 THEN 'unmatched_option_identifier' WHEN unit = 'ratio' THEN 'ratio_source_value' WHEN value <= 0 THEN 'non_positive_scalar' WHEN unit = 'percentage' THEN 'percentage_source_value'
  WHEN grows AND (pays OR bonus) THEN 'conflicting_option_labels' WHEN pays AND bonus THEN 'ambiguous_bonus_or_distribution_option' WHEN pays THEN 'cash_amount_candidate' WHEN bonus THEN 'explicit_bonus_option'
  WHEN grows THEN 'explicit_growth_or_cumulative_option' ELSE 'unknown_option_label' END AS gate FROM lc)"""


def gated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known = labelled_lines(spark, sf_dir), known_options(spark, sf_dir)
    return publication.normalise(rows, known, spark.createDataFrame([], publication.EVENT))


def label_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payout rows by gate, with options and the total that all gates add up to."""
    gates = gated_lines(spark, sf_dir).groupBy("gate").agg(F.count("*").alias("n"), F.count_distinct("code").alias("options"))
    total = gates.agg(F.sum("n").alias("total"))
    return gates.join(F.broadcast(total))  # one row


GATES_SQL = f"WITH {GATED_SQL} SELECT gate, count(*) AS n, count(DISTINCT code) AS options, (SELECT count(*) FROM gt) AS total FROM gt GROUP BY gate"


def payout_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the regulator's rows do to events: inserted, revised, unchanged, blocked or refused, with the revision that each leaves."""
    return gated_lines(spark, sf_dir).select("code", "d", "seq", "gate", "action", F.col("revision").cast("long").alias("revision"))


NORMALISATION_SQL = f"""WITH {GATED_SQL}, m AS (SELECT *, gate = 'cash_amount_candidate' AS ok, known AND bool_or(gate = 'cash_amount_candidate') OVER e AND bool_or(gate <> 'cash_amount_candidate') OVER e AS mixed FROM gt WINDOW e AS (PARTITION BY code, d)),
c AS (SELECT code, d, seq, value, row_number() OVER e AS k, lag(value) OVER e AS prior FROM m WHERE ok WINDOW e AS (PARTITION BY code, d ORDER BY seq)),
a AS (SELECT m.code, m.d, m.seq, m.gate, CASE WHEN mixed THEN 'refused' WHEN NOT ok THEN 'blocked' WHEN k = 1 THEN 'inserted' WHEN prior = c.value THEN 'unchanged' ELSE 'revised' END AS action FROM m LEFT JOIN c ON c.code = m.code AND c.d = m.d AND c.seq = m.seq)
SELECT *, CAST(count(*) FILTER (WHERE action IN ('inserted', 'revised')) OVER (PARTITION BY code, d ORDER BY seq) AS BIGINT) AS revision FROM a"""


def events_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as earlier runs may have left them: of all three tiers, some retired by a conflict."""
    rows = b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_suppkey % 5 <> 4").select(
        F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "WEEK").alias("d"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_discount").alias("amount")
    )
    last = rows.groupBy("code", "d").agg(F.max_by("amount", "seq").alias("amount"), F.count("*").cast("int").alias("revision"))
    return last.select("code", "d", F.when(F.col("code") % 7 > 0, F.col("amount")).alias("amount"), (F.col("code") % 3 + 1).cast("int").alias("tier"), "revision")


EVENTS_SQL = """ev AS (SELECT code, d, CASE WHEN code % 7 > 0 THEN amount END AS amount, code % 3 + 1 AS tier, revision FROM (SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, max_by(l_discount, l_orderkey * 8 + l_linenumber) AS amount, count(*) AS revision
  FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 5 <> 4 GROUP BY ALL))"""


def registrar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted lines as a registrar's rows; those of every third order arrive in a second batch."""
    state = F.when(F.col("l_suppkey") % 13 == 0, "ambiguous").when(F.col("l_suppkey") % 17 == 0, "unresolved").otherwise("mapped")
    return b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("code"), state.alias("state"), F.trunc("l_shipdate", "WEEK").alias("d"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_partkey") % 2).alias("capture"), (F.col("l_linenumber") % 2).cast("string").alias("raw"), (F.floor(F.col("l_discount") * 40) / 100).alias("amount"),
        F.when(F.col("l_orderkey") % 3 == 0, 2).otherwise(1).alias("batch"),
    )


def registrar_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a registrar's rows do to these events, with issues and revisions."""
    out = publication.publish_registrar(registrar_rows(spark, sf_dir), events_before(spark, sf_dir))
    return out.select("code", "d", "seq", "action", "issue", F.col("revision").cast("long").alias("revision"), "retires")


REGISTRAR_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, s AS (SELECT l_suppkey AS code, CASE WHEN l_suppkey % 13 = 0 THEN 'ambiguous' WHEN l_suppkey % 17 = 0 THEN 'unresolved' ELSE 'mapped' END AS state, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_orderkey * 8 + l_linenumber AS seq,
  (l_partkey % 2) * 2 + l_linenumber % 2 AS k, floor(l_discount * 40) / 100 AS amount FROM lineitem WHERE l_returnflag = 'A'),
q AS (SELECT *, row_number() OVER (PARTITION BY code, d ORDER BY seq) AS rn FROM s WHERE state = 'mapped'),
f AS (SELECT q.code, q.d, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, false AS retires, max(ev.amount) AS cur, max(ev.tier) AS tier, CAST([] AS BIGINT[]) AS ks, coalesce(max(ev.revision), 0) AS rev FROM q LEFT JOIN ev ON ev.code = q.code AND ev.d = q.d GROUP BY q.code, q.d
  UNION ALL SELECT code, d, rn, seq, action, action = 'conflict' AND coalesce(tier, 2) <> 1, CASE WHEN action = 'conflict' AND tier = 2 THEN NULL WHEN action = 'conflict' THEN cur ELSE amount END, CASE WHEN action = 'conflict' THEN tier ELSE least(coalesce(tier, 2), 2) END,
    CASE WHEN action IN ('inserted', 'revised') THEN [k] WHEN action = 'linked' THEN list_append(ks, k) ELSE ks END, rev + CASE WHEN action IN ('inserted', 'revised') THEN 1 ELSE 0 END
  FROM (SELECT f.code, f.d, q.rn, q.seq, q.amount, q.k, f.cur, f.tier, f.ks, f.rev, CASE WHEN cur = q.amount THEN 'linked' WHEN cur IS NOT NULL AND (tier = 3 OR (tier = 2 AND list_contains(ks, q.k))) THEN 'revised' WHEN cur IS NOT NULL THEN 'conflict' WHEN tier <= 2 THEN 'conflict' WHEN tier IS NULL THEN 'inserted' ELSE 'revised' END AS action
    FROM f JOIN q ON q.code = f.code AND q.d = f.d AND q.rn = f.rn + 1) n)
SELECT code, d, seq, action, CASE WHEN action = 'conflict' THEN 'amount_conflict' END AS issue, CAST(rev AS BIGINT) AS revision, retires FROM f WHERE rn > 0
UNION ALL SELECT code, d, seq, 'blocked', CASE state WHEN 'ambiguous' THEN 'ambiguous_scheme' ELSE 'unmapped_scheme' END, NULL, false FROM s WHERE state <> 'mapped'"""


def third_party_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New lines as a third party's rows under one review of each series; those of every third order arrive in a second batch."""
    return b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(
        F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "WEEK").alias("d"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), (F.floor(F.col("l_discount") * 40) / 100).alias("amount"),
        F.concat(F.lit("r"), F.col("l_suppkey")).alias("review"), F.when(F.col("l_orderkey") % 3 == 0, 2).otherwise(1).alias("batch"),
    )


def third_party_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a third party's rows do to these events."""
    out = publication.publish_third_party(third_party_rows(spark, sf_dir), events_before(spark, sf_dir))
    return out.select("code", "d", "seq", "action", "issue", F.col("revision").cast("long").alias("revision"), F.coalesce("retires", F.lit(False)).alias("retires"))


THIRD_SQL = f"""WITH {EVENTS_SQL}, s AS (SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_orderkey * 8 + l_linenumber AS seq, floor(l_discount * 40) / 100 AS amount FROM lineitem WHERE l_returnflag = 'N'),
g AS (SELECT code, d, count(DISTINCT amount) AS kinds, min(amount) AS own FROM s GROUP BY ALL),
j AS (SELECT g.*, ev.code IS NOT NULL AS there, ev.amount AS was, tier, coalesce(revision, 0) AS rev FROM g LEFT JOIN ev ON ev.code = g.code AND ev.d = g.d),
t AS (SELECT *, CASE WHEN kinds > 1 THEN 'same_priority_conflict' WHEN was <> own AND tier < 3 THEN 'higher_priority_conflict' WHEN was <> own THEN 'same_priority_conflict' WHEN there AND was IS NULL THEN 'same_priority_conflict' END AS issue FROM j)
SELECT s.code, s.d, seq, CASE WHEN issue IS NOT NULL THEN 'blocked' WHEN there THEN 'linked' ELSE 'inserted' END AS action, issue, CAST(rev + CASE WHEN issue IS NULL AND NOT there THEN 1 ELSE 0 END AS BIGINT) AS revision, coalesce(kinds = 1 AND was <> own AND tier = 3, false) AS retires
FROM s JOIN t ON t.code = s.code AND t.d = s.d"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the payout options by these events: the regulator's rows are the sources, those of a current amount linked."""
    li = b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "WEEK").alias("d"), "l_discount")
    ev = events_before(spark, sf_dir)
    linked = li.join(ev.where("amount is not null").select("code", "d", "amount"), ["code", "d"]).where("amount = l_discount")
    options = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"))
    return publication.coverage(options.unionByName(spark.range(-3, 0).select(F.col("id").alias("code"))), li, linked, ev)


COVERAGE_SQL = f"""{EVENTS_SQL}, li AS (SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_discount FROM lineitem WHERE l_returnflag = 'R'),
op AS (SELECT s_suppkey AS code FROM supplier UNION ALL SELECT unnest([-3, -2, -1])), sr AS (SELECT code, count(*) AS n, min(d) AS lo, max(d) AS hi FROM li GROUP BY code),
lk AS (SELECT li.code, count(*) AS n FROM li JOIN ev ON ev.code = li.code AND ev.d = li.d AND ev.amount = l_discount GROUP BY 1), en AS (SELECT code, count(*) AS n FROM ev WHERE amount IS NOT NULL GROUP BY 1),
cv AS (SELECT op.code, coalesce(sr.n, 0) AS source_rows, lo AS first_day, hi AS last_day, coalesce(lk.n, 0) AS linked_rows, coalesce(en.n, 0) AS events, coalesce(sr.n, 0) - coalesce(lk.n, 0) AS blocked_rows,
  CASE WHEN coalesce(en.n, 0) > 0 THEN 'events_present' WHEN coalesce(sr.n, 0) > 0 THEN 'blocked_source_rows' ELSE 'unverified_empty' END AS status FROM op LEFT JOIN sr ON sr.code = op.code LEFT JOIN lk ON lk.code = op.code LEFT JOIN en ON en.code = op.code)"""


def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each payout option: events present, blocked source rows, or nothing known, with counts and bounds."""
    return assessed(spark, sf_dir)


STATUS_SQL = f"WITH {COVERAGE_SQL} SELECT * FROM cv"


def payout_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds back the rows of options without events, by gate; gates that hold none too."""
    return publication.blockers(assessed(spark, sf_dir), gated_lines(spark, sf_dir)).select("gate", "rows", "options")


BLOCKERS_SQL = f"""WITH {COVERAGE_SQL}, {GATED_SQL}, bl AS (SELECT gate, count(*) AS n, count(DISTINCT code) AS o FROM gt WHERE code IN (SELECT code FROM cv WHERE status = 'blocked_source_rows') GROUP BY gate),
al AS (SELECT unnest(['cash_amount_candidate', 'unmatched_option_identifier', 'non_positive_scalar', 'percentage_source_value', 'ratio_source_value', 'explicit_bonus_option', 'explicit_growth_or_cumulative_option', 'ambiguous_bonus_or_distribution_option', 'conflicting_option_labels', 'unknown_option_label']) AS gate)
SELECT al.gate, coalesce(n, 0) AS rows, coalesce(o, 0) AS options FROM al LEFT JOIN bl ON bl.gate = al.gate"""


def open_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as captures, their orders as reviews whose evidence is JSON."""
    c, o = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "orders")
    provider = F.element_at(F.array(F.lit("cams"), F.lit("kfintech"), F.lit("advisorkhoj")), (F.col("c_custkey") % 3 + 1).cast("int"))
    captures = c.select(F.col("c_custkey").alias("capture"), provider.alias("provider"), F.col("c_name").alias("name"), (F.col("c_custkey") % 50).alias("rows"))
    codes = lambda n: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("c"), i.cast("string"))) if n is None else F.slice(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("c"), i.cast("string"))), 1, n)
    state = F.when(F.col("o_orderstatus") == "F", "unresolved").when(F.col("o_orderstatus") == "P", "mapped").otherwise("ambiguous")
    third, key = F.col("o_custkey") % 3 == 2, (F.col("o_orderkey") % 3).cast("int")
    candidates = F.when(third, codes(key)).otherwise(F.when(state == "ambiguous", codes(2)).otherwise(codes(0)))
    qualified = F.when(third & (state == "ambiguous"), codes(2)).otherwise(codes(0))
    clashes = F.array(F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("2001-01-01"))).otherwise(F.array().cast("array<string>")).alias("conflicts")))
    evidence = F.to_json(F.struct(candidates.alias("candidate_codes"), qualified.alias("qualifying_codes"), clashes.alias("candidates")))
    reviews = o.select(F.col("o_custkey").alias("capture"), F.col("o_orderdate").alias("reviewed_at"), F.col("o_orderkey").alias("id"), state.alias("state"), evidence.alias("evidence"))
    return publication.backlog(captures, reviews)


OPEN_SQL = """rv AS (SELECT o_custkey AS capture, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'unresolved' WHEN 'P' THEN 'mapped' ELSE 'ambiguous' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1),
bk AS (SELECT c_custkey AS capture, ['cams', 'kfintech', 'advisorkhoj'][c_custkey % 3 + 1] AS provider, c_name AS name, c_custkey % 50 AS rows, state, CASE WHEN c_custkey % 50 > 0 THEN CASE WHEN c_custkey % 3 = 2 THEN CASE WHEN state = 'ambiguous' THEN 'multiple_qualifying_nav_candidates' WHEN id % 3 = 0 THEN 'no_metadata_candidate'
  WHEN id % 2 = 0 THEN 'comparable_nav_conflict' ELSE 'insufficient_nav_evidence' END WHEN state = 'ambiguous' THEN 'multiple_exact_name_plan_nav_candidates' ELSE 'no_exact_name_plan_nav_candidate' END END AS reason FROM customer JOIN rv ON rv.capture = c_custkey WHERE state <> 'mapped')"""


def identity_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open captures by provider, state and reason, with their rows; those without rows have no reason."""
    return open_captures(spark, sf_dir).groupBy("provider", "state", "reason").agg(F.count("*").alias("captures"), F.sum("rows").alias("source_rows"))


IDENTITY_BACKLOG_SQL = f"WITH {OPEN_SQL} SELECT provider, state, reason, count(*) AS captures, CAST(sum(rows) AS BIGINT) AS source_rows FROM bk GROUP BY ALL"


def backlog_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.backlog_summary(open_captures(spark, sf_dir))


PROVIDERS_SQL = f"WITH {OPEN_SQL} SELECT provider, " + ", ".join(
    f"count(*) FILTER (WHERE state = '{s}' AND rows > 0) AS {s}_captures, CAST(coalesce(sum(rows) FILTER (WHERE state = '{s}'), 0) AS BIGINT) AS {s}_rows, count(*) FILTER (WHERE state = '{s}' AND rows = 0) AS {s}_empty" for s in ("unresolved", "ambiguous")
) + " FROM bk GROUP BY provider"


def backlog_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred open captures with most rows."""
    return publication.backlog_ranked(open_captures(spark, sf_dir)).select("capture", "provider", "name", "rows", "state", "reason")


RANKING_SQL = f"WITH {OPEN_SQL} SELECT capture, provider, name, rows, state, reason FROM bk WHERE rows > 0 ORDER BY rows DESC, provider, name, capture LIMIT 100"


def registrar_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures mapped to options by name, plan and exact values: names in the registrar's spelling, values of some days."""
    m, nav = b.members(spark, sf_dir), b.nav(spark, sf_dir)
    plan = F.when(F.col("code") % 2 == 0, "direct").otherwise("regular")
    group = F.floor(F.col("code") / 4).cast("string")
    metadata = m.select("code", F.concat(F.lit("Aditya Birla Sun Life Fund "), group, F.lit(" - Direct Plan - IDCW Payout")).alias("name"), plan.alias("plan"), F.lit("idcw").alias("option"))
    captures = m.select(F.concat(F.lit("k"), F.col("code")).alias("capture"), F.concat(F.lit("ABSL Fund "), group, F.lit(" (formerly Old Fund) Reg Dividend")).alias("name"), F.when(F.col("code") % 3 == 0, "unknown").otherwise(plan).alias("plan"))
    points = nav.where("day(d) <= 3 and code % 5 > 0").select(F.concat(F.lit("k"), F.col("code")).alias("capture"), "d", F.col("v").alias("value"))
    return publication.map_registrar(captures.withColumn("name", F.regexp_replace("name", " \\(formerly.*$", " Reg Dividend")), points, metadata, nav)


MAPPING_SQL = f"""WITH {b.NAV_SQL}, mt AS (SELECT s_suppkey AS code, s_suppkey // 4 AS g, s_suppkey % 2 AS plan FROM supplier), cp AS (SELECT 'k' || code AS capture, code, g, CASE WHEN code % 3 = 0 THEN NULL ELSE plan END AS plan FROM mt),
pt AS (SELECT DISTINCT 'k' || code AS capture, d, v FROM nav WHERE day(d) <= 3 AND code % 5 > 0), ht AS (SELECT cp.capture, mt.code, count(*) AS n FROM cp JOIN mt ON mt.g = cp.g AND (cp.plan IS NULL OR cp.plan = mt.plan) JOIN pt ON pt.capture = cp.capture JOIN nav ON nav.code = mt.code AND nav.d = pt.d AND nav.v = pt.v GROUP BY ALL),
st AS (SELECT capture, count(*) AS k, min(code) AS code, CAST(sum(n) AS BIGINT) AS matches FROM ht GROUP BY capture)
SELECT cp.capture, CASE WHEN k = 1 THEN 'mapped' WHEN k > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state, CASE WHEN k = 1 THEN st.code END AS code, coalesce(matches, 0) AS matches FROM cp LEFT JOIN st ON st.capture = cp.capture"""


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the quality report that count by kind, as rows of (section, item, n)."""
    obs, e, gated = b.observations(spark, sf_dir), b.table(spark, sf_dir, "events"), gated_lines(spark, sf_dir)
    by = lambda df, c: df.groupBy(c.alias("item")).agg(F.count("*").alias("n"))
    ev = events_before(spark, sf_dir)
    return publication.report({
        "nav_issue": by(e.select("event_type", "user_id", F.col("ts").cast("date").alias("d")).distinct(), F.col("event_type")),
        "nav_issue_occurrence": by(e, F.col("event_type")),
        "non_positive": gated.where("value <= 0").agg(F.lit("rows").alias("item"), F.count("*").alias("n")).unionByName(gated.where("value <= 0").agg(F.lit("identifiers").alias("item"), F.count_distinct("code").alias("n"))),
        "unresolved_identifier": gated.where("gate = 'unmatched_option_identifier'").groupBy(F.col("code").alias("item")).agg(F.count("*").alias("n")),
        "gate_rows": by(gated, F.col("gate")),
        "gate_identifiers": gated.groupBy(F.col("gate").alias("item")).agg(F.count_distinct("code").alias("n")),
        "mapping": by(open_captures(spark, sf_dir), F.col("state")),
        "action": by(gated, F.col("action")),
        "events": by(ev, F.when(F.col("amount").isNull(), "retired").otherwise("current")),
        "revisions": ev.agg(F.lit("all").alias("item"), F.sum("revision").alias("n")),
        "status": by(obs, F.col("l_linestatus")),
        "product": by(b.members(spark, sf_dir), F.col("product")),
    })


REPORT_SQL = f"""WITH {GATED_SQL}, {EVENTS_SQL}, {OPEN_SQL}, {b.MEMBER_SQL}, nm AS ({NORMALISATION_SQL})
SELECT 'nav_issue' AS section, event_type AS item, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) FROM events) GROUP BY ALL UNION ALL SELECT 'nav_issue_occurrence', event_type, count(*) FROM events GROUP BY ALL
UNION ALL SELECT 'non_positive', 'rows', count(*) FROM gt WHERE value <= 0 UNION ALL SELECT 'non_positive', 'identifiers', count(DISTINCT code) FROM gt WHERE value <= 0
UNION ALL SELECT 'unresolved_identifier', CAST(code AS VARCHAR), count(*) FROM gt WHERE NOT known GROUP BY ALL UNION ALL SELECT 'gate_rows', gate, count(*) FROM gt GROUP BY ALL UNION ALL SELECT 'gate_identifiers', gate, count(DISTINCT code) FROM gt GROUP BY ALL
UNION ALL SELECT 'mapping', state, count(*) FROM bk GROUP BY ALL UNION ALL SELECT 'action', action, count(*) FROM nm GROUP BY ALL UNION ALL SELECT 'events', CASE WHEN amount IS NULL THEN 'retired' ELSE 'current' END, count(*) FROM ev GROUP BY ALL
UNION ALL SELECT 'revisions', 'all', CAST(sum(revision) AS BIGINT) FROM ev UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'product', product, count(*) FROM mem GROUP BY ALL"""

QUERIES = {
    "label_gates": (label_gates, GATES_SQL),
    "payout_normalisation": (payout_normalisation, NORMALISATION_SQL),
    "registrar_publication": (registrar_publication, REGISTRAR_SQL),
    "third_party_publication": (third_party_publication, THIRD_SQL),
    "coverage_status": (coverage_status, STATUS_SQL),
    "payout_blockers": (payout_blockers, BLOCKERS_SQL),
    "identity_backlog": (identity_backlog, IDENTITY_BACKLOG_SQL),
    "backlog_by_provider": (backlog_by_provider, PROVIDERS_SQL),
    "backlog_ranking": (backlog_ranking, RANKING_SQL),
    "registrar_mapping": (registrar_mapping, MAPPING_SQL),
    "quality_report": (quality_report, REPORT_SQL),
}
