"""Publication run after run: a first run over one batch, a second over all rows with the ledgers of the first, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import publication
from ..sources.shared import written
from . import publication_queries as p


def identified(rows: DataFrame, *order: str) -> DataFrame:
    """rows whose seq names one row alone, in the order of (seq, *order) within each (code, d): lines of the sample repeat their keys."""
    place = F.row_number().over(Window.partitionBy("code", "d").orderBy("seq", *order))
    return rows.withColumn("seq", F.col("code") * 10**12 + F.unix_date("d").cast("long") * 10**6 + place)


def identity_sql(order: str) -> str:
    return f"code * 1000000000000 + date_diff('day', DATE '1970-01-01', d) * 1000000 + row_number() OVER (PARTITION BY code, d ORDER BY seq, {order})"


def two_runs(publish, rows: DataFrame, events: DataFrame, source: str) -> DataFrame:
    """seq, action and revision of the first run (null for rows of the second batch), and the second run's result."""
    first = written(publish(rows.where("batch = 1"), events, None, None))  # the second run starts from what the first has left, not from its computation
    told = first.select(*rows.columns, F.col("action").alias("first_action"), F.col("revision").cast("long").alias("first_revision"))
    every = told.unionByName(rows.where("batch <> 1"), allowMissingColumns=True)
    second = publish(every, publication.after(events, first), publication.new_links(first, source), publication.new_issues(first, source))
    return second.withColumn("revision", F.col("revision").cast("long"))


def registrar_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registrar's rows in two runs: those linked by the first are unchanged in the second, conflicts stay conflicts."""
    publish = lambda rows, events, links, _: publication.publish_registrar(rows, events, links)
    out = two_runs(publish, identified(p.registrar_rows(spark, sf_dir), "capture", "raw", "amount"), p.events_before(spark, sf_dir), publication.REGISTRAR)
    return out.select("code", "d", "seq", "first_action", "first_revision", "action", "issue", "revision")


REGISTRAR_RERUN_SQL = f"""WITH RECURSIVE {p.EVENTS_SQL}, s0 AS (SELECT l_suppkey AS code, CASE WHEN l_suppkey % 13 = 0 THEN 'ambiguous' WHEN l_suppkey % 17 = 0 THEN 'unresolved' ELSE 'mapped' END AS state, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_orderkey * 8 + l_linenumber AS seq,
  (l_partkey % 2) * 2 + l_linenumber % 2 AS k, floor(l_discount * 40) / 100 AS amount, CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 1 END AS batch FROM lineitem WHERE l_returnflag = 'A'), s AS (SELECT * REPLACE ({identity_sql('k, amount')} AS seq) FROM s0),
q AS (SELECT *, row_number() OVER (PARTITION BY code, d ORDER BY run, seq) AS rn FROM (SELECT *, unnest(CASE batch WHEN 1 THEN [1, 2] ELSE [2] END) AS run FROM s WHERE state = 'mapped')),
f AS (SELECT q.code, q.d, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, 0 AS run, CAST(NULL AS VARCHAR) AS action, max(ev.amount) AS cur, max(ev.tier) AS tier, CAST([] AS BIGINT[]) AS ks, CAST([] AS STRUCT(seq BIGINT, rev BIGINT)[]) AS tied, CAST(coalesce(max(ev.revision), 0) AS BIGINT) AS rev, CAST(0 AS BIGINT) AS said FROM q LEFT JOIN ev ON ev.code = q.code AND ev.d = q.d GROUP BY q.code, q.d
  UNION ALL SELECT code, d, rn, seq, run, action, CASE WHEN action = 'unchanged' THEN cur WHEN action = 'conflict' AND tier = 2 THEN NULL WHEN action = 'conflict' THEN cur ELSE amount END, CASE WHEN action IN ('conflict', 'unchanged') THEN tier ELSE least(coalesce(tier, 2), 2) END,
    CASE WHEN action IN ('inserted', 'revised') THEN [k] WHEN action = 'linked' THEN list_append(ks, k) ELSE ks END, CASE WHEN action IN ('inserted', 'revised', 'linked') THEN list_append(tied, {{'seq': seq, 'rev': rev + CASE WHEN action = 'linked' THEN 0 ELSE 1 END}}) ELSE tied END,
    rev + CASE WHEN action IN ('inserted', 'revised') THEN 1 ELSE 0 END, CASE action WHEN 'unchanged' THEN list_filter(tied, lambda x: x.seq = n.seq)[1].rev WHEN 'inserted' THEN rev + 1 WHEN 'revised' THEN rev + 1 ELSE rev END
  FROM (SELECT f.code, f.d, q.rn, q.seq, q.run, q.amount, q.k, f.cur, f.tier, f.ks, f.tied, f.rev, CASE WHEN len(list_filter(f.tied, lambda x: x.seq = q.seq)) > 0 THEN 'unchanged' WHEN cur = q.amount THEN 'linked' WHEN cur IS NOT NULL AND (tier = 3 OR (tier = 2 AND list_contains(ks, q.k))) THEN 'revised' WHEN cur IS NOT NULL THEN 'conflict'
    WHEN tier <= 2 THEN 'conflict' WHEN tier IS NULL THEN 'inserted' ELSE 'revised' END AS action FROM f JOIN q ON q.code = f.code AND q.d = f.d AND q.rn = f.rn + 1) n),
h AS (SELECT b.code, b.d, b.seq, a.action AS first_action, a.said AS first_revision, b.action, CASE WHEN b.action = 'conflict' THEN 'amount_conflict' END AS issue, b.said AS revision FROM f b LEFT JOIN f a ON a.code = b.code AND a.d = b.d AND a.seq = b.seq AND a.run = 1 WHERE b.run = 2)
SELECT * FROM h UNION ALL SELECT code, d, seq, CASE WHEN batch = 1 THEN 'blocked' END, NULL, 'blocked', CASE state WHEN 'ambiguous' THEN 'ambiguous_scheme' ELSE 'unmapped_scheme' END, NULL FROM s WHERE state <> 'mapped'"""


def normalisation_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regulator's rows in two runs: linked rows are unchanged at their revision, later ones act on what the first run left."""
    rows, known = p.labelled_lines(spark, sf_dir).withColumn("batch", F.when(F.floor(F.col("seq") / 8) % 3 == 0, 2).otherwise(1)), p.known_options(spark, sf_dir)
    publish = lambda rows, events, links, _: publication.normalise(rows, known, events, links)
    out = two_runs(publish, identified(rows, "value", "scheme", "label"), spark.createDataFrame([], publication.EVENT), publication.REGULATOR)
    return out.select("code", "d", "seq", "gate", "first_action", "first_revision", "action", "revision")


NORMALISATION_RERUN_SQL = f"""WITH {p.GATED_SQL}, a AS (SELECT code, d, {identity_sql('value, scheme, label')} AS seq, value, gate, CASE WHEN (seq // 8) % 3 = 0 THEN 2 ELSE 1 END AS batch, known, gate = 'cash_amount_candidate' AS ok FROM gt),
m AS (SELECT *, known AND bool_or(ok) OVER e AND bool_or(NOT ok) OVER e AS mixed, known AND bool_or(ok AND batch = 1) OVER e AND bool_or(NOT ok AND batch = 1) OVER e AS mixed1 FROM a WINDOW e AS (PARTITION BY code, d)),
x1 AS (SELECT code, d, seq, value, lag(value) OVER o AS prior FROM m WHERE ok AND batch = 1 AND NOT mixed1 WINDOW o AS (PARTITION BY code, d ORDER BY seq)),
y1 AS (SELECT *, CASE WHEN prior IS NULL THEN 'inserted' WHEN prior = value THEN 'unchanged' ELSE 'revised' END AS act FROM x1), z1 AS (SELECT *, count(*) FILTER (WHERE act <> 'unchanged') OVER (PARTITION BY code, d ORDER BY seq) AS rev FROM y1),
l1 AS (SELECT code, d, max(rev) AS rev FROM z1 GROUP BY ALL),
x2 AS (SELECT code, d, seq, batch, value, lag(value) OVER o AS prior FROM m WHERE ok AND NOT mixed WINDOW o AS (PARTITION BY code, d ORDER BY batch, seq)),
y2 AS (SELECT *, CASE WHEN prior IS NULL THEN 'inserted' WHEN prior = value THEN 'unchanged' ELSE 'revised' END AS act FROM x2), z2 AS (SELECT *, count(*) FILTER (WHERE act <> 'unchanged') OVER (PARTITION BY code, d ORDER BY batch, seq) AS rev FROM y2)
SELECT m.code, m.d, m.seq, gate, CASE WHEN batch = 2 THEN NULL WHEN mixed1 THEN 'refused' WHEN NOT ok THEN 'blocked' ELSE z1.act END AS first_action, CASE WHEN batch = 1 THEN coalesce(z1.rev, 0) END AS first_revision,
  CASE WHEN mixed THEN 'refused' WHEN NOT ok THEN 'blocked' WHEN batch = 1 THEN 'unchanged' ELSE z2.act END AS action, coalesce(CASE WHEN mixed THEN z1.rev ELSE z2.rev END, CASE WHEN mixed THEN l1.rev END, 0) AS revision
FROM (SELECT code, d, seq, gate, batch, ok, mixed, mixed1 FROM m) m LEFT JOIN z1 ON z1.code = m.code AND z1.d = m.d AND z1.seq = m.seq LEFT JOIN (SELECT code, d, seq, act, rev FROM z2) z2 ON z2.code = m.code AND z2.d = m.d AND z2.seq = m.seq LEFT JOIN l1 ON l1.code = m.code AND l1.d = m.d"""


def third_party_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third party's rows in two runs: what is linked is unchanged, what has an issue under its review is skipped."""
    out = two_runs(publication.publish_third_party, identified(p.third_party_rows(spark, sf_dir), "amount"), p.events_before(spark, sf_dir), publication.THIRD_PARTY)
    return out.select("code", "d", "seq", "first_action", "first_revision", "action", "issue", "revision")


THIRD_RERUN_SQL = f"""WITH {p.EVENTS_SQL}, s0 AS (SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_orderkey * 8 + l_linenumber AS seq, floor(l_discount * 40) / 100 AS amount, CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 1 END AS batch FROM lineitem WHERE l_returnflag = 'N'),
s AS (SELECT * REPLACE ({identity_sql('amount')} AS seq) FROM s0),
g AS (SELECT code, d, batch, count(DISTINCT amount) AS kinds, min(amount) AS own FROM s GROUP BY ALL),
a AS (SELECT g.*, ev.code IS NOT NULL AS there, ev.amount AS was, tier, coalesce(revision, 0) AS rev, CASE WHEN kinds > 1 THEN 'same_priority_conflict' WHEN ev.amount <> own AND tier < 3 THEN 'higher_priority_conflict' WHEN ev.amount <> own OR (ev.code IS NOT NULL AND ev.amount IS NULL) THEN 'same_priority_conflict' END AS issue FROM g LEFT JOIN ev ON ev.code = g.code AND ev.d = g.d WHERE batch = 1),
e2 AS (SELECT coalesce(a.code, ev.code) AS code, coalesce(a.d, ev.d) AS d, CASE WHEN a.code IS NULL THEN ev.amount WHEN issue IS NULL AND NOT there THEN own WHEN kinds = 1 AND was <> own AND a.tier = 3 THEN NULL ELSE was END AS amount, coalesce(a.tier, ev.tier, 3) AS tier, CASE WHEN a.code IS NULL THEN ev.revision WHEN issue IS NULL AND NOT there THEN 1 ELSE rev END AS rev
  FROM a FULL JOIN ev ON ev.code = a.code AND ev.d = a.d WHERE ev.code IS NOT NULL OR a.issue IS NULL),
b AS (SELECT g.*, e2.code IS NOT NULL AS there, coalesce(e2.rev, 0) AS rev, CASE WHEN kinds > 1 THEN 'same_priority_conflict' WHEN e2.amount <> own AND tier < 3 THEN 'higher_priority_conflict' WHEN e2.amount <> own OR (e2.code IS NOT NULL AND e2.amount IS NULL) THEN 'same_priority_conflict' END AS issue FROM g LEFT JOIN e2 ON e2.code = g.code AND e2.d = g.d WHERE batch = 2)
SELECT s.code, s.d, seq, CASE WHEN a.issue IS NOT NULL THEN 'blocked' WHEN a.there THEN 'linked' ELSE 'inserted' END AS first_action, CAST(a.rev + CASE WHEN a.issue IS NULL AND NOT a.there THEN 1 ELSE 0 END AS BIGINT) AS first_revision, CASE WHEN a.issue IS NULL THEN 'unchanged' ELSE 'skipped' END AS action, CAST(NULL AS VARCHAR) AS issue,
  CASE WHEN a.issue IS NULL THEN CAST(a.rev + CASE WHEN NOT a.there THEN 1 ELSE 0 END AS BIGINT) END AS revision FROM s JOIN a ON a.code = s.code AND a.d = s.d WHERE s.batch = 1
UNION ALL SELECT s.code, s.d, seq, NULL, NULL, CASE WHEN b.issue IS NOT NULL THEN 'blocked' WHEN b.there THEN 'linked' ELSE 'inserted' END, b.issue, CAST(b.rev + CASE WHEN b.issue IS NULL AND NOT b.there THEN 1 ELSE 0 END AS BIGINT) FROM s JOIN b ON b.code = s.code AND b.d = s.d WHERE s.batch = 2"""

QUERIES = {
    "registrar_rerun": (registrar_rerun, REGISTRAR_RERUN_SQL),
    "normalisation_rerun": (normalisation_rerun, NORMALISATION_RERUN_SQL),
    "third_party_rerun": (third_party_rerun, THIRD_RERUN_SQL),
}
