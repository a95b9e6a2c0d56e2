"""Append-only revisions: merges of new observations into current ones, and reconciliation of sources by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tiers of payout sources; the least number is the highest authority.
TIERS = {"regulator": 1, "fund_house": 1, "registrar": 2, "third_party": 3}
OLDEST_DAY = "1964-01-01"


def merge_actions(current: DataFrame, incoming: DataFrame, keys: list[str], value: str, *, lowest: float = 0.0) -> DataFrame:
    """keys, old, new, action of a full outer join: quarantined, inserted, revised, unchanged or absent.

    current and incoming have at most one row for each key. Values are compared as numbers.
    """
    old = current.select(*keys, F.col(value).alias("old"))
    new = incoming.select(*keys, F.col(value).alias("new"), F.lit(True).alias("__in"))
    action = (
        F.when(F.col("__in").isNull(), "absent")
        .when(F.col("new").isNull() | (F.col("new") <= lowest), "quarantined")
        .when(F.col("old").isNull(), "inserted")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("revised")
    )
    return old.join(new, keys, "full").withColumn("action", action).drop("__in")


def apply_actions(actions: DataFrame, keys: list[str]) -> DataFrame:
    """The current values after a merge: a quarantined one leaves the old value, if any."""
    kept = F.when(F.col("action").isin("inserted", "revised"), F.col("new")).otherwise(F.col("old"))
    return actions.withColumn("v", kept).where("v is not null").select(*keys, "v")


def append_new(stored: DataFrame, rows: DataFrame, signature: str) -> DataFrame:
    """The rows whose signature is not stored yet, one for each signature."""
    return rows.dropDuplicates([signature]).join(stored.select(signature), signature, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change of two snapshots: added, removed, renamed (any column differs) or same."""
    old = before.select(key, F.struct(*columns).alias("__old"))
    new = after.select(key, F.struct(*columns).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("renamed")
    return old.join(new, key, "full").select(key, change.alias("change"))


def snapshot_upsert(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The stored table after a snapshot: what it has is active with its new columns, what it lacks stays as it was, inactive."""
    old = stored.select(key, F.struct(*columns).alias("__old"))
    new = incoming.select(key, F.struct(*columns).alias("__new"))
    both = old.join(new, key, "full").withColumn("active", F.col("__new").isNotNull()).withColumn("__x", F.coalesce("__new", "__old"))
    return both.select(key, "__x.*", "active")


def option_bounds(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """code, first_day, last_day of the stored bounds and new rows (code, d) together."""
    every = stored.unionByName(rows.groupBy("code").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day")))
    return every.groupBy("code").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that comes last in the order."""
    top = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(top)).where("__n = 1").drop("__n")


def tier_of(source: str) -> F.Column:
    table = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return F.try_element_at(table, F.col(source))


def reconcile(rows: DataFrame) -> DataFrame:
    """What the rows (code, d, amount, tier, seq) of each event leave, in order of arrival: code, d, amount, tier, revision, state, events.

    A row of a higher tier replaces the amount; a lower one never does. Rows of the current tier that
    disagree retire the amount, and rows of that tier or lower stay blocked from then on; a higher tier
    settles the conflict. Days before the oldest plausible one leave no amount.

    A row counts while no higher tier has come. The rows of a tier that count agree with its first or do
    not, so an event is a step for each tier: its first row, its amount, and whether it stayed whole.
    """
    event = Window.partitionBy("code", "d")
    sure = F.col("d") >= F.lit(OLDEST_DAY).cast("date")
    so_far = event.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("__top", F.min("tier").over(so_far))
    before = F.lag("__top").over(event.orderBy("seq"))
    begins = before.isNull() | (before != F.col("__top"))
    told = told.withColumn("__begins", begins).withColumn("__first", F.last(F.when(F.col("__begins"), F.struct("amount")), ignorenulls=True).over(so_far)["amount"])
    told = told.withColumn("__n", F.count("*").over(event))  # last: the rows are sorted once, and this order serves it too
    steps = told.where(F.col("tier") == F.col("__top")).groupBy("code", "d", "tier").agg(F.min("seq").alias("s"), F.min_by("amount", "seq").alias("a"), F.max(F.col("amount") != F.col("__first")).alias("clash"), F.max("__n").alias("n"))
    along = event.orderBy("s")
    new = F.lag("a").over(along).isNull() | F.lag("clash").over(along) | (F.lag("a").over(along) != F.col("a"))
    last = steps.withColumn("new", new).groupBy("code", "d").agg(F.max_by(F.struct("a", "tier", "clash"), "s").alias("x"), F.count_if("new").cast("int").alias("revision"), F.max("n").alias("events"))
    state = F.when(~sure, "implausible_date").when(F.col("x.clash"), "conflict").otherwise("current")
    return last.select(
        "code", "d", F.when(state == "current", F.col("x.a")).alias("amount"), F.when(sure, F.col("x.tier")).alias("tier"), F.when(sure, F.col("revision")).otherwise(0).alias("revision"), state.alias("state"), "events"
    )


def quality_counts(issues: DataFrame, keys: list[str], observation: list[str], scheme: str, day: str) -> DataFrame:
    """Two-level counts: occurrences of each distinct observation first, then by the keys."""
    once = issues.groupBy(*keys, *observation).agg(F.count("*").alias("__n"))
    return once.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.sum("__n").alias("occurrences"), F.count_distinct(scheme).alias("schemes"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )


def identity_evidence(candidates: DataFrame, nav: DataFrame, *, least: int = 3, span: int = 30) -> DataFrame:
    """candidate, code, matches, conflicts, span_days, qualifies of (candidate, code, d, value) against nav.

    A candidate qualifies with enough exact matches over enough days and no conflict.
    """
    both = candidates.join(nav, ["code", "d"])
    same = F.col("value") == F.col("v")
    found = both.groupBy("candidate", "code").agg(
        F.count_if(same).alias("matches"), F.count_if(~same).alias("conflicts"), F.datediff(F.max(F.when(same, F.col("d"))), F.min(F.when(same, F.col("d")))).alias("span_days")
    )
    return found.withColumn("qualifies", (F.col("matches") >= least) & (F.col("conflicts") == 0) & (F.coalesce("span_days", F.lit(0)) >= span))


def mapping_state(evidence: DataFrame) -> DataFrame:
    """candidate, qualified, state: mapped with one qualifying code, ambiguous with more, else unresolved."""
    n = F.count_if(F.col("qualifies"))
    return evidence.groupBy("candidate").agg(n.alias("qualified"), F.when(n == 1, "mapped").when(n > 1, "ambiguous").otherwise("unresolved").alias("state"), F.when(n == 1, F.max(F.when(F.col("qualifies"), F.col("code")))).alias("code"))


def merged_coverage(*sources: DataFrame) -> DataFrame:
    """code, n, first_day, last_day, sources over tables of (code, d) from several sources."""
    parts = [s.groupBy("code").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("code").agg(F.sum("n").alias("n"), F.min("lo").alias("first_day"), F.max("hi").alias("last_day"), F.count("source").alias("sources"))
