"""Versioned tables: alias revisions, review ledgers, run states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN_STATES = {"running": ("completed", "completed_with_issues", "failed"), "completed": (), "completed_with_issues": (), "failed": ()}


def versions(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows with revision, valid_from and valid_to: a row that repeats the one before it is no revision."""
    own = Window.partitionBy(key).orderBy(*order)
    state = F.struct(*columns)
    before = F.lag(state).over(own)
    changed = rows.withColumn("__new", before.isNull() | ~state.eqNullSafe(before)).where("__new").drop("__new")
    return changed.withColumns({"revision": F.row_number().over(own), "valid_from": F.col(order[0]), "valid_to": F.lead(order[0]).over(own)})


def checked_update(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """key and outcome of updates that name the version they change: applied, stale, unknown or created."""
    both = updates.join(current.select(key, F.col("revision").alias("__now")), key, "left")
    outcome = F.when(F.col("__now").isNull() & (F.col("expected") == 0), "created").when(F.col("__now").isNull(), "unknown").when(F.col("__now") == F.col("expected"), "applied").otherwise("stale")
    return both.select(key, outcome.alias("outcome"))


def shared_members(members: DataFrame, group: str, member: str) -> DataFrame:
    """Members that more than one group claims, with the groups in order."""
    return members.groupBy(member).agg(F.count_distinct(group).alias("groups"), F.array_join(F.sort_array(F.collect_set(F.col(group).cast("string"))), "|").alias("claimed_by")).where("groups > 1")


def next_state(now: str, wanted: str) -> str:
    """The run's next state; others than those allowed are errors."""
    if wanted not in RUN_STATES[now]:
        raise ValueError(f"a run cannot go from {now} to {wanted}")
    return wanted


def stale_runs(runs: DataFrame, now: str, hours: int = 6) -> DataFrame:
    """Runs that are said to run since before so many hours, as failed."""
    old = (F.col("state") == "running") & (F.col("started_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours"))
    return runs.withColumn("state", F.when(old, "failed").otherwise(F.col("state")))
