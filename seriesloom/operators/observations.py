"""Publication of observed values: revisions with a quality, the links and issues of a batch, and statistics kept by deltas.

Current revisions are (code, d, v, status, revision); status is valid, or error for a value that is not positive, which is
stored and current like others. A batch has at most one row for each (code, d); its raw text is no
number where v is null, and such a row is an issue and nothing else.

Statistics are a row for each series: counts of current rows by status, bounds of the valid days, and bounds of
all days seen. A batch changes them by its actions. Only a series whose first or last valid day
the batch has taken away is counted again from its current rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENT = "code long, d date, v double, status string, revision int"
STATISTICS = "code long, valid long, error long, first_valid date, last_valid date, first_seen date, last_seen date"
ISIN = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
ISINS = ("payout_or_growth", "reinvestment")  # columns isin_<label> of a batch; it may have fewer


def publish(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's rows (code, d, v, ...) with status, action (invalid, unchanged, revised or inserted), revision, and was_status and was of the revision they met."""
    met = batch.join(current.select("code", "d", F.col("v").alias("was"), F.col("status").alias("was_status"), F.col("revision").alias("was_revision")), ["code", "d"], "left")
    status = F.when(F.col("v").isNull(), None).when(F.col("v") > 0, "valid").otherwise("error")
    met = met.withColumn("status", status)
    same = (F.col("was") == F.col("v")) & (F.col("was_status") == F.col("status"))
    action = F.when(F.col("v").isNull(), "invalid").when(F.col("was_status").isNull(), "inserted").when(same, "unchanged").otherwise("revised")
    revision = F.when(action == "invalid", None).otherwise(F.coalesce("was_revision", F.lit(0)) + F.when(action == "unchanged", 0).otherwise(1))
    return met.withColumns({"action": action, "revision": revision.cast("int")}).drop("was_revision")


def revised(current: DataFrame, published: DataFrame) -> DataFrame:
    """The current revisions that a published batch leaves."""
    new = published.where(F.col("action").isin("inserted", "revised")).select("code", "d", "v", "status", "revision")
    return current.join(new.select("code", "d"), ["code", "d"], "left_anti").select(*new.columns).unionByName(new)


def links(published: DataFrame, batch: str) -> DataFrame:
    """code, d, revision and batch of every row that stands behind a revision, old or new."""
    return published.where("action <> 'invalid'").select("code", "d", "revision", F.lit(batch).alias("batch"))


def issues(published: DataFrame) -> DataFrame:
    """code, d, issue, severity and detail: what is no number, not positive, or under an identifier of another form."""
    raw = F.col("raw") if "raw" in published.columns else F.col("v").cast("string")
    found = [F.when(F.col("action") == "invalid", F.struct(F.lit("INVALID_NAV_VALUE").alias("issue"), F.lit("error").alias("severity"), raw.alias("detail"))), F.when(F.col("status") == "error", F.struct(F.lit("NON_POSITIVE_NAV").alias("issue"), F.lit("error").alias("severity"), raw.alias("detail")))]
    for label in ISINS:
        if (c := f"isin_{label}") in published.columns:
            found.append(F.when(~F.col(c).rlike(ISIN), F.struct(F.lit(f"INVALID_ISIN_{label.upper()}").alias("issue"), F.lit("warning").alias("severity"), F.col(c).alias("detail"))))
    return published.select("code", "d", F.inline(F.array_compact(F.array(*found))))


def counters(published: DataFrame) -> list[Column]:
    """Aggregates over a published batch: rows received, inserted, unchanged, revised and quarantined, and its latest day of a number."""
    count = lambda name: F.count_if(F.col("action") == name).alias(name)
    held = F.count_if((F.col("action") == "invalid") | (F.col("status") == "error"))
    return [F.count("*").alias("received"), *map(count, ("inserted", "unchanged", "revised")), held.alias("quarantined"), F.max(F.when(F.col("action") != "invalid", F.col("d"))).alias("latest_day")]


def counted(current: DataFrame) -> DataFrame:
    """valid, error and the bounds of the valid days of each series, from all of its current rows."""
    good = F.col("status") == "valid"
    return current.groupBy("code").agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("error"), F.min(F.when(good, F.col("d"))).alias("first_valid"), F.max(F.when(good, F.col("d"))).alias("last_valid"))


def statistics_after(statistics: DataFrame, published: DataFrame, current: DataFrame) -> DataFrame:
    """The statistics that a published batch leaves; current has the revisions after it.

    Of current only the series are read whose bounding day has lost its valid value.
    """
    into = F.col("action").isin("inserted", "revised")
    good, was_good = F.col("status") == "valid", F.coalesce(F.col("was_status") == "valid", F.lit(False))
    was_bad = F.coalesce(F.col("was_status") == "error", F.lit(False))
    change = lambda now, before: F.sum(F.when(into, now.cast("int") - before.cast("int")).otherwise(0))
    lost = into & was_good & ~good
    delta = published.groupBy("code").agg(
        change(good, was_good).alias("more_valid"), change(~good, was_bad).alias("more_error"), F.min(F.when(into & good, F.col("d"))).alias("new_first"), F.max(F.when(into & good, F.col("d"))).alias("new_last"),
        F.min(F.when(lost, F.col("d"))).alias("lost_first"), F.max(F.when(lost, F.col("d"))).alias("lost_last"), F.min("d").alias("seen_first"), F.max("d").alias("seen_last"),
    )
    both = statistics.join(delta, "code", "full")
    out = both.select(
        "code", (F.coalesce("valid", F.lit(0)) + F.coalesce("more_valid", F.lit(0))).alias("valid"), (F.coalesce("error", F.lit(0)) + F.coalesce("more_error", F.lit(0))).alias("error"),
        F.least("first_valid", "new_first").alias("first_valid"), F.greatest("last_valid", "new_last").alias("last_valid"), F.least("first_seen", "seen_first").alias("first_seen"), F.greatest("last_seen", "seen_last").alias("last_seen"),
        F.coalesce((F.col("lost_first") == F.col("first_valid")) | (F.col("lost_last") == F.col("last_valid")), F.lit(False)).alias("again"),
    )
    touched = out.where("again").select("code")
    bounds = counted(current.join(touched, "code", "left_semi")).select("code", F.col("first_valid").alias("first_now"), F.col("last_valid").alias("last_now"))
    out = out.join(bounds, "code", "left")
    pick = lambda now, kept: F.when(F.col("again"), F.col(now)).otherwise(F.col(kept)).alias(kept)
    return out.select("code", "valid", "error", pick("first_now", "first_valid"), pick("last_now", "last_valid"), "first_seen", "last_seen")


def dataset(statistics: DataFrame) -> DataFrame:
    """One row over all series: options, current rows by status, and bounds of the valid days."""
    return statistics.agg(F.count("*").alias("options"), F.sum("valid").alias("valid"), F.sum("error").alias("error"), F.min("first_valid").alias("first_valid"), F.max("last_valid").alias("last_valid"))
