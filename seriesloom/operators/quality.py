"""The parts of the quality report that name what has to be looked at: labels, identifiers, runs and batches under way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The gates whose rows a person has to review, and the states of such a review.
REVIEWED_GATES = ("explicit_bonus_option", "explicit_growth_or_cumulative_option", "ambiguous_bonus_or_distribution_option", "conflicting_option_labels", "unknown_option_label")
REVIEW_STATES = ("unreviewed", "source_only", "mapped", "source_error")


def texts(column: str) -> F.Column:
    return F.sort_array(F.collect_set(column))


def label_review_items(gated: DataFrame) -> DataFrame:
    """classification, code, records, schemes and labels (sorted arrays) of gated rows (code, kind, gate, scheme, label) that wait for a review."""
    return gated.where(F.col("gate").isin(*REVIEWED_GATES)).groupBy(F.col("kind").alias("classification"), "code").agg(F.count("*").alias("records"), texts("scheme").alias("schemes"), texts("label").alias("labels"))


def unresolved_identifiers(rows: DataFrame, known: DataFrame, reviews: DataFrame) -> DataFrame:
    """The codes of rows (code, fund, scheme_code, scheme, label, d) that no option has: records, what they are called, first and last day, and the latest review.

    reviews is (code, reviewed_at, id, status, evidence, matched); a code without any is unreviewed, its review null.
    """
    latest = reviews.groupBy("code").agg(F.max_by(F.struct("status", F.col("id").alias("review"), "evidence", "matched"), F.struct("reviewed_at", "id")).alias("r"))
    lost = rows.join(known.select("code").distinct(), "code", "left_anti")
    found = lost.groupBy("code").agg(F.count("*").alias("records"), texts("fund").alias("funds"), texts("scheme_code").alias("scheme_codes"), texts("scheme").alias("schemes"), texts("label").alias("labels"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    return found.join(latest, "code", "left").select(*found.columns, F.col("r.status").alias("status"), F.col("r.review").alias("review"), F.col("r.evidence").alias("evidence"), F.col("r.matched").alias("matched"))


def review_counts(unresolved: DataFrame) -> DataFrame:
    """item and n of the unresolved identifiers by the state of their review; states without any too."""
    every = unresolved.sparkSession.createDataFrame([(s,) for s in REVIEW_STATES], "item string")
    return every.join(unresolved.groupBy(F.coalesce("status", F.lit("unreviewed")).alias("item")).agg(F.count("*").alias("n")), "item", "left").fillna(0, ["n"])


def latest_payout_options(options: DataFrame, nav: DataFrame, metadata: DataFrame) -> DataFrame:
    """code and version of the options (code, last_day) whose value of their last day (code, d, version) is under metadata (version, option) of a payout option."""
    return options.join(nav, (options["code"] == nav["code"]) & (options["last_day"] == nav["d"])).select(options["code"], nav["version"]).join(metadata.where("option = 'idcw'").select("version"), "version").select("code", "version")


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that began last (run, began, ...), one row or none."""
    return runs.orderBy(F.desc("began"), F.desc("run")).limit(1)


def running_batches(batches: DataFrame) -> DataFrame:
    """Batches under way, the oldest first."""
    return batches.where("state = 'running'").orderBy("started", "batch")
