"""One-off jobs that put stored revisions right, as tables in and tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .publication import REGISTRAR, THIRD_PARTY, too_old


def collapsed(revisions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """revisions (code, d, v, status, revision) and links (code, d, revision, batch, ...) without current revisions that only repeat the one before.

    The latest revisions of a day that have one value and status are one, the first of them, which takes
    over the links of the others, one for each batch (the earliest revision's). Changes further back stay.
    """
    down = Window.partitionBy("code", "d").orderBy(F.desc("revision"))
    up = down.rowsBetween(Window.unboundedPreceding, 0)
    last = F.first(F.struct("v", "status")).over(up)
    other = F.max((~F.struct("v", "status").eqNullSafe(last)).cast("int")).over(up)
    marked = revisions.withColumn("__tail", other == 0)
    first = F.min(F.when(F.col("__tail"), F.col("revision"))).over(Window.partitionBy("code", "d"))
    marked = marked.withColumn("__into", F.when(F.col("__tail"), first).otherwise(F.col("revision")))
    kept = marked.where(F.col("__into") == F.col("revision")).drop("__tail", "__into")
    moved = links.join(marked.select("code", "d", "revision", "__into"), ["code", "d", "revision"])
    rank = F.row_number().over(Window.partitionBy("code", "d", "__into", "batch").orderBy("revision"))
    moved = moved.withColumn("__k", rank).where("__k = 1").withColumn("revision", F.col("__into")).select(*links.columns)
    return kept, moved


def retracted(events: DataFrame, links: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events and links without those of days before the oldest plausible one, and the issues (source, seq, review, issue) of the rows behind them.

    reviews (seq, review) has the mapping of third parties' rows. A regulator's or fund house's row behind such an event fails the job.
    """
    old = links.where(too_old(F.col("d")))
    known = F.when(F.col("source").isin(REGISTRAR, THIRD_PARTY), F.col("source")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("an event of primary provenance is too old to be plausible:"), "code", "d")))
    told = old.withColumn("source", known).join(reviews.withColumn("source", F.lit(THIRD_PARTY)), ["source", "seq"], "left")
    issues = told.select("source", "seq", F.col("review").cast("string").alias("review"), F.lit("implausible_record_date").alias("issue"))
    return events.where(~too_old(F.col("d"))), links.where(~too_old(F.col("d"))), issues
