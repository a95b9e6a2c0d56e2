"""Incremental capture: files arrive, batches merge into current values, late corrections stay.

A batch is merged by the plan of the batch operators. Rows are told apart by a signature of their
content, not by time, so a correction that comes late is a revision and a repeated row is nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import revisions

OBSERVATION = "code long, d date, v double, seq long"


def signed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("signature", text.row_hash(F.col("code"), F.col("d"), F.col("v"), F.col("seq")))


STORED = f"{OBSERVATION}, signature string, month date"


def stored_rows(spark: SparkSession, store: str) -> DataFrame | None:
    """The store's rows, or None before the first batch."""
    try:
        return spark.read.schema(STORED).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_batch(batch: DataFrame, store: str) -> None:
    """Append the batch's rows whose signature the store lacks; a second run of a batch appends nothing.

    The store is partitioned by month, and only the months that the batch names are read.
    """
    rows = signed(batch).withColumn("month", F.trunc("d", "MM")).persist()
    stored = stored_rows(batch.sparkSession, store)
    if stored is None:
        new = rows.dropDuplicates(["signature"])
    else:
        months = [r.month for r in rows.select("month").distinct().collect()]  # a value for each month of the batch
        new = revisions.append_new(stored.where(F.col("month").isin(months)), rows, "signature")
    new.write.mode("append").partitionBy("month").parquet(store)
    rows.unpersist()


def current_values(spark: SparkSession, store: str) -> DataFrame:
    """The latest revision of each (code, d) that is positive."""
    rows = spark.read.schema(STORED).parquet(store).where("v > 0")
    return rows.groupBy("code", "d").agg(F.max_by("v", F.struct("seq", "signature")).alias("v"), F.count("*").alias("revisions"))


def run_available(spark: SparkSession, landing: str, store: str, checkpoint: str) -> StreamingQuery:
    """Take what has landed as JSON lines into the store, in batches, and stop."""
    stream = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", 1).json(landing)
    query = stream.writeStream.foreachBatch(lambda batch, _: append_batch(batch, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def re_read_from(last_day: F.Column, overlap: int = 7) -> F.Column:
    """The first day to ask for again after a checkpoint: corrections come within the overlap."""
    return F.date_sub(last_day, overlap)


def plan_runs(checkpoints: DataFrame, universe: DataFrame, issues: DataFrame) -> DataFrame:
    """code and mode of what to fetch: new codes in full, codes with open issues again, the rest from the overlap on."""
    known = universe.join(checkpoints, "code", "left").join(issues.select("code").distinct().withColumn("open", F.lit(1)), "code", "left")
    mode = F.when(F.col("last_day").isNull(), "full").when(F.col("open").isNotNull(), "retry").otherwise("overlap")
    return known.select("code", mode.alias("mode"), F.when(F.col("last_day").isNotNull(), re_read_from(F.col("last_day"))).alias("from_day"))
