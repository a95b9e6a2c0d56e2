"""Runs and their tables: payloads first, then what is read from them, counted while it is written.

A *ledger* is a folder of tables. A run appends to them under its own name and its rows count once the
run's own row says that it has completed, which is written last; what a run that failed has written stays
for inspection and is not read. So a run is all or nothing, and running it again is safe. One run of a
ledger goes at a time, as the scheduler's lock has it.

Its row has kind, state, begin and end, counters (name to number, from ``observe`` on the written tables, so that
nothing is computed twice for the sake of counting) and the error.

Cases: counters of a table without rows are 0 or null; a run without tables is a run; a run that was left
running is failed by the next one; payloads of one content are one artifact.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUN = "run string, kind string, state string, began timestamp, ended timestamp, counters map<string,long>, error string, turn long"
BATCH = "batch string, source string, source_url string, parameters map<string,string>, parser string, sha256 string, byte_size long, reused boolean, state string, received long, accepted long, rejected long, error string"
PAYLOAD = "sha256 string, byte_size long, payload binary"
ERROR_LENGTH = 4000


class Run:
    """A run under way: tables are written through it."""

    def __init__(self, ledger: Ledger, kind: str) -> None:
        self.ledger, self.kind, self.name = ledger, kind, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.counters: dict[str, int] = {}
        self.issues = 0

    def write(self, table: str, rows: DataFrame, counts: dict[str, Column] | None = None) -> None:
        """Append rows to the table; counts are aggregates over them, added to the run's counters."""
        seen = Observation(f"{table}-{uuid.uuid4().hex}")
        if counts:
            rows = rows.observe(seen, *[c.alias(name) for name, c in counts.items()])
        rows.write.mode("append").parquet(self.ledger.path(table, self.name))
        if counts:
            for name, n in seen.get.items():
                self.counters[name] = self.counters.get(name, 0) + int(n or 0)
        self.ledger.forget(table)

    def issue(self, n: int = 1) -> None:
        """Say that the run, if it completes, has done so with issues."""
        self.issues += n


class Ledger:
    """Tables under a folder, in the order of the runs that have written them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.known = spark, folder.rstrip("/"), {}

    def path(self, table: str, run: str = "") -> str:
        return f"{self.folder}/{table}" + (f"/run={run}" if run else "")

    def forget(self, table: str) -> None:
        self.known.pop(table, None)

    def stored(self, table: str, schema: str) -> DataFrame:
        """All rows of a table with the run that has written them, whatever became of it."""
        try:
            return self.spark.read.schema(f"{schema}, run string").option("basePath", self.path(table)).parquet(self.path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, run string")

    def runs(self) -> DataFrame:
        """The latest row of each run."""
        rows = self.stored("runs", RUN.replace("run string, ", "name string, ")).drop("run").withColumnRenamed("name", "run")
        return rows.groupBy("run").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "run"]), "turn").alias("x")).select("run", "x.*")

    def read(self, table: str, schema: str) -> DataFrame:
        """The rows of completed runs, with the run."""
        done = self.runs().where(F.col("state").isin("completed", "completed_with_issues")).select("run")
        return self.stored(table, schema).join(done, "run", "left_semi")

    def latest(self, table: str, schema: str, keys: list[str]) -> DataFrame:
        """The row of each key that the latest completed run has written."""
        rows = self.read(table, schema)
        rest = [c for c in rows.columns if c not in (*keys, "run")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "run").alias("x")).select(*keys, "x.*")

    def note(self, run: Run, state: str, began: datetime, error: str | None = None) -> None:
        """Write the run's row as it is now."""
        ended = None if state == "running" else datetime.now(UTC)
        row = [(run.name, run.kind, state, began, ended, run.counters, error and error[:ERROR_LENGTH], time.time_ns())]
        schema = RUN.replace("run string, ", "name string, ")
        self.spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(self.path("runs", run.name))

    def close_abandoned(self) -> int:
        """Fail the runs that are still said to run; how many there were."""
        left = self.runs().where("state = 'running'").select("run", "kind", "began").collect()  # as many as jobs that died since the last
        for r in left:
            run = Run(self, r.kind)
            run.name = r.run
            self.note(run, "failed", r.began, "left running: a later run has taken its place")
        return len(left)

    @contextmanager
    def run(self, kind: str) -> Iterator[Run]:
        """A run: completed at the end of the block, failed with what the block raises."""
        self.close_abandoned()
        run, began = Run(self, kind), datetime.now(UTC)
        self.note(run, "running", began)
        try:
            yield run
        except BaseException as e:
            self.note(run, "failed", began, f"{type(e).__name__}: {str(e) or 'stopped'}")
            raise
        self.note(run, "completed_with_issues" if run.issues else "completed", began)


def captured(run: Run, files: DataFrame, parser: str) -> DataFrame:
    """Store the payloads of files (batch, source, source_url, parameters, payload) before anybody reads them; the files, as stored, with sha256.

    A payload whose content an earlier run, completed or failed, has stored is not stored again, and its batch says reused.
    """
    ledger = run.ledger
    told = files.withColumns({"payload": F.col("payload").cast("binary")}).withColumns({"sha256": F.sha2("payload", 256), "byte_size": F.octet_length("payload").cast("long")})
    before = ledger.stored("payloads", PAYLOAD).select("sha256").distinct().withColumn("reused", F.lit(True))
    marked = told.join(before, "sha256", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    run.write("payloads", marked.where("not reused").dropDuplicates(["sha256"]).select("sha256", "byte_size", "payload"), {"payloads": F.count("*")})
    waiting = marked.select(
        "batch", "source", "source_url", "parameters", F.lit(parser).alias("parser"), "sha256", "byte_size", "reused", F.lit("running").alias("state"), *[F.lit(None).cast("long").alias(c) for c in ("received", "accepted", "rejected")],
        F.lit(None).cast("string").alias("error"),
    )
    run.write("batches", waiting, {"batches": F.count("*")})
    own = ledger.stored("batches", BATCH).where(F.col("run") == run.name)
    return own.drop("run").join(ledger.stored("payloads", PAYLOAD).dropDuplicates(["sha256"]).select("sha256", "payload"), "sha256")


def validated(run: Run, stored: DataFrame, read: Callable[[DataFrame], DataFrame], table: str, *, strict: bool = True) -> DataFrame:
    """Read stored payloads by read (source = batch, payload -> rows with source and error), write good rows to the table and rejected ones beside it, and complete the batches.

    With strict a batch that has a rejected row, or whose payload is an error as a whole (a row with position
    null), is failed and none of its rows count; otherwise the good rows of a batch count.
    """
    ledger = run.ledger
    rows = read(stored.select(F.col("batch").alias("source"), F.col("payload").cast("string").alias("payload")))
    run.write(f"{table}_read", rows)
    kept = [c for c in rows.columns if c != "source"]
    mine = ledger.spark.read.schema(rows.schema).parquet(ledger.path(f"{table}_read", run.name)).withColumnRenamed("source", "batch")
    bad = F.col("error").isNotNull()
    counts = mine.groupBy("batch").agg(F.count("*").alias("received"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"), F.min(F.when(bad, F.col("error"))).alias("error"))
    failed = F.lit(strict) & (F.coalesce("rejected", F.lit(0)) > 0)
    done = stored.drop("payload", "received", "accepted", "rejected", "error").join(counts, "batch", "left")
    done = done.select(
        "batch", "source", "source_url", "parameters", "parser", "sha256", "byte_size", "reused", F.when(failed, "failed").otherwise("completed").alias("state"), F.coalesce("received", F.lit(0)).alias("received"),
        F.when(failed, 0).otherwise(F.coalesce("accepted", F.lit(0))).alias("accepted"), F.when(failed, F.col("received")).otherwise(F.coalesce("rejected", F.lit(0))).alias("rejected"), F.when(failed, F.col("error")).alias("error"),
    )
    run.write("batches_done", done, {"batches_failed": F.count_if(F.col("state") == "failed"), "rows_received": F.sum("received"), "rows_accepted": F.sum("accepted"), "rows_rejected": F.sum("rejected")})
    states = ledger.stored("batches_done", BATCH).where(F.col("run") == run.name).select("batch", "state")
    good = mine.where(~bad).join(states.where("state = 'completed'").select("batch"), "batch", "left_semi").select("batch", *[c for c in kept if c != "error"])
    run.write(table, good)
    run.issue(run.counters["batches_failed"])
    return states


def batches(ledger: Ledger) -> DataFrame:
    """The latest state of every batch, the latest run's first; those of runs that never ended are running or failed as their run is."""
    runs = ledger.runs().select("run", F.col("state").alias("run_state"), F.col("began").alias("started"))
    begun = ledger.stored("batches", BATCH).select("run", "batch", "source", "source_url", "parser", "sha256", "reused")
    done = ledger.stored("batches_done", BATCH).select("run", "batch", "state", "received", "accepted", "rejected", "error")
    both = begun.join(done, ["run", "batch"], "left").join(runs, "run", "left")
    state = F.coalesce("state", F.when(F.col("run_state") == "running", "running").otherwise("failed"))
    return both.withColumn("state", state).drop("run_state").orderBy(F.desc("started"), "batch")
