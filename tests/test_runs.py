"""Runs: payloads before rows, counters from what is written, nothing of a failed run read."""

import pytest
from pyspark.sql import functions as F

from seriesloom.streaming import runs

FILES = "batch string, source string, source_url string, parameters map<string,string>, payload string"


def lines(files):
    """code and v of lines code:v; a line without a colon is an error."""
    rows = files.select("source", F.posexplode(F.split("payload", "\n")).alias("position", "line")).where("line <> ''")
    parts = F.split("line", ":")
    good = F.size(parts) == 2
    return rows.select("source", "position", F.when(good, parts[0]).alias("code"), F.when(good, F.get(parts, F.lit(1)).cast("double")).alias("v"), F.when(~good, "columns").alias("error"))


def files(spark, *payloads):
    return spark.createDataFrame([(f"b{i}", "feed", f"https://x/{i}", {"day": str(i)}, p) for i, p in enumerate(payloads)], FILES)


def test_payloads_are_kept_and_rows_counted(spark, tmp_path):
    ledger = runs.Ledger(spark, str(tmp_path / "ledger"))
    with ledger.run("feed") as run:
        stored = runs.captured(run, files(spark, "a:1\nb:2", "c:3\nbroken", "a:1\nb:2", ""), "lines-v1")
        runs.validated(run, stored, lines, "values")
    assert run.counters == {"payloads": 3, "batches": 4, "batches_failed": 1, "rows_received": 6, "rows_accepted": 4, "rows_rejected": 2}
    done = ledger.runs().first()
    assert (done.kind, done.state, done.counters["rows_accepted"], done.error) == ("feed", "completed_with_issues", 4, None) and done.ended >= done.began
    found = {r.batch: (r.state, r.received, r.accepted, r.rejected, r.error) for r in runs.batches(ledger).collect()}
    assert found == {"b0": ("completed", 2, 2, 0, None), "b1": ("failed", 2, 0, 2, "columns"), "b2": ("completed", 2, 2, 0, None), "b3": ("completed", 0, 0, 0, None)}
    values = ledger.read("values", "batch string, position int, code string, v double")
    assert sorted((r.batch, r.code, r.v) for r in values.collect()) == [("b0", "a", 1.0), ("b0", "b", 2.0), ("b2", "a", 1.0), ("b2", "b", 2.0)]
    with ledger.run("feed") as run:
        stored = runs.captured(run, files(spark, "a:1\nb:2", "c:3\nbroken"), "lines-v2")
        runs.validated(run, stored, lines, "values", strict=False)
    assert run.counters["payloads"] == 0 and run.counters["rows_accepted"] == 3 and run.counters["rows_rejected"] == 1
    assert {r.reused for r in runs.batches(ledger).where(f"run = '{run.name}'").collect()} == {True}
    assert ledger.runs().count() == 2 and values.sparkSession is spark


def test_a_failed_run_leaves_payloads_but_no_rows(spark, tmp_path):
    ledger = runs.Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(RuntimeError, match="stop"), ledger.run("feed") as run:
        runs.validated(run, runs.captured(run, files(spark, "a:1"), "p"), lines, "values")
        raise RuntimeError("stop")
    told = ledger.runs().first()
    assert (told.state, told.error) == ("failed", "RuntimeError: stop")
    assert ledger.read("values", "code string, v double").count() == 0 == ledger.read("nothing", "x int").count()
    assert ledger.stored("values", "code string, v double").count() == 1 and ledger.stored("payloads", runs.PAYLOAD).count() == 1
    with ledger.run("feed") as run:
        runs.validated(run, runs.captured(run, files(spark, "a:1"), "p"), lines, "values")
    assert run.counters["payloads"] == 0 and ledger.read("values", "code string, v double").count() == 1


def test_an_abandoned_run_is_failed_by_the_next(spark, tmp_path):
    from datetime import UTC, datetime

    ledger = runs.Ledger(spark, str(tmp_path / "ledger"))
    dead = runs.Run(ledger, "feed")
    ledger.note(dead, "running", datetime.now(UTC))
    with ledger.run("feed"):
        pass
    assert {r.run == dead.name: r.state for r in ledger.runs().collect()} == {True: "failed", False: "completed"}
    assert ledger.runs().where(F.col("run") == dead.name).first().error.startswith("left running")


def test_publication_with_a_ledger_twice(spark, tmp_path):
    from datetime import date

    from seriesloom.operators import publication

    ledger = runs.Ledger(spark, str(tmp_path / "ledger"))
    day = date(2020, 1, 1)
    rows = spark.createDataFrame([(1, day, 1, 1.0), (1, day, 2, 2.0), (2, day, 3, 5.0)], "code long, d date, seq long, amount double").withColumns({"state": F.lit("mapped"), "capture": F.lit("k"), "raw": F.col("amount").cast("string")})
    for _ in range(3):
        with ledger.run("registrar") as run:
            events = ledger.latest("events", publication.EVENT, ["code", "d"])
            links = ledger.read("links", publication.LINK).drop("run")
            done = publication.publish_registrar(rows, events, links)
            run.write("published", done, {a: F.count_if(F.col("action") == a) for a in ("inserted", "conflict", "unchanged")})
            mine = spark.read.parquet(ledger.path("published", run.name))
            run.write("links", publication.new_links(mine, publication.REGISTRAR))
            run.write("events", publication.after(events, mine))
    told = [r.counters for r in ledger.runs().orderBy("run").collect()]
    assert told == [{"inserted": 2, "conflict": 1, "unchanged": 0}] + [{"inserted": 0, "conflict": 1, "unchanged": 2}] * 2
    assert {r.code: (r.amount, r.revision) for r in ledger.latest("events", publication.EVENT, ["code", "d"]).collect()} == {1: (None, 1), 2: (5.0, 1)}
    assert ledger.read("links", publication.LINK).count() == 2
