"""What to ask sources for: windows from checkpoints and covered days, and what an answer means for them.

A source's *coverage* is the days that it has answered for, as spans (source, start_day, end_day) that neither
touch nor overlap. Its *checkpoint* says how far it has got (source, completed_through, latest_found). All plans
are tables: thousands of sources are planned at once, and executors can take the requests from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from .intervals import islands

MOST_DAYS, OVERLAP, INDEX_DAYS = 90, 7, 365
COVERAGE = "source string, start_day date, end_day date"
CHECKPOINT = "source string, completed_through date, latest_found date"
# What an answer can be, and the issue and its severity that it leaves.
OUTCOMES = {"rows": (None, None), "empty": ("empty_source_period", "info"), "not_published": ("empty_trading_day", "info"), "missing": ("empty_trading_day", "info"), "transport": ("download_failure", "error")}


def windowed(spans: DataFrame, most: int) -> DataFrame:
    """source, start_day, end_day of spans, cut into windows of at most so many days from their first."""
    each = F.explode(calendar.fixed_windows(F.col("start_day"), F.col("end_day"), most)).alias("w")
    return spans.where("start_day <= end_day").select("source", each).select("source", F.col("w.window_start").alias("start_day"), F.col("w.window_end").alias("end_day"))


def holes(sources: DataFrame, coverage: DataFrame, first: str, last: str) -> DataFrame:
    """source, start_day, end_day of the days from first to last that a source's coverage lacks."""
    lo, hi = calendar.date(first), calendar.date(last)
    inside = coverage.where((F.col("end_day") >= lo) & (F.col("start_day") <= hi)).select("source", "start_day", "end_day")
    ends = sources.select("source", F.explode(F.array(F.struct(F.date_sub(lo, 1).alias("start_day"), F.date_sub(lo, 1).alias("end_day")), F.struct(F.date_add(hi, 1).alias("start_day"), F.date_add(hi, 1).alias("end_day")))).alias("x")).select("source", "x.*")
    order = Window.partitionBy("source").orderBy("start_day", "end_day")
    reach = F.max("end_day").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = inside.join(sources, "source", "left_semi").unionByName(ends).withColumn("reach", reach).where("start_day > date_add(reach, 1)")
    return rows.select("source", F.date_add("reach", 1).alias("start_day"), F.date_sub("start_day", 1).alias("end_day"))


def requests(sources: DataFrame, coverage: DataFrame, checkpoints: DataFrame, mode: str, first: str, last: str, overlap: int = OVERLAP, most: int = MOST_DAYS) -> DataFrame:
    """source, start_day, end_day of what to ask the sources for.

    Mode full asks for the days that the coverage lacks. Mode incremental goes on from the checkpoint, but reads
    the last overlap days before it again, since corrections come late; without a checkpoint it begins with first.
    """
    if mode not in ("full", "incremental") or overlap < 0 or last < first:
        raise ValueError("mode is full or incremental, overlap not below 0, and last not before first")
    if mode == "full":
        return windowed(holes(sources, coverage, first, last), most)
    done = F.col("completed_through")
    resume = F.date_sub(done, overlap - 1) if overlap else F.date_add(done, 1)
    start = F.greatest(calendar.date(first), resume)  # a null is passed over
    return windowed(sources.join(checkpoints.select("source", "completed_through"), "source", "left").select("source", start.alias("start_day"), calendar.date(last).alias("end_day")), most)


def covered(coverage: DataFrame, done: DataFrame) -> DataFrame:
    """The coverage after the requests done (source, start_day, end_day)."""
    spans = coverage.select("source", "start_day", "end_day").unionByName(done.select("source", "start_day", "end_day"))
    return islands(spans, "source", "start_day", "end_day").select("source", "start_day", "end_day")


def advanced(checkpoints: DataFrame, done: DataFrame) -> DataFrame:
    """The checkpoints after the requests done (source, end_day, latest_found): neither day ever goes back."""
    new = done.select("source", F.col("end_day").alias("completed_through"), "latest_found")
    return checkpoints.select("source", "completed_through", "latest_found").unionByName(new).groupBy("source").agg(F.max("completed_through").alias("completed_through"), F.max("latest_found").alias("latest_found"))


def index_names(wanted: DataFrame, mappings: DataFrame) -> DataFrame:
    """name and trading_name of the wanted (name), found by display or trading name in any case; an unknown name fails the job."""
    asked = wanted.select(F.trim("name").alias("name")).where("name <> ''").distinct().withColumn("fold", F.lower("name"))
    rank = lambda c, i: mappings.select(F.lower(c).alias("fold"), F.lit(i).alias("rank"), "trading_name")
    known = rank("display_name", 0).unionByName(rank("trading_name", 1)).groupBy("fold").agg(F.min_by("trading_name", "rank").alias("trading_name"))
    found = asked.join(known, "fold", "left")
    unknown = F.raise_error(F.concat_ws(" ", F.lit("an index that the mapping does not have:"), "name"))
    return found.select("name", F.coalesce("trading_name", unknown).alias("trading_name"))


def told_apart(planned: DataFrame, checkpoints: DataFrame, mode: str) -> DataFrame:
    """planned with state: skipped where mode is full and a checkpoint (source, start_day) is there, else pending."""
    if mode not in ("full", "refresh"):
        raise ValueError("mode is full or refresh")
    if mode == "refresh":
        return planned.withColumn("state", F.lit("pending"))
    held = checkpoints.select("source", "start_day").distinct().withColumn("__held", F.lit(True))
    return planned.join(held, ["source", "start_day"], "left").withColumn("state", F.when(F.col("__held"), "skipped").otherwise("pending")).drop("__held")


def index_requests(indices: DataFrame, checkpoints: DataFrame, mode: str, first: str, last: str) -> DataFrame:
    """source (trading name and kind), start_day, end_day and state: prices and total returns of each index (trading_name) by the year."""
    kinds = F.explode(F.array(F.lit("price"), F.lit("total_return")))
    sources = indices.select("trading_name").distinct().select("trading_name", kinds.alias("kind")).select(F.concat_ws("|", "trading_name", "kind").alias("source"), calendar.date(first).alias("start_day"), calendar.date(last).alias("end_day"))
    return told_apart(windowed(sources, INDEX_DAYS), checkpoints, mode)


def daily_requests(sources: DataFrame, checkpoints: DataFrame, mode: str, first: str, last: str) -> DataFrame:
    """source, start_day, end_day, state and place of one file for each source and day, the latest day first."""
    days = F.explode(F.sequence(calendar.date(first), calendar.date(last)))
    planned = sources.select("source").distinct().select("source", days.alias("start_day")).withColumn("end_day", F.col("start_day"))
    return told_apart(planned, checkpoints, mode).withColumn("place", F.datediff(calendar.date(last), F.col("start_day")))


def family_requests(universe: DataFrame, checkpoints: DataFrame, open_issues: DataFrame, mode: str, retry: bool = False) -> DataFrame:
    """fund, family, name and state of the universe's families (fund, family, name).

    In mode full a family is skipped whose checkpoint has its present name, unless retry is set and it has open issues.
    """
    if mode not in ("full", "refresh"):
        raise ValueError("mode is full or refresh")
    key = ["fund", "family"]
    rows = universe.join(checkpoints.select(*key, F.col("name").alias("__then")), key, "left").join(open_issues.select(*key).distinct().withColumn("__open", F.lit(True)), key, "left")
    same = F.coalesce(F.col("__then") == F.col("name"), F.lit(False)) & F.lit(mode == "full")
    state = F.when(~same, "pending").when(F.lit(retry) & F.coalesce("__open", F.lit(False)), "retry").otherwise("skipped")
    return rows.select(*key, "name", state.alias("state"))


def contracted(requests: DataFrame, most: int = MOST_DAYS) -> DataFrame:
    """requests, of which any that the source would refuse fails the job: by (source, start_day, end_day), or (fund, family, year).

    Identifiers are digits, a window has 1 to most days, a year is All or four digits.
    """
    tests = []
    for c in ("source", "fund", "family"):
        if c in requests.columns:
            tests.append((~F.coalesce(F.col(c).rlike("^[0-9]+$"), F.lit(False)), f"{c} is not a number"))
    if "year" in requests.columns:
        tests.append((~F.coalesce(F.col("year").rlike("^(All|[0-9]{4})$"), F.lit(False)), "year is neither All nor four digits"))
    if "start_day" in requests.columns:
        days = F.datediff("end_day", "start_day") + 1
        tests.append((~F.coalesce(days.between(1, most), F.lit(False)), f"a window has 1 to {most} days"))
    told = requests.columns[0]
    checked = F.col(told)
    for wrong, what in tests:
        checked = F.when(wrong, F.raise_error(F.lit(what)).cast(requests.schema[told].dataType)).otherwise(checked)
    return requests.withColumn(told, checked)


def run_status(open_issues: Column) -> Column:
    """The status of a run that came to its end, by its number of open issues."""
    return F.when(open_issues > 0, "completed_with_issues").otherwise("completed")


def triaged(answers: DataFrame) -> DataFrame:
    """answers (source, start_day, end_day, outcome, rows) with issue, severity, completed, failed and checkpointed.

    What is not published leaves an issue for information and no checkpoint, so that it is asked for
    again; so does a failure of transport, as an error. An empty period has its checkpoint. What
    cannot be parsed fails the job.
    """
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in OUTCOMES.items() for x in (k, v[i])])
    known = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("an answer that cannot be parsed:"), "source", "start_day", "outcome")))
    return answers.withColumn("outcome", known).withColumns({
        "issue": F.element_at(pick(0), F.col("outcome")), "severity": F.element_at(pick(1), F.col("outcome")), "completed": F.col("outcome") != "transport", "failed": F.col("outcome") == "transport",
        "checkpointed": F.col("outcome").isin("rows", "empty"),
    })
