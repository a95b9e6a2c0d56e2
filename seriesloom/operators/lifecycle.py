"""What consecutive snapshots of a catalogue say about its families, and what their details add.

Memberships are (fund, snapshot, family, name), snapshot a number that rises with time; a fund's snapshots
may skip numbers, so neighbours are a fund's own. Disappearing is no proof of closure, nor a new
name of a day of renaming: both are issues, not events. A launch is an event of the day that a family's
details state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAMILY = ["fund", "family"]


def numbered(memberships: DataFrame, snapshots: DataFrame) -> DataFrame:
    """memberships with place, the number of the fund's snapshot among its own from 1, and last, how many it has; snapshots (fund, snapshot) has empty ones too."""
    own = Window.partitionBy("fund").orderBy("snapshot")
    places = snapshots.select("fund", "snapshot").distinct().withColumns({"place": F.row_number().over(own), "last": F.count("*").over(Window.partitionBy("fund"))})
    return memberships.join(places, ["fund", "snapshot"])


def changes(memberships: DataFrame, snapshots: DataFrame) -> DataFrame:
    """fund, family, place, change, old_name and name: added and renamed at the snapshot that shows it first, removed at the first that lacks it.

    A family of a fund's first snapshot is not added. One that comes back is added again; its new name, if
    it has one, is a renaming against the last name that was seen.
    """
    rows = numbered(memberships, snapshots)
    along = Window.partitionBy(*FAMILY).orderBy("place")
    seen = rows.withColumns({"before": F.lag("place").over(along), "old_name": F.lag("name").over(along), "after": F.lead("place").over(along)})
    back = F.col("before").isNull() | (F.col("before") < F.col("place") - 1)
    gone = (F.col("place") < F.col("last")) & (F.col("after").isNull() | (F.col("after") > F.col("place") + 1))
    item = lambda when, change, place, old, new: F.when(when, F.struct(F.lit(change).alias("change"), place.alias("at"), old.alias("was"), new.alias("now")))
    none = F.lit(None).cast("string")
    found = F.array(
        item(back & (F.col("place") > 1), "added", F.col("place"), none, F.col("name")), item(F.col("old_name") != F.col("name"), "renamed", F.col("place"), F.col("old_name"), F.col("name")), item(gone, "removed", F.col("place") + 1, F.col("name"), none)
    )
    return seen.select(*FAMILY, F.inline(F.array_compact(found))).select(*FAMILY, F.col("at").cast("int").alias("place"), "change", F.col("was").alias("old_name"), F.col("now").alias("name"))


def latest(memberships: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The families of each fund's latest snapshot."""
    return numbered(memberships, snapshots).where("place = last").select(*FAMILY, "name")


def issues(changed: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """fund, family, place and issue: removed members, and new names of families that have a checkpoint (fund, family)."""
    held = changed.join(checkpoints.select(*FAMILY).distinct().withColumn("__held", F.lit(True)), FAMILY, "left")
    issue = F.when(F.col("change") == "removed", "catalog_member_removed").when((F.col("change") == "renamed") & F.col("__held"), "name_changed_without_effective_date")
    return held.select(*FAMILY, "place", issue.alias("issue")).where("issue is not null")


def launches(details: DataFrame, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New launch events (fund, family, day, seq), and the issues (fund, family, seq, issue) of details (fund, family, asked_fund, asked_family, day, seq).

    Details that are not of the family which was asked for are a mismatch and say nothing. A null day is an
    issue each time. A day that is new beside other days of the family, of events or of details before it, is a conflict, and an event all the same.
    """
    right = F.col("fund").eqNullSafe(F.col("asked_fund")) & F.col("family").eqNullSafe(F.col("asked_family"))
    good = details.where(right & F.col("day").isNotNull()).groupBy(*FAMILY, "day").agg(F.min("seq").alias("seq"))
    if events is not None:
        known = events.groupBy(*FAMILY).agg(F.count("*").alias("__known"))
        good = good.join(events.select(*FAMILY, "day"), [*FAMILY, "day"], "left_anti").join(known, FAMILY, "left")
    else:
        good = good.withColumn("__known", F.lit(0))
    turn = F.row_number().over(Window.partitionBy(*FAMILY).orderBy("seq", "day"))
    new = good.withColumn("__turn", turn + F.coalesce("__known", F.lit(0)))
    wrong = details.select(F.col("asked_fund").alias("fund"), F.col("asked_family").alias("family"), "seq", F.when(~right, "identity_mismatch").when(F.col("day").isNull(), "missing_launch_date").alias("issue")).where("issue is not null")
    clash = new.where("__turn > 1").select(*FAMILY, "seq", F.lit("launch_date_conflict").alias("issue"))
    return new.select(*FAMILY, "day", "seq"), wrong.unionByName(clash)


def reconciled(counters: DataFrame) -> DataFrame:
    """counters of runs, unless they contradict each other: then the job fails.

    funds_completed + funds_failed <= funds_total; families completed, skipped and failed <= families_total; details received = inserted + unchanged + rejected.
    """
    c = lambda *names: sum((F.col(n) for n in names), F.lit(0))
    tests: list[tuple[Column, str]] = [
        (c("funds_completed", "funds_failed") > F.col("funds_total"), "more funds are done than were chosen"),
        (c("families_completed", "families_skipped", "families_failed") > F.col("families_total"), "more families are done than were found"),
        (F.col("details_received") != c("details_inserted", "details_unchanged", "details_rejected"), "the details received are not those accounted for"),
    ]
    checked = F.col("funds_total")
    for wrong, what in tests:
        checked = F.when(wrong, F.raise_error(F.lit(what)).cast("long")).otherwise(checked)
    return counters.withColumn("funds_total", checked)
