"""Aliases of classifications: who may change them, and what a batch of changes leaves.

The store is three tables. ALIAS rows carry a version; a MEMBER, a classification, belongs to one alias only; a
REVISION is a snapshot of name, state and members as a change left them, and is never changed. A change names
the version that it was made from: 0 makes a new alias. A batch has one change for each alias. Changes are judged
against the store as it was, and against each other: of several that claim one name of a
structure, or one member, the first by seq goes on and the others are refused, whatever becomes of the first. A
member that its alias gives up in the same batch is still taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

ALIAS = "alias string, name string, folded string, structure string, status string, version int"
MEMBER = "classification string, alias string"
REVISION = "alias string, version int, name string, folded string, structure string, status string, members array<string>, reason string"
CHANGE = "seq long, alias string, expected int, name string, structure string, status string, members array<string>, reason string"
LONGEST_NAME, MOST_MEMBERS, REASON = 100, 200, (3, 500)


def folded(name: Column) -> Column:
    return F.lower(text.collapsed(name))


def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """seq of the rows that are not the first of their keys."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    return rows.withColumn("__turn", turn).where("__turn > 1").select("seq").distinct()


def judged(changes: DataFrame, aliases: DataFrame, members: DataFrame, classifications: DataFrame) -> DataFrame:
    """changes with name collapsed, folded, outcome (created, updated or what forbids it); classifications has the active ones (classification, structure)."""
    c = changes.withColumns({"name": F.coalesce(text.collapsed(F.col("name")), F.lit("")), "reason": F.coalesce(text.collapsed(F.col("reason")), F.lit("")), "members": F.coalesce("members", F.array().cast("array<string>"))}).withColumn("folded", folded(F.col("name")))
    c = c.join(aliases.select("alias", F.col("version").alias("__version")), "alias", "left")
    named = aliases.select(F.col("alias").alias("__other"), "structure", "folded")
    taken = c.select("seq", "alias", "structure", "folded").join(named, ["structure", "folded"]).where("alias <> __other").select("seq").distinct().withColumn("__taken", F.lit(True))
    each = c.select("seq", "alias", "structure", F.explode("members").alias("classification"))
    known = classifications.select("classification", F.col("structure").alias("__theirs"))
    met = each.join(known, "classification", "left").join(members.select("classification", F.col("alias").alias("__holder")), "classification", "left")
    flags = met.groupBy("seq").agg(F.max(F.col("__theirs").isNull()).alias("__unknown"), F.max(F.coalesce(F.col("__theirs") != F.col("structure"), F.lit(False))).alias("__unlike"), F.max(F.coalesce(F.col("__holder") != F.col("alias"), F.lit(False))).alias("__held"))
    later = first_of(c.where("folded <> ''"), ["structure", "folded"]).unionByName(first_of(each.dropDuplicates(["seq", "classification"]), ["classification"])).unionByName(first_of(c, ["alias"])).distinct().withColumn("__later", F.lit(True))
    c = c.join(taken, "seq", "left").join(flags, "seq", "left").join(later, "seq", "left")
    yes = lambda f: F.coalesce(F.col(f), F.lit(False))
    n, active = F.size("members"), F.col("status") == "active"
    outcome = (
        F.when((F.length("reason") < REASON[0]) | (F.length("reason") > REASON[1]), "reason").when((F.col("expected") > 0) & F.col("__version").isNull(), "not_found").when(F.col("expected") != F.coalesce("__version", F.lit(0)), "stale")
        .when(F.col("name") == "", "blank_name").when(F.length("name") > LONGEST_NAME, "long_name").when(active & (n == 0), "no_members").when(~active & (n > 0), "members_of_inactive").when(n > MOST_MEMBERS, "too_many_members")
        .when(F.size(F.array_distinct("members")) < n, "repeated_members").when(yes("__taken"), "name_taken").when(yes("__unknown"), "unknown_members").when(yes("__unlike"), "other_structure").when(yes("__held"), "members_taken")
        .when(yes("__later"), "contested").when(F.col("expected") == 0, "created").otherwise("updated")
    )
    return c.withColumn("outcome", outcome).select(*changes.columns, "folded", "outcome")


def applied(told: DataFrame, aliases: DataFrame, members: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after judged changes."""
    good = told.where(F.col("outcome").isin("created", "updated")).withColumn("version", F.col("expected") + 1)
    new = good.select("alias", "name", "folded", "structure", "status", "version")
    left = aliases.join(new.select("alias"), "alias", "left_anti").select(*new.columns).unionByName(new)
    own = good.select(F.explode("members").alias("classification"), "alias")
    held = members.join(new.select("alias"), "alias", "left_anti").select("classification", "alias").unionByName(own)
    told_of = good.select("alias", "version", "name", "folded", "structure", "status", F.sort_array("members").alias("members"), "reason")
    return left, held, revisions.select(*told_of.columns).unionByName(told_of)


def seeded(classifications: DataFrame, seeds: DataFrame, names: DataFrame) -> DataFrame:
    """Changes that give every classification (classification, shown, structure) an alias: those of seeds (alias, name, structure, shown) together, each other one by itself.

    names (classification, name) has the names of single ones.
    """
    both = classifications.join(seeds.select("shown", F.col("alias").alias("__alias"), F.col("name").alias("__name"), F.col("structure").alias("__structure")), "shown", "left").join(names.select("classification", F.col("name").alias("__single")), "classification", "left")
    alone = F.concat(F.lit("single-"), F.col("classification"))
    rows = both.select("classification", F.coalesce("__alias", alone).alias("alias"), F.coalesce("__name", "__single").alias("name"), F.coalesce("__structure", "structure").alias("structure"), F.col("__alias").isNotNull().alias("__seed"))
    out = rows.groupBy("alias").agg(F.min("name").alias("name"), F.min("structure").alias("structure"), F.sort_array(F.collect_set("classification")).alias("members"), F.max("__seed").alias("__seed"))
    reason = F.when(F.col("__seed"), "From the table of seeds").otherwise("Made for one classification alone")
    return out.select(F.xxhash64("alias").alias("seq"), "alias", F.lit(0).alias("expected"), "name", "structure", F.lit("active").alias("status"), "members", reason.alias("reason"))


def listed(aliases: DataFrame, members: DataFrame, revisions: DataFrame, classifications: DataFrame) -> DataFrame:
    """alias, name, structure, status, version, sources (array of classification and shown, by shown) and revisions (array, the latest first)."""
    shown = members.join(classifications.select("classification", "shown"), "classification", "left").groupBy("alias").agg(F.sort_array(F.collect_list(F.struct("shown", "classification"))).alias("sources"))
    past = revisions.groupBy("alias").agg(F.sort_array(F.collect_list(F.struct("version", "name", "status", "members", "reason")), asc=False).alias("revisions"))
    return aliases.drop("folded").join(shown, "alias", "left").join(past, "alias", "left")
