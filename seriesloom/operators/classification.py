"""Classification labels as a table: canonical forms, identifiers, aliases with names of their own, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text

LONGEST = 100  # characters of an alias's name


def labelled(raw: DataFrame) -> DataFrame:
    """label, classification, shown, match, structure and product of each distinct raw label; blank ones have no classification."""
    c = F.col("label")
    return raw.select("label").where("label is not null").distinct().select(
        "label", text.label_id(c).alias("classification"), text.canonical_label(c).alias("shown"), text.label_match(c).alias("match"), text.structure_of(c).alias("structure"), text.product_of(c).alias("product")
    )


def definitions(found: DataFrame) -> DataFrame:
    """One row for each classification: shown, structure, product and the number of raw labels."""
    return found.where("classification is not null").groupBy("classification").agg(
        F.min("shown").alias("shown"), F.min("structure").alias("structure"), F.min("product").alias("product"), F.count("*").alias("labels")
    )


def fold(name: Column) -> Column:
    return F.lower(text.collapsed(name))


def alias_names(defined: DataFrame, taken: DataFrame) -> DataFrame:
    """classification and the name of an alias of its own, unlike those taken (structure, name) and each other within a structure.

    The leaf's short name comes first, the name in context where several leaves of the structure share
    it; what is taken gives way to the other one, then to the one in context with the identifier's end.
    Of classifications that want one name, the first by identifier has it.
    """
    cut = lambda c: F.rtrim(F.substring(c, 1, LONGEST))
    base, context = names.short_name(F.col("shown")), names.context_name(F.col("shown"))
    shared = F.count("*").over(Window.partitionBy("structure", fold(base))) > 1
    rows = defined.select("classification", "structure", context.alias("context"), F.when(shared, cut(context)).otherwise(cut(base)).alias("one"), F.when(shared, cut(base)).otherwise(cut(context)).alias("two"))
    gone = taken.select("structure", fold(F.col("name")).alias("key"), F.lit(True).alias("gone")).distinct()

    def settle(rows: DataFrame, want: str, gone: DataFrame) -> DataFrame:
        first = F.row_number().over(Window.partitionBy("structure", fold(F.col(want))).orderBy("classification")) == 1
        met = rows.withColumn("key", fold(F.col(want))).withColumn("first", first).join(gone, ["structure", "key"], "left")
        return met.withColumn("free", F.col("first") & F.col("gone").isNull()).drop("gone", "first")

    by_one = settle(rows, "one", gone)
    named = by_one.where("free")
    gone = gone.unionByName(named.select("structure", "key", F.lit(True).alias("gone")))
    by_two = settle(by_one.where("not free").drop("key", "free"), "two", gone)
    ending = F.concat(F.lit(" ["), F.substring("classification", -8, 8), F.lit("]"))
    last = F.concat(F.rtrim(F.substring("context", 1, LONGEST - 11)), ending)
    return named.select("classification", "structure", F.col("one").alias("name")).unionByName(by_two.select("classification", "structure", F.when(F.col("free"), F.col("two")).otherwise(last).alias("name")))


# What tells structures and kinds of assets apart, in the order in which they are looked for, and words that tell nothing.
STRUCTURE_MARKS = {"open_ended": "open ended", "close_ended": "close ended", "interval": "interval"}
ASSET_MARKS = {"equity": "equity", "debt": "debt", "hybrid": "hybrid", "solution_oriented": "solution oriented", "other": "other scheme"}
SAYS_NOTHING = ("open", "close", "ended", "scheme", "schemes", "fund", "funds", "oriented")


def first_mark(label: Column, marks: dict[str, str]) -> Column:
    low, out = F.lower(label), None
    for name, mark in marks.items():
        out = F.when(low.contains(mark), name) if out is None else out.when(low.contains(mark), name)
    return out


def compared(label: Column) -> Column:
    """A label's words that tell something, in order."""
    return F.array_join(F.filter(names.words(label), lambda w: ~w.isin(*SAYS_NOTHING)), " ")


def hard_conflict(a: Column, b: Column) -> Column:
    """Whether two labels name different structures or kinds of assets."""
    apart = [F.coalesce(first_mark(a, m) != first_mark(b, m), F.lit(False)) for m in (STRUCTURE_MARKS, ASSET_MARKS)]
    return apart[0] | apart[1]
