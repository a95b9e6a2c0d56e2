"""Likeness of short labels: shared words, and the longest matching blocks of their characters."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import text
from .classification import compared, hard_conflict

HALF_DIGIT = 5e-7  # scores are rounded to six places, so one that is less than the threshold by this can reach it


@pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def numbered_characters(label: Column) -> Column:
    """The characters of a label, each with how often it came before: as a set, what the label has of each."""
    chars = F.when(F.length(label) > 0, F.transform(F.sequence(F.lit(1), F.length(label)), lambda i: F.substring(label, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c)).cast("string")))


def proposals(labels: DataFrame, threshold: float = 0.82) -> DataFrame:
    """a, b, lexical, token and score of the distinct labels that are alike by words or by blocks, and not in hard conflict.

    Labels are compared by the words that tell something. Candidates are the pairs that share such a
    word, and those whose lengths and common characters, which matching blocks cannot exceed, let the
    block ratio reach the threshold. Two labels without such words are alike as blocks. Proposals change
    nothing by themselves.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    least = threshold - HALF_DIGIT
    kept = labels.select("label").where("label is not null").distinct().withColumn("x", compared(F.col("label")))
    words = kept.withColumn("t", F.array_distinct(F.filter(F.split("x", " "), lambda w: w != "")))
    each = words.select("label", "x", "t", F.explode("t").alias("w"))
    side = lambda df, s, *more: df.select(F.col("label").alias(s), F.col("x").alias(f"x{s}"), F.col("t").alias(f"t{s}"), *more)
    by_word = side(each, "a", "w").join(side(each, "b", "w"), "w").where("a < b").drop("w")
    long = words.withColumn("n", F.length("x")).withColumn("c", numbered_characters(F.col("x")))
    sizes = long.select("n").distinct()
    near = sizes.select(F.col("n").alias("na")).join(sizes.select(F.col("n").alias("nb")), 2 * F.least("na", "nb") >= least * (F.col("na") + F.col("nb")))  # lengths, not labels
    left, right = (side(long, s, F.col("n").alias(f"n{s}"), F.col("c").alias(f"c{s}")) for s in "ab")
    enough = 2 * F.size(F.array_intersect("ca", "cb")) >= least * (F.col("na") + F.col("nb"))
    by_block = left.join(near, "na").join(right, "nb").where((F.col("a") < F.col("b")) & enough).select(*by_word.columns)
    pairs = by_word.union(by_block).dropDuplicates(["a", "b"]).where(~hard_conflict(F.col("a"), F.col("b")))
    scored = pairs.withColumns({"lexical": block_ratio("xa", "xb"), "token": text.jaccard(F.col("ta"), F.col("tb"))}).where(F.greatest("lexical", "token") >= threshold)
    return scored.select("a", "b", *[F.round(c, 6).alias(c) for c in ("lexical", "token")], F.round(F.greatest("lexical", "token"), 6).alias("score"))
