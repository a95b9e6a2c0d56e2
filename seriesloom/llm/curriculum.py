"""Mixing sources to target weights along a curriculum, with built-in column functions alone.

Every source has a weight schedule over the training run, from 0 to 1: knots (time, weight) with
straight lines between them. Its integral is the source's weight in the mix, from which its target
follows: sources share the words of the mix by weight, but none gets more than so many times its own
size, and what one cannot take is shared again by the others. A source's demand up to a time is the
integral of its schedule up to there; the document that begins at a given word of the source is due at
the time at which demand reaches that word, which is the inverse of a square for each straight piece.

Documents of a source stand in the order of a hash of identifier and size, repeats of the source after
one another, and are taken until the target is reached; the document there gives its first words only,
so that the words taken are the target, rounded down. Word offsets come from sums over ranges of the
hash within each source, then within a range: a source that holds most rows is as many ranges as
others together. Sources are numbered by ranges of their names. The table that is due is sorted by
ranges of time.

Cases: a null or empty text has size 0, takes nothing and is due at no time; a null source is a source
of its own, after all others; rows that repeat identifier, source and size are told apart by number
only and share what their order gives them; null identifiers are alike; texts of any length are counted
whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import checkpoint_dir, partitions

Schedule = tuple[tuple[float, float], ...]
SCHEDULES: tuple[Schedule, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))  # weights 5, 2, 1: early, even, late
SHARE, MOST = 1.5, 2  # words of the mix for each word there is; times that a document can come
WORD = "[^\\x20\\x09-\\x0D]+"
RANGE_ROWS, LEAST_RANGES, HASH_BITS = 20_000, 256, 24
SOURCE = ["missing", "source"]


def integral(schedule: Schedule) -> float:
    """The weight that a schedule comes to over the whole run."""
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule[:-1], schedule[1:], strict=True))


def checked(schedules: tuple[Schedule, ...]) -> tuple[Schedule, ...]:
    for s in schedules:
        times = [t for t, _ in s]
        if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times[:-1], times[1:], strict=True)) or min(w for _, w in s) < 0 or integral(s) <= 0:
            raise ValueError("a schedule has rising times from 0 to 1, no weight below 0 and some above")
    return schedules


def due(share: Column, schedule: Schedule) -> Column:
    """The time at which the demand of a schedule reaches this share of its whole."""
    whole, before, out = integral(schedule), 0.0, None
    for (t0, a), (t1, b) in zip(schedule[:-1], schedule[1:], strict=True):
        h, a, b = t1 - t0, a / whole, b / whole
        rest = share - before
        # a * x + (b - a) * x * x / (2 * h) = rest, in the form that stands a flat or a vanishing piece
        x = F.when(rest > 0, 2 * rest / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) * rest / h)))).otherwise(0.0)
        piece = t0 + F.least(F.lit(h), x)
        out = piece if out is None else F.when(share >= before, piece).otherwise(out)
        before += h * (a + b) / 2
    return out


def counted(docs: DataFrame, folder: str) -> DataFrame:
    """A stored table of doc_id, missing, source, size, rank (hash, as text) and copies of the distinct rows."""
    rows = docs.select("doc_id", F.col("source").isNull().alias("missing"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    once = rows.groupBy("doc_id", *SOURCE, "size").agg(F.count("*").alias("copies"))
    once.withColumn("rank", F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("size").cast("string")))).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def numbered(sources: DataFrame, folder: str) -> DataFrame:
    """sources with place, from 0: by code point, the missing one last."""
    order = [F.col(c) for c in SOURCE]
    spark = sources.sparkSession
    sources.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()).write.parquet(folder)
    stored = spark.read.parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    starts = stored.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return stored.join(starts, "part").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).drop("part", "start")


def targets(sources: DataFrame, folder: str, schedules: tuple[Schedule, ...], share: float, most: int) -> DataFrame:
    """sources (missing, source, source_size) with turn (of the schedules) and target: the shares by weight, none above most times its size."""
    turn = F.pmod("place", F.lit(len(schedules))).cast("int")
    weight = F.element_at(F.array(*[F.lit(integral(s)) for s in schedules]), turn + 1)
    table = numbered(sources, folder).select(*SOURCE, "source_size", turn.alias("turn"), weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    whole = table.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words = share * (whole.words or 0)
    level, free = words / (whole.weight or 1), whole.weight or 0
    while free:  # every pass caps at least one more weight's worth of sources, or ends
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        now = table.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if now.free == free or not now.free:
            level = level if now.free else float("inf")
            break
        level, free = (words - now.held) / now.free, now.free
    return table.select(*SOURCE, "source_size", "turn", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def placed(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rank and turns of every row: array of struct<position, repeat, words>, one for each time it comes.

    position is the time, from 0 to 1; repeat counts from 0.
    """
    schedules, spark = checked(schedules), docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/mix-{uuid.uuid4().hex}"
    base = counted(docs, f"{folder}/documents")
    ranges = LEAST_RANGES
    while ranges * RANGE_ROWS < base.count() and ranges < 1 << HASH_BITS:
        ranges *= 2
    base = base.withColumn("range", F.floor(F.conv(F.substring("rank", 1, HASH_BITS // 4), 16, 10).cast("long") * ranges / (1 << HASH_BITS)).cast("int"))
    words = F.col("size") * F.col("copies")
    base.groupBy(*SOURCE, "range").agg(F.sum(words).alias("words")).write.parquet(f"{folder}/ranges")
    sums = spark.read.parquet(f"{folder}/ranges")
    goal = targets(sums.groupBy(*SOURCE).agg(F.sum("words").alias("source_size")), f"{folder}/sources", schedules, share, most)
    goal.write.parquet(f"{folder}/targets")
    goal = spark.read.parquet(f"{folder}/targets")
    along = Window.partitionBy(*SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*SOURCE, "range", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("start")).join(goal, SOURCE)
    within = Window.partitionBy(*SOURCE, "range").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.join(starts, [*SOURCE, "range"]).withColumn("start", F.col("start") + F.coalesce(F.sum(words).over(within), F.lit(0)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    each = []
    for repeat in range(most):
        begin = F.col("start") + repeat * F.col("source_size")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begin))
        shared = begin / F.col("target")
        time = F.when(F.col("turn") == 0, due(shared, schedules[0]))
        for i, s in enumerate(schedules[1:], 1):
            time = time.when(F.col("turn") == i, due(shared, s))
        each.append(F.when(taken > 0, F.struct(time.alias("position"), F.lit(repeat).alias("repeat"), taken.cast("long").alias("words"))))
    source = F.when(~F.col("missing"), F.col("source")).alias("source")
    return rows.select("doc_id", source, "size", "source_size", "target", "rank", F.array_compact(F.array(*each)).alias("turns"))


def in_order(rows: DataFrame, position: Column) -> DataFrame:
    """rows by ranges of position, and in its order within each; what has none comes last, spread by rank."""
    order = [position.isNull(), position, F.col("rank")]
    return rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def schedule(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """position, doc_id, source, repeat and words of everything that the mix takes, in order of position."""
    rows = placed(docs, schedules, share, most).select("doc_id", "source", "rank", F.explode("turns").alias("t"))
    return in_order(rows.select("doc_id", "source", "rank", "t.*"), F.col("position")).select("position", "doc_id", "source", "repeat", "words")


def mix(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, first and last position of every document, in order of the first."""
    rows = placed(docs, schedules, share, most)
    taken = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["words"])
    told = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.get("turns", F.lit(0))["position"].alias("first_position"), F.when(F.size("turns") > 1, F.element_at("turns", -1)["position"]).alias("last_position"), "rank")
    return in_order(told, F.col("first_position")).drop("rank")
