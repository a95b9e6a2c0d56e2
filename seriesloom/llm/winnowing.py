"""Document fingerprints by winnowing, with built-in column functions alone.

A text's words (runs without white space) give hashes of K neighbouring words, each taken afresh, since
built-in functions carry no state from one place to the next; of each WINDOW
neighbouring hashes the smallest is chosen, the rightmost of equals, with its position. Two texts
that share any run of WINDOW + K - 1 words therefore share a chosen hash, and the positions say where.
Choosing costs one pass: a number that joins the hash's upper bits with the inverted position has
its minimum where the rule wants it.

Cases: a null text is empty; a text without words has no hashes, one of fewer than K words has one,
of all its words; a text of fewer hashes than a window has one choice; equal texts have equal
fingerprints; two texts without hashes are alike (1.0), one without and one with are not (0.0); rows that
repeat an identifier follow each other in descending order of their texts, a null identifier after all
others; a table of one row is its own next; a very long text is fingerprinted whole, as one row; other columns are ignored; an empty table gives no rows.
Positions have 30 bits, more than the words that a string can have; ties are judged by the hashes' upper 33.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import partitions

K, WINDOW = 4, 4
POSITION_BITS = 30
LOWEST = -(1 << 63)


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with the column name: an array of struct<hash long, position int> of the text's chosen k-grams.

    Each step is a projection of its own, so that no array is computed twice.
    """
    words, grams, keys, picks = (f"__{name}_{x}" for x in ("words", "grams", "keys", "picks"))
    n = F.size(words)
    at = lambda array, i, j: F.get(F.col(array), i + F.lit(j))
    top = (1 << POSITION_BITS) - 1
    df = df.withColumn(words, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x09-\\x0D\\x20]+"), lambda w: w != ""))
    rolled = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[at(words, i, j) for j in range(k)]))
    few = F.array(F.xxhash64(F.concat_ws(" ", F.col(words)), n))
    df = df.withColumn(grams, F.when(n >= k, rolled).when(n > 0, few).otherwise(F.array().cast("array<bigint>")))
    key = lambda g, i: F.shiftleft(F.shiftrightunsigned(g, POSITION_BITS + 1), POSITION_BITS).bitwiseOR((F.lit(top) - i).cast("bigint"))
    df = df.withColumn(keys, F.transform(F.col(grams), key))
    m = F.size(keys)
    smallest = F.transform(F.sequence(F.lit(0), m - window), lambda i: F.least(*[at(keys, i, j) for j in range(window)]))
    df = df.withColumn(picks, F.when(m >= window, F.array_distinct(smallest)).when(m > 0, F.array(F.array_min(keys))).otherwise(F.array().cast("array<bigint>")))
    place = lambda v: (F.lit(top) - v.bitwiseAND(F.lit(top))).cast("int")
    out = F.transform(F.col(picks), lambda v: F.struct(F.get(F.col(grams), place(v)).alias("hash"), place(v).alias("position")))
    return df.withColumn(name, out).drop(words, grams, keys, picks)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hash sets."""
    x, y = a["hash"], b["hash"]
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def digest(fingerprint: Column) -> Column:
    """Hex digest of a fingerprint's hashes and positions."""
    return F.sha2(F.to_json(fingerprint), 256)


def bucket_of(key: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are at most key, by halving."""
    if not edges:
        return F.lit(0)
    array = F.array(*map(F.lit, edges)) if len(edges) < 2 else F.lit(edges)
    steps = range(len(edges).bit_length() - 1, -1, -1)
    sizes = F.array(*[F.lit(1 << s) for s in steps])
    return F.aggregate(sizes, F.lit(0), lambda low, size: low + F.when(F.get(array, low + size - 1) <= key, size).otherwise(0))


def with_next(docs: DataFrame, columns: list[str], prepare) -> DataFrame:
    """docs with next_<c> of the row that follows in descending doc_id (after the last: the first).

    Rows are dealt out once, by ranges of doc_id; the first row of the range below comes along as a
    helper. prepare adds columns after the exchange.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    n = 4 * partitions(spark)
    edges = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    edges = sorted({*edges})
    keyed = docs.withColumn("__key", key).withColumn("__bucket", bucket_of(F.col("__key"), edges))
    tops = {r[0]: r[1] for r in keyed.groupBy("__bucket").agg(F.max("__key")).collect()}  # a row for each range
    order = sorted(tops)
    below = [(tops[order[i - 1]], b) for i, b in enumerate(order)]
    if below:
        pairs = F.map_from_arrays(F.lit([t for t, _ in below]), F.lit([b for _, b in below]))
    else:
        pairs = F.create_map().cast("map<bigint,int>")
    helper = spark.range(1).select(F.explode(pairs).alias("__key", "__to"))
    others = docs.withColumn("__key", key).where(F.col("__key").isin([t for t, _ in below])).join(F.broadcast(helper), "__key")
    both = keyed.withColumn("__helper", F.lit(False)).unionByName(others.withColumnRenamed("__to", "__bucket").withColumn("__helper", F.lit(True)))
    held = prepare(both.repartition(partitions(spark), "__bucket"))
    along = Window.partitionBy("__bucket").orderBy("__helper", F.desc("__key"), F.desc("text"))
    for c in columns:
        held = held.withColumn(f"next_{c}", F.lead(c).over(along))
    return held.where(~F.col("__helper")).drop("__key", "__bucket", "__helper")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, digests of the text's and the edited text's fingerprints, their likeness, and both fingerprints.

    The edited text has the last third of the code points replaced by the beginning of the next
    document's, in descending doc_id.
    """
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_next(table, ["text", "fp"], lambda d: with_fingerprint(d, "text", "fp", k, window))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    df = with_fingerprint(df.drop("text", "next_text"), "edited", "edited_fp", k, window)
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("fp")).alias("fingerprint"),
        digest(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("fp.hash").alias("hashes"),
        F.col("fp.position").alias("positions"),
        F.col("edited_fp.hash").alias("edited_hashes"),
        F.col("edited_fp.position").alias("edited_positions"),
    )
