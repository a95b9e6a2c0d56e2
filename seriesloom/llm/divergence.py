"""How sources of a language differ in their words: an audit over all pairs, by tiles of groups.

A group is a (lang, source). Each language keeps the terms that enough of its documents have, V of them;
over these a group with N occurrences gives a term that it has n times the share
p = 1 + SCALE * (n + 1) div (N + V), in whole numbers, and so does the language with its own counts. The
divergence of p from q is (p - q) * (p - q) div q, summed over all kept terms for two groups, and taken
by the term for a group and its language.

Groups of a language fall into blocks, kept terms into chunks of the vocabulary. A group's counts in a chunk are one
packed vector (columns and counts, absent terms being zero). Vectors are sent to every tile of two
blocks that theirs is one of, where a task reads them chunk after chunk and adds each pair's divergence,
for both directions, to the tile's submatrix; a tile of a large vocabulary is several stripes of
chunks, whose sums Spark adds up. A task holds one chunk's counts of two blocks.

Terms are counted by each task for itself, in tables of bounded size, before they move, so that neither a frequent
term nor a large source meets in one task. All counts, shares and sums are exact (64-bit integers, long
division where a product would not fit).

Cases: null text, lang and source count as ''; a group without kept terms takes part with zero counts;
V = 0 gives pairs of value 0 and no terms; texts of any length are read whole; rows that repeat count again; null
or repeated identifiers do not matter; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import checkpoint_dir, partitions, tidy

LEAST_DOCS, MOST_TERMS = 3, 200
SCALE_STEP, SCALE_STEPS = 1000, 3  # SCALE = 1000 ** 3, reached by long division
BLOCK, CHUNK_ROWS, STRIPE = 32, 100_000, 8  # groups of a block, counts of a chunk, chunks of a stripe
HELD, COLUMNS = 200_000, 1024  # terms that a task counts before it sends them, columns of a dense step

TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 97 <= b <= 122 or 65 <= b <= 90 or b >= 128 else 32 for b in range(256))
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PAIR = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
PAIR_TYPES = "lang string, source string, item string, value long"


def count_terms(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of (lang, source, text), so far as one table holds them; each group also has a row of the term ''."""
    groups: dict[tuple[str, str], tuple[dict[bytes, int], dict[bytes, int]]] = {}
    held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                columns = [[lang] * len(part), [source] * len(part), [t.decode() for t in part], [n[t] for t in part], [docs[t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTIAL, strict=True)], schema=PARTIAL)

    for batch in rows:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = groups.setdefault((lang, source), ({b"": 0}, {b"": 0}))
            before, own = len(n), {}
            for term in text.encode().translate(TERM_BYTES).split():
                own[term] = own.get(term, 0) + 1
            for term, k in own.items():
                n[term] = n.get(term, 0) + k
                docs[term] = docs.get(term, 0) + 1
            held += len(n) - before
        if held > HELD:
            yield from told()
            groups, held = {}, 0
    yield from told()


def share(n: Column, whole: Column, terms: Column) -> Column:
    """1 + SCALE * (n + 1) div (whole + terms), digit by digit, so that no product leaves 64 bits."""
    rest, out, base = n + 1, F.lit(0).cast("long"), whole + terms
    for _ in range(SCALE_STEPS):
        out = out * SCALE_STEP + F.call_function("div", rest * SCALE_STEP, base)
        rest = (rest * SCALE_STEP) % base
    return out + 1


def shares(n: np.ndarray, whole: np.ndarray, terms: int) -> np.ndarray:
    """share() of a matrix of counts, a row for each group."""
    rest, out, base = n + 1, np.zeros_like(n), (whole + terms)[:, None]
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        out = out * SCALE_STEP + rest // base
        rest %= base
    return out + 1


def tile_sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Divergences of all pairs of a tile over its stripe's chunks, from vectors in order of (lang, low, high, stripe, chunk, source).

    A vector has block, source, its group's whole, the language's terms, the chunk's width, columns and counts.
    """
    tile, chunk, vectors, sums = None, None, [], {}

    def dense(own: list[tuple], a: int, b: int) -> np.ndarray:
        out = np.zeros((len(own), b - a), np.int64)
        for i, (_, _, _, columns, counts) in enumerate(own):
            lo, hi = np.searchsorted(columns, (a, b))
            out[i, columns[lo:hi] - a] = counts[lo:hi]
        return out

    def add() -> None:
        """The chunk's part of each pair."""
        if not vectors or not vectors[0][2][1]:
            return
        low, high = tile[1], tile[2]
        one = [v for v in vectors if v[0] == low]
        two = one if low == high else [v for v in vectors if v[0] == high]
        terms, width = vectors[0][2][0], vectors[0][2][1]
        whole = [np.array([v[2][2] for v in own], np.int64) for own in (one, two)]
        for a in range(0, width, COLUMNS):
            b = min(width, a + COLUMNS)
            p = shares(dense(one, a, b), whole[0], terms)
            q = p if two is one else shares(dense(two, a, b), whole[1], terms)
            for i, v in enumerate(one):
                d = p[i] - q
                d *= d
                forth, back = (d // q).sum(1), (d // p[i]).sum(1)
                for w, x, y in zip(two, forth.tolist(), back.tolist(), strict=True):
                    if two is not one:
                        sums[w[1], v[1]] = sums.get((w[1], v[1]), 0) + y
                    if v[1] != w[1]:
                        sums[v[1], w[1]] = sums.get((v[1], w[1]), 0) + x

    def told() -> Iterator[pa.RecordBatch]:
        pairs = list(sums.items())
        for i in range(0, len(pairs), 20_000):
            part = pairs[i : i + 20_000]
            columns = [[tile[0]] * len(part), [k[0] for k, _ in part], [k[1] for k, _ in part], [v for _, v in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIR, strict=True)], schema=PAIR)

    for batch in rows:
        for lang, low, high, stripe, part, block, source, whole, terms, width, columns, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, low, high, stripe) != tile or part != chunk:
                add()
                vectors, chunk = [], part
                if (lang, low, high, stripe) != tile:
                    yield from told()
                    tile, sums = (lang, low, high, stripe), {}
            vectors.append((block, source, (terms, width, whole), np.frombuffer(columns or b"", "<i4"), np.frombuffer(counts or b"", "<i8")))
    add()
    yield from told()


def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns and counts of lang, chunk, source, array<struct<col, n>> as bytes."""
    for batch in rows:
        entries = batch.column(3)
        flat = entries.flatten()
        columns, counts = flat.field(0).to_numpy().astype("<i4"), flat.field(1).to_numpy().astype("<i8")
        ends = np.cumsum([0, *entries.value_lengths().to_pylist()]).tolist()
        spans = list(zip(ends[:-1], ends[1:], strict=True))
        cells = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (columns, counts)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cells], names=["lang", "chunk", "source", "columns", "counts"])


def kept_counts(docs: DataFrame, folder: str, least: int, chunk_rows: int) -> DataFrame:
    """A stored table of lang, source, chunk, term, col, width, n, total: counts of the kept terms in each group, and the group's row of the term ''.

    total is the language's count, col the term's place among the width of its chunk.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(*[text(c).alias(c) for c in ("lang", "source", "text")])
    partial = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    chunks = 1 + counts.count() // chunk_rows
    term = Window.partitionBy("lang", "chunk", "term")
    one = Window.partitionBy("lang", "chunk")
    dealt = counts.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).repartition(max(partitions(spark), min(chunks, 1 << 14)), "lang", "chunk")
    held = dealt.withColumns({"all": F.sum("docs").over(term), "total": F.sum("n").over(term)}).where((F.col("all") >= least) | (F.col("term") == ""))
    place = F.dense_rank().over(one.orderBy(F.col("term") == "", "term")) - 1
    held = held.withColumn("col", place.cast("int")).withColumn("width", F.coalesce(F.max(F.when(F.col("term") != "", F.col("col"))).over(one) + 1, F.lit(0)))
    held.select("lang", "source", "chunk", "term", "col", "width", "n", "total").write.parquet(f"{folder}/kept")
    return spark.read.parquet(f"{folder}/kept")


@tidy
def audit(docs: DataFrame, least: int = LEAST_DOCS, most_terms: int = MOST_TERMS, block: int = BLOCK, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: part pair ranks all other sources of the language, part term the first most_terms of the terms that the source has more of."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    kept = kept_counts(docs, folder, least, chunk_rows)
    real = F.col("term") != ""
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    chunks = kept.groupBy("lang", "chunk").agg(F.max("width").alias("width"))
    by_lang = chunks.groupBy("lang").agg(F.sum("width").cast("long").alias("terms")).join(by_group.groupBy("lang").agg(F.sum("whole").alias("all"), F.ceil(F.count("*") / block).cast("int").alias("blocks")), "lang")
    groups = by_group.join(by_lang, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups.join(chunks.where("width > 0"), "lang", "left").write.parquet(f"{folder}/groups")  # a row for each group and chunk
    base = spark.read.parquet(f"{folder}/groups")

    # term
    cells = kept.where(real).select("lang", "source", "chunk", "term", "n", "total").join(base.drop("width"), ["lang", "source", "chunk"])
    p, q = share(F.col("n"), F.col("whole"), F.col("terms")), share(F.col("total"), F.col("all"), F.col("terms"))
    apart = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    told = apart.select("lang", "source", "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))

    # pair
    entries = kept.where(real).groupBy("lang", "chunk", "source").agg(F.array_sort(F.collect_list(F.struct("col", "n"))).alias("entries"))
    vectors = entries.mapInArrow(packed, "lang string, chunk int, source string, columns binary, counts binary")
    full = base.where("chunk is not null").join(vectors, ["lang", "chunk", "source"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = full.select("lang", "chunk", "source", "block", "whole", "terms", "width", "columns", "counts", other)
    stripe = F.floor(F.col("chunk") / STRIPE).cast("int")
    sent = sent.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), stripe.alias("stripe"), "chunk", "block", "source", "whole", "terms", "width", "columns", "counts")
    tile = ["lang", "low", "high", "stripe"]
    sums = sent.repartition(*tile).sortWithinPartitions(*tile, "chunk", "source").mapInArrow(tile_sums, PAIR_TYPES).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")
    none = bare.alias("a").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = sums.unionByName(none).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
