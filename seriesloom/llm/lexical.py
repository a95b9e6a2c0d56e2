"""Ranked lexical search by sort-based accumulation: the best documents of every item of a query set.

Documents are read once. Each becomes its length and its postings: which terms of the query set it has
and how often, stored in the shared folder. From these come the numbers of documents and terms and each
query term's document frequency. Then a task takes runs of documents and does for each what a posting
list does: it concatenates (item, document, impact) of all matched terms, sorts keys that pack
item and document by radix, sums impacts of equal keys by reduceat, and keeps each item's best in a
heap. What tasks keep is dealt by ranges of (item, document) to a second round of heaps, and what these
keep is ranked. Every document's score is whole before anything is dropped, so results are exact.

The query set's terms and items are in every task. Their size is measured first: a set beyond a bound is
searched in blocks, one after another over the stored documents.

Weights: a term in df of N documents weighs w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); tf times in a
document of n of all L terms it adds w * ((1000000000 * tf) div (1000 * tf + 8 * m)), where
m = 25 + (75 * n * N) div L, once for each time that the item has it.

Cases: a null or empty text has no terms, as a document and as an item; an item without terms, or whose terms
no document has, gives no rows; each row of the query set is an item of its own, also with a null or
repeated identifier; documents that repeat an identifier are rows of their own; equal scores are in
order of identifier, null last; texts of any length are read whole; other columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import checkpoint_dir, partitions, tidy

MOST = 10
ITEM_BYTES = 8 << 20  # of the texts of a block of items
TRIPLES = 1 << 21  # entries of one accumulation

TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())])
BEST = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
BEST_TYPES = "item long, doc_id long, score long"
FREQUENCY = pa.schema([("term", pa.int32()), ("df", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(TERM_BYTES).split()


class Items:
    """The terms of a block of items, numbered, and which items have each, one entry for each time."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.numbers: dict[bytes, int] = {}
        entries: list[tuple[int, int]] = []
        self.items = np.array([item for item, _ in rows], np.int64)
        for place, (_, text) in enumerate(rows):
            entries += [(self.numbers.setdefault(t, len(self.numbers)), place) for t in terms_of(text or "")]
        entries.sort()
        held = np.array(entries, np.int64).reshape(-1, 2)
        self.places = held[:, 1].astype(np.uint32)
        self.starts = np.searchsorted(held[:, 0], np.arange(len(self.numbers) + 1))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned keys, by their 16-bit digits from the lowest; equal keys stay as they are."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, max(1, top.bit_length()), 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]  # of 16-bit numbers: a radix sort
    return order


def accumulated(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (item, doc) in order, and the sum of the impacts of each."""
    keys = (items.astype(np.uint64) << np.uint64(32)) | docs.astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(impacts[order], starts) if len(starts) else impacts[:0]
    return (keys[starts] >> np.uint64(32)).astype(np.int64), (keys[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), sums


class Best:
    """For each item a heap of the most best (score, named, -identifier) so far."""

    def __init__(self, most: int) -> None:
        self.most, self.heaps = most, {}

    def add(self, items: np.ndarray, ids: list[int | None], scores: np.ndarray) -> None:
        """Entries in order of item."""
        edges = [0, *(np.flatnonzero(np.diff(items)) + 1).tolist(), len(items)] if len(items) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            heap = self.heaps.setdefault(int(items[a]), [])
            own = scores[a:b]
            least = heap[0][0] if len(heap) >= self.most else 1
            if b - a > self.most:  # no fewer than most entries reach this score
                least = max(least, int(np.partition(own, b - a - self.most)[b - a - self.most]))
            for i in np.flatnonzero(own >= least).tolist():
                doc = ids[a + i]
                entry = (int(own[i]), doc is not None, -(doc or 0))
                if len(heap) < self.most:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

    def told(self) -> Iterator[pa.RecordBatch]:
        rows = [(item, -key if named else None, score) for item, heap in self.heaps.items() for score, named, key in heap if score > 0]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50_000], strict=True), BEST.types, strict=True)], schema=BEST)


def postings_of(block):
    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block.value.numbers
        for batch in rows:
            out = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = terms_of(text or "")
                found, tf = np.unique(np.array([numbers[t] for t in terms if t in numbers], np.int32), return_counts=True)
                for column, x in zip(out, (doc, len(terms), found.astype("<i4").tobytes(), tf.astype("<i8").tobytes()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, POSTINGS.types, strict=True)], schema=POSTINGS)

    return read


def frequencies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the task have each term."""
    sums: dict[int, int] = {}
    for batch in rows:
        terms, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), return_counts=True)
        for t, k in zip(terms.tolist(), n.tolist(), strict=True):
            sums[t] = sums.get(t, 0) + k
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], schema=FREQUENCY)


def best_of_postings(block, documents: int, length: int, weights, most: int):
    """Scores of runs of documents, of which each item's best stay."""

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, w, best = block.value, weights.value, Best(most)
        copies = np.diff(held.starts)
        for batch in rows:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            m = np.array([25 + (75 * x * documents) // length if length else 25 for x in n], np.int64)
            terms = [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
            tf = [np.frombuffer(x, "<i8") for x in batch.column(3).to_pylist()]
            sizes = np.array([int(copies[t].sum()) for t in terms])
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), TRIPLES, "right")) + a)
                t, k = np.concatenate(terms[a:b]), np.concatenate(tf[a:b])
                doc = np.repeat(np.arange(a, b), [len(x) for x in terms[a:b]])
                impact = w[t] * ((1_000_000_000 * k) // (1000 * k + 8 * m[doc]))
                times = copies[t]
                entry = np.repeat(held.starts[t] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(t) else t
                place, row, score = accumulated(held.places[entry], np.repeat(doc, times), np.repeat(impact, times))
                best.add(held.items[place], [ids[i] for i in row.tolist()], score)
                a = b
        yield from best.told()

    return search


def best_of_best(most: int):
    def select(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(most)
        for batch in rows:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            sorted_ = batch.take(pa.array(order))
            best.add(sorted_.column(0).to_numpy(), sorted_.column(1).to_pylist(), sorted_.column(2).to_numpy())
        yield from best.told()

    return select


@tidy
def search(docs: DataFrame, queries: DataFrame, most: int = MOST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: for every row of queries (item_id, text) its most highest-scoring rows of docs (doc_id, text)."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    queries.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id()).write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")  # numbers that stay
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions(spark)
    for i in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).select("item", "text").orderBy("item")
        block = spark.sparkContext.broadcast(Items([tuple(r) for r in own.collect()]))  # of item_bytes
        table.mapInArrow(postings_of(block), "doc_id long, n long, terms binary, tf binary").write.parquet(f"{folder}/postings-{i}")
        stored = spark.read.parquet(f"{folder}/postings-{i}")
        whole = stored.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
        documents, length = whole.documents, whole.length or 0
        found = stored.select("terms").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row for each term of the block
        weights = np.zeros(len(block.value.numbers), np.int64)
        for r in found:
            weights[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
        scored = stored.mapInArrow(best_of_postings(block, documents, length, spark.sparkContext.broadcast(weights), most), BEST_TYPES)
        dealt = scored.repartitionByRange(n, "item", "doc_id").mapInArrow(best_of_best(most), BEST_TYPES)
        dealt.write.parquet(f"{folder}/best-{i}")
    best = spark.read.schema(BEST_TYPES).parquet(*[f"{folder}/best-{i}" for i in range(blocks)])
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
