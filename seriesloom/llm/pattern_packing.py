"""Best-fit packing of token pieces into sequences by length patterns.

All planning works on the histogram of piece lengths, which has at most ``capacity`` bins however
many pieces there are. Patterns of one to three lengths that fill a sequence (or nearly) are
enumerated from the histogram, non-negative least squares fit their repeat counts to it, the counts
are rounded down, and what is left is packed best-fit, longest first, still as counts. The plan is a
list of *runs*: so many pieces of one length go to consecutive sequences at one offset. Pieces then
find their places by their rank among pieces of their length.

Bounds of the plan: second lengths are the 96 commonest, of third lengths the two that fit best are tried,
and the 1500 fullest and commonest patterns are fitted, by 150 gradient steps. What they leave is packed
best-fit: they cost sequences, never pieces.

Cases: a null or empty text is one piece, the end id alone; only documents longer than the capacity
are cut; rows that repeat a document or an identifier are packed each; a null identifier is kept; an empty table
gives no rows; other columns are ignored; a very long text is encoded whole and cut into as many pieces as it takes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import batches, checkpointed, tidy
from ._tokens import encoder

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


PIECE_TYPES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cutter(tokenizer: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass from record batches of (identifier, text) to those of their pieces."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity

        def each() -> Iterator[tuple]:
            for batch in rows:
                for i in range(0, len(batch), 256):
                    part = batch.slice(i, 256)
                    coded = encode.encode([x or "" for x in part.column(1).to_pylist()])
                    for doc_id, ids in zip(part.column(0).to_pylist(), coded, strict=True):
                        ids += end
                        for k in range(0, len(ids), step):
                            x = ids[k : k + step]
                            yield doc_id, k // step, k // 4, len(x) // 4, zlib.crc32(x)

        yield from batches(each(), PIECE)

    return cut


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative x that nearly minimises |a x - b|, by accelerated projected gradient steps."""
    norm = np.linalg.norm(a, 2) ** 2
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - a.T @ (a @ y - b) / norm)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def enumerate_patterns(counts: np.ndarray, capacity: int, slack: int, most: int) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths present whose sum leaves at most slack, fullest and commonest first."""
    present = np.flatnonzero(counts)
    found: set[tuple[int, ...]] = {(int(capacity),)} if counts[capacity] else set()
    common = sorted(present.tolist(), key=lambda n: -counts[n])[:96]
    for first in present[::-1].tolist():
        for second in [0, *common]:
            pair = first + second
            if pair > capacity:
                continue
            rest = capacity - pair
            near = present[(present <= rest) & (present >= rest - slack)]
            options = near[np.argsort(-near, kind="stable")[:2]].tolist() if len(near) else []
            if rest <= slack:
                found.add(tuple(sorted(x for x in (first, second) if x)))
            for third in options:
                found.add(tuple(sorted((x for x in (first, second, third) if x))))
    weight = lambda p: (capacity - sum(p), -min(counts[n] / p.count(n) for n in p), p)
    return sorted((p for p in found if all(counts[n] >= p.count(n) for n in p)), key=weight)[:most]


def plan(counts: np.ndarray, capacity: int, *, slack: int = 8, most: int = 1500, rounds: int = 150) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece of the histogram once.

    counts[n] is the number of pieces of n tokens, for n up to capacity.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    rank = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(pattern: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        at = 0
        for n in pattern:
            runs.append((n, int(rank[n]), times, sequences, at))
            rank[n] += times
            left[n] -= times
            at += n
        sequences += times

    if left[capacity]:
        place((capacity,), int(left[capacity]))
    if patterns := enumerate_patterns(left, capacity, slack, most):
        lengths = np.unique(np.concatenate([np.array(p) for p in patterns]))
        row = {int(n): i for i, n in enumerate(lengths)}
        scale = np.sqrt(np.maximum(left[lengths], 1))
        a = np.zeros((len(lengths), len(patterns)))
        for j, p in enumerate(patterns):
            for n in p:
                a[row[n], j] += 1 / scale[row[n]]
        fit = nnls(a, left[lengths] / scale, rounds)
        for j in np.argsort(-fit, kind="stable").tolist():
            p = patterns[j]
            times = min(int(fit[j]), *(int(left[n]) // p.count(n) for n in set(p)))
            if times > 0:
                place(p, times)
    # the rest, best fit and longest first: equal pieces that meet equal gaps are placed together
    present = np.flatnonzero(left)
    while len(present):
        first = int(present[-1])
        pattern, gap = [first], capacity - first
        while gap:
            taken = {n: pattern.count(n) for n in set(pattern)}
            fitting = [n for n in present[: np.searchsorted(present, gap, "right")][::-1].tolist() if left[n] > taken.get(n, 0)][:1]
            if not fitting:
                break
            pattern.append(fitting[0])
            gap -= fitting[0]
        times = min(int(left[n]) // pattern.count(n) for n in set(pattern))
        place(tuple(pattern), max(1, times))
        present = np.flatnonzero(left)
    return runs


def pack_pieces(found: DataFrame, capacity: int) -> DataFrame:
    """Stored pieces with sequence_id and offset."""
    spark = found.sparkSession
    held = found.withColumn("salt", F.spark_partition_id())
    counts = np.zeros(capacity + 1, np.int64)
    by_salt = held.groupBy("length", "salt").agg(F.count("*").alias("n"))
    for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r.length] = r.n
    runs = plan(counts, capacity)
    by_length: dict[int, list[tuple]] = {}
    for n, first, size, seq, at in runs:
        by_length.setdefault(n, []).append((first, size, seq, at))
    lookup = {n: tuple(np.array(c, np.int64) for c in zip(*sorted(x), strict=True)) for n, x in by_length.items()}
    shared = spark.sparkContext.broadcast(lookup)  # bounded by the histogram's bins

    before = by_salt.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = held.withColumn("rank", F.row_number().over(own) - 1).join(before.select("length", "salt", "base"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def assign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths).tolist():
                first, _, start, offset = shared.value[n]
                mine = lengths == n
                i = np.searchsorted(first, ranks[mine], "right") - 1
                seq[mine], at[mine] = start[i] + ranks[mine] - first[i], offset[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(at)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@tidy
def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every whole text: one row for each piece with its sequence and place there."""
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pack_pieces(checkpointed(table, cutter(tokenizer, end_id, capacity), PIECE_TYPES), capacity)
