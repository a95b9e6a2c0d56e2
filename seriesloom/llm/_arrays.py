"""Vectorised helpers shared by the text operators: byte chunks, word hashes, packed exchanges.

Rows that carry one number each are slow to move between the JVM and Python. The operators here
therefore exchange *packed blocks*: each task sorts its numbers into one block for each destination
and sends a block as one binary cell. A block is bounded by the task's own input.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _files

U64 = np.uint64
CHUNK = 1 << 20
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def partitions(spark: SparkSession) -> int:
    """The number of partitions that Spark's own exchanges use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. In local mode one is chosen where none is named; a cluster has to name it."""
    place = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext._jsc.sc().conf().get("spark.checkpoint.dir", "")
    if not place:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "/tmp/checkpoints"
    return place


def input_bytes(docs: DataFrame) -> int:
    """The size of what docs reads, as the optimizer estimates it."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


UNKNOWN = 1 << 50  # what the optimizer says of tables that it knows nothing of, or their joins


def measured_bytes(docs: DataFrame) -> int:
    """The size of what docs reads by the optimizer's estimate; where it has none, by one pass over docs itself."""
    size = input_bytes(docs)
    if size < UNKNOWN:
        return size
    wide = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in docs.dtypes if kind in ("string", "binary")]
    return docs.agg(F.sum(sum(wide, F.lit(8 * len(docs.columns)).cast("long")))).first()[0] or 0


MOST_PARTITIONS = 1 << 14  # of one exchange; more parts than that share partitions, where Spark's sort keeps them apart


def part_count(docs: DataFrame, target: int = 4 << 20) -> int:
    """How many parts a packed exchange over docs has: one for each target bytes of input, at least two for each core.

    There are at most 2^20, so above four terabytes a part grows with the input: to 100 MB at 100 terabytes.
    """
    parts = -(-measured_bytes(docs) // target)
    return int(min(1 << 20, max(2 * docs.sparkSession.sparkContext.defaultParallelism, parts)))


def file_count(docs: DataFrame, target: int = 32 << 20) -> int:
    """How many files a result over docs is worth: one for each target bytes of input, at least one for each core."""
    files = -(-measured_bytes(docs) // target)
    return int(min(1 << 20, max(docs.sparkSession.sparkContext.defaultParallelism, files)))


def checkpointed(df: DataFrame, last: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, types: str = "") -> DataFrame:
    """A table in the shared checkpoint folder with the rows of df, or of last over df, whose columns are types.

    Where the folder is a mounted file system, last and the writing are one pass of the Python workers:
    each task writes a Parquet file under a name of its attempt, a row group for each record batch, and
    the driver sees the names. Elsewhere Spark writes the table. discard() removes it.
    """
    spark, place = df.sparkSession, checkpoint_dir(df.sparkSession)
    schema = spark.createDataFrame([], types).schema if last else df.schema
    last = last or (lambda rows: rows)
    folder = f"{_files.local(place) or place}/blocks-{uuid.uuid4().hex}"
    if _files.local(place) is None:
        df.mapInArrow(last, schema).write.parquet(folder)
        stored = spark.read.schema(schema).parquet(folder)
        stored.stored_in = folder
        return stored

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet

        task, writer = TaskContext.get(), None
        path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.parquet"
        for batch in last(rows):
            if writer is None:
                os.makedirs(folder, exist_ok=True)
                writer = pyarrow.parquet.ParquetWriter(f"{path}.writing", batch.schema, compression="zstd", use_dictionary=False, write_statistics=False)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            os.replace(f"{path}.writing", path)
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    paths = sorted(r.path for r in df.mapInArrow(write, "path string").collect())  # a name for each file
    stored = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    stored.stored_in = folder
    return stored


def discard(*tables: DataFrame) -> None:
    """Remove checkpointed tables that nothing reads any more."""
    for df in tables:
        if folder := df.__dict__.get("stored_in"):
            _files.remove(folder)


WORKERS = {  # of the Python workers: freed memory goes back to the system at once
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": "262144",
    "MALLOC_TRIM_THRESHOLD_": "1048576",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a job's shuffle files go when it ends


def bounded(spark: SparkSession) -> None:
    """Bound what a Python worker holds: small record batches, memory given back.

    These settings stay, since results are computed after the operator returned.
    """
    spark.sparkContext.environment.update(WORKERS)
    if int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def tidy(f):
    """f with bounded workers; what comes after a job inside f reads stored tables, not the job's shuffle files."""

    @wraps(f)
    def run(docs: DataFrame, *args, **kwargs):
        spark = docs.sparkSession
        bounded(spark)
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            return f(docs, *args, **kwargs)
        finally:
            if before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)

    return run


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """Inner join of many with one, which has a row for each key, where a key can hold a large share of many.

    The rows of a key are dealt by a hash of another column; each pair of key and salt that occurs gets
    its own row of one, so that a task meets a part of a hot key only.
    """
    salted = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    pairs = salted.select(key, "__salt").distinct().join(one, key)
    return salted.join(pairs, [key, "__salt"]).drop("__salt")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n+1 offsets; a null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        if lengths.sum() != offsets[-1] - offsets[0]:
            parts = [data[offsets[i] : offsets[i] + n] for i, n in enumerate(lengths)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of about limit bytes; a longer text is a run by itself."""
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x *= MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


def begin_end(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Where each run begins and ends, of n entries."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)) if len(starts) else []


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK + 1)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


POWERS = Powers()
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def prefix_hash(data: np.ndarray, codes: np.ndarray = BYTE_CODE) -> np.ndarray:
    """n+1 running sums of code times power, from which any span's hash follows."""
    up, _ = POWERS.need(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * up[: len(data)], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans: alike for like bytes wherever they stand. The length takes part."""
    _, down = POWERS.need(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes, never across texts, and n+1 offsets of the texts into the words."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = is_word[data]
    step = np.diff(flag)
    starts, ends = np.flatnonzero(step[:-1] == 1), np.flatnonzero(step[1:] == -1) + 1
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[(flag[cuts] == 1) & (flag[cuts + 1] == 1)]) if len(cuts) else cuts
    if len(cuts):  # a word on both sides of a border is two words
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def lower_codes(codes: np.ndarray = BYTE_CODE) -> np.ndarray:
    """The byte codes with A-Z counted as a-z."""
    out = codes.copy()
    out[65:91] = codes[97:123]
    return out


SPACE_WORD = np.ones(256, bool)  # words are runs of anything but these bytes
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k neighbouring words."""
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out *= U64(BASE)
        out += words[i : len(words) - k + 1 + i]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted set of k-word shingle hashes of each text; a text of fewer words is one shingle, one of none has none."""
    starts, ends, of = word_spans(data, offsets, SPACE_WORD)
    words = span_hash(prefix_hash(data, LOWER), starts, ends)
    grams = gram_hash(words, k) if len(words) >= k else words[:0]
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield gram_hash(words[a:b], b - a) ^ U64(b - a)
        else:
            yield grams[:0]


LOWER = lower_codes()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, one after another, after their length."""
    return struct.pack("<q", len(arrays[0])) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<q", blob)[0], 8, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def unpack_all(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The arrays of many blocks, joined."""
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate(kinds)]


def by_part(parts: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays dealt out by the parts' numbers."""
    order = np.argsort(parts, kind="stable")
    edges = np.searchsorted(parts[order], np.arange(n + 1))
    arrays = [a[order] for a in arrays]
    for i in range(n):
        a, b = edges[i], edges[i + 1]
        if b > a:
            yield i, [x[a:b] for x in arrays]


def part_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A destination below n for each 64-bit hash, by its upper bits."""
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def id_part(ids: np.ndarray, n: int) -> np.ndarray:
    """A destination below n for each signed 64-bit identifier."""
    return part_of(mix(ids.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15)), n)


def dealt(df: DataFrame, n: int, column: str = "part") -> DataFrame:
    """df with each part in one partition; parts that share one stand one after another there."""
    if n <= MOST_PARTITIONS:
        return df.repartitionById(n, F.col(column))
    return df.repartitionById(MOST_PARTITIONS, F.pmod(F.col(column), F.lit(MOST_PARTITIONS)).cast("int")).sortWithinPartitions(column)


def by_parts(rows: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The record batches of each part of a partition, whose first column is the part's number."""
    waiting: list[pa.RecordBatch] = []

    def pieces() -> Iterator[pa.RecordBatch]:
        for batch in rows:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)

    source = pieces()

    def one(first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        part = first.column(0)[0].as_py()
        yield first
        for batch in source:
            if batch.column(0)[0].as_py() != part:
                waiting.append(batch)
                return
            yield batch

    for batch in source:
        waiting.append(batch)
        while waiting:
            group = one(waiting.pop())
            yield group
            for _ in group:  # what the receiver left unread
                pass


SQUEEZE, EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(x: bytes) -> bytes:
    return SQUEEZE.compress(x)


def expand(x: bytes) -> bytes:
    return EXPAND.decompress(x)


def batches(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 5000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows gathered into record batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
