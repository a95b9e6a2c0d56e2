"""Sorted-string-table shards of token ids.

A shard is one file of documents in ascending order of their identifiers:

    data blocks | Bloom filter | sparse index | footer

A data block holds entries whose keys share prefixes with the key before (every RESTART-th key is
whole, and a table of these at the block's end allows binary search), is compressed and carries a
checksum. The index has each block's last key and place. The footer has the places of filter and
index, the numbers of documents and ids, and a magic number. ``Table`` looks identifiers up by
filter, index and restarts, reading one block.

Cases: a null text is an empty document; a null identifier sorts first; rows that repeat an
identifier are all kept, in order of their texts; a very long text is one entry; an empty table gives no
shard; other columns are ignored. An id takes two bytes, or four where the vocabulary needs them. Shards follow ranges of the identifier, so tables of any size give shards of like counts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _files
from ._arrays import batches, checkpoint_dir, expand, measured_bytes, mix, partitions, squeeze
from ._tokens import encoder, id_count

MAGIC = 0x5353_5442_4944_5331
RESTART, BLOCK_BYTES, BITS_A_KEY, PROBES = 16, 1 << 16, 10, 7
SHARD_BYTES = 256 << 20  # of input, at most, to a shard
FOOTER = struct.Struct("<QQQQQQQBQ")  # index at, its length, filter at, its length, blocks, documents, ids, bytes an id, magic


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do, a null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def shared_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Places in the filter, PROBES for each key."""
    h = mix(np.array([zlib.crc32(k) | zlib.crc32(k, 0x5BD1E995) << 32 for k in keys], np.uint64))
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def encode_table(entries: Iterable[tuple[int | None, bytes]], width: int) -> Iterator[bytes]:
    """A shard's bytes from (identifier, little-endian ids of the given width) in order of identifiers."""
    at, docs, ids = 0, 0, 0
    index: list[tuple[bytes, int, int]] = []
    keys: list[bytes] = []
    block, restarts, before, n = bytearray(), [], b"", 0

    def finish() -> bytes:
        body = squeeze(bytes(block) + struct.pack(f"<{len(restarts)}I", *restarts) + struct.pack("<I", len(restarts)))
        return body + struct.pack("<I", zlib.crc32(body))

    for doc_id, value in entries:
        key = key_of(doc_id)
        if docs and key < keys[-1]:
            raise ValueError("identifiers are not in order")
        same = 0 if n % RESTART == 0 else shared_prefix(before, key)
        if n % RESTART == 0:
            restarts.append(len(block))
        block += varint(same) + varint(len(key) - same) + varint(len(value)) + key[same:] + value
        before, n, docs, ids = key, n + 1, docs + 1, ids + len(value) // width
        keys.append(key)
        if len(block) >= BLOCK_BYTES:
            index.append((key, at, len(x := finish())))
            yield x
            at += len(x)
            block, restarts, n = bytearray(), [], 0
    if n:
        index.append((before, at, len(x := finish())))
        yield x
        at += len(x)
    bits = max(64, (len(keys) * BITS_A_KEY + 7) // 8 * 8)
    filled = np.zeros(bits, bool)
    for i in range(0, len(keys), 4096):
        filled[probes(keys[i : i + 4096], bits).ravel()] = True
    bloom = np.packbits(filled, bitorder="little").tobytes()
    table = b"".join(struct.pack("<BQI", len(k), o, m) + k for k, o, m in index)
    yield bloom
    yield table
    yield FOOTER.pack(at + len(bloom), len(table), at, len(bloom), len(index), docs, ids, width, MAGIC)


class Table:
    """A shard opened for reading."""

    def __init__(self, uri: str) -> None:
        self.file = _files.open_seekable(uri)
        self.file.seek(0, 2)
        size = self.file.tell()
        index_at, index_len, bloom_at, bloom_len, self.blocks, self.docs, self.ids, self.width, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no such table")
        self.bloom = np.unpackbits(np.frombuffer(self.read(bloom_at, bloom_len), np.uint8), bitorder="little")
        raw, i, self.index = self.read(index_at, index_len), 0, []
        while i < len(raw):
            n, at, size = struct.unpack_from("<BQI", raw, i)
            self.index.append((raw[i + 13 : i + 13 + n], at, size))
            i += 13 + n
        self.lasts = [k for k, _, _ in self.index]
        self.kind = np.dtype(f"<u{self.width}")

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()

    def block(self, i: int) -> tuple[bytes, list[int], int]:
        """Bytes, restarts and the end of the entries of block i."""
        _, at, size = self.index[i]
        raw = self.read(at, size)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        data = expand(raw[:-4])
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 - 4 * n
        return data, list(struct.unpack_from(f"<{n}I", data, end)), end

    @staticmethod
    def entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            same, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:same] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def may_have(self, doc_id: int | None) -> bool:
        return bool(self.bloom[probes([key_of(doc_id)], len(self.bloom))[0]].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with the identifier: filter, then binary search of index and restarts."""
        if not self.may_have(doc_id):
            return []
        key, found = key_of(doc_id), []
        for i in range(bisect_left(self.lasts, key), len(self.index)):
            data, restarts, end = self.block(i)
            at = max(0, bisect_left(restarts, key, key=lambda r: next(self.entries(data, r, end))[0]) - 1)
            for k, value in self.entries(data, restarts[at], end):
                if k == key:
                    found.append(np.frombuffer(value, self.kind))
                elif k > key:
                    return found
        return found

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            data, _, end = self.block(i)
            for key, value in self.entries(data, 0, end):
                yield id_of(key), np.frombuffer(value, self.kind)


MANIFEST = pa.schema([("path", pa.string()), ("first_key", pa.binary()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode the texts, append end_id to each, write shards under folder and return the manifest, in order.

    The manifest has one row for each shard. A task that is run again writes under another name, and
    the manifest names one file for each range.
    """
    spark = docs.sparkSession
    width = 2 if max(end_id + 1, id_count(tokenizer)) <= 1 << 16 else 4

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], f"<u{width}").tobytes()
        seen = {"n_docs": 0, "n_tokens": 0, "first_key": None}

        def entries() -> Iterator[tuple[int | None, bytes]]:
            for batch in rows:
                for i in range(0, len(batch), 256):
                    part = batch.slice(i, 256)
                    coded = encode.encode([x or "" for x in part.column(1).to_pylist()])
                    for doc_id, ids in zip(part.column(0).to_pylist(), coded, strict=True):
                        if seen["first_key"] is None:
                            seen["first_key"] = key_of(doc_id)
                        seen["n_docs"] += 1
                        seen["n_tokens"] += len(ids) // 4 + 1
                        yield doc_id, np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end

        task = TaskContext.get()
        path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
        size = _files.write_once(path, encode_table(entries(), width))
        if seen["n_docs"]:
            yield from batches(iter([(path, seen["first_key"], seen["n_docs"], seen["n_tokens"], size)]), MANIFEST)

    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = max(partitions(spark), -(-measured_bytes(docs) // SHARD_BYTES))  # a writer holds the keys of one shard
    ranged = table.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ranged.mapInArrow(write, "path string, first_key binary, n_docs long, n_tokens long, n_bytes long").collect()  # a row for each shard
    return sorted((r.asDict() | {"first_key": bytes(r.first_key)} for r in rows), key=lambda r: r["first_key"])


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the shards."""
    start, shards = 0, []
    for i, x in enumerate(manifest):
        shards.append((i, x["path"], start))
        start += x["n_tokens"]

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            for batch in rows:
                for path, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    table = Table(path)
                    for doc_id, ids in table:
                        yield doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                        at += len(ids)
                    table.close()

        yield from batches(entries(), READ)

    found = spark.createDataFrame(shards, "part int, path string, start long").repartitionById(max(1, len(shards)), F.col("part"))
    return found.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """The ids of the documents with the identifier, from the one or few shards whose range has it."""
    key = key_of(doc_id)
    firsts = [x["first_key"] for x in manifest]
    found = []
    for x in manifest[max(0, bisect_left(firsts, key) - 1) :]:
        if x["first_key"] > key:
            break
        table = Table(x["path"])
        found += table.get(doc_id)
        table.close()
    return found


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents to shards in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/sst-{uuid.uuid4().hex}"
    return read_shards(spark, write_shards(docs, tokenizer, end_id, folder))
