"""Tables that every task needs, in blocks of bounded size."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _files
from ._arrays import by_parts, checkpoint_dir, dealt


class Blocks:
    """What a function makes of each block of a table's rows, for use inside tasks.

    A table within the bound, which is measured first, is one block and broadcast. Of a larger one the
    executors build blocks by a hash of the rows and write them to the shared checkpoint folder; a task
    loads them one after another, so that it never holds two.
    """

    def __init__(self, rows: DataFrame, size: Column, build: Callable[[list[tuple]], Any], most_bytes: int) -> None:
        spark = rows.sparkSession
        n = 1 + (rows.agg(F.sum(size)).first()[0] or 0) // most_bytes
        self.one, self.paths = None, []
        if n == 1:
            self.one = spark.sparkContext.broadcast(build([tuple(r) for r in rows.collect()]))  # measured above
            return
        folder = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in by_parts(batches):
                held: list[tuple] = []
                for batch in part:
                    number = batch.column(0)[0].as_py()
                    held += zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
                path = f"{folder}/{number:06d}-{TaskContext.get().taskAttemptId()}"
                _files.write_once(path, [pickle.dumps(build(held))])
                yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        numbered = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int").alias("part"), *rows.columns)
        self.paths = sorted(r.path for r in dealt(numbered, int(n)).mapInArrow(write, "path string").collect())  # a name for each block

    def __iter__(self) -> Iterator[Any]:
        if self.one is not None:
            yield self.one.value
        for path in self.paths:
            with _files.open_seekable(path) as f:
                yield pickle.loads(f.read())

    def shards(self, rows: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
        """The record batches, put together to larger ones where every one would have to load all blocks."""
        if self.one is not None:
            yield from rows
            return
        held: list[pa.RecordBatch] = []
        for batch in rows:
            held.append(batch)
            if sum(b.nbytes for b in held) >= most_bytes:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
