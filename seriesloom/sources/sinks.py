"""Where results go: CSV for spreadsheets, manifests, and artifacts named by their content."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def export_columns(df: DataFrame) -> list[Column]:
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double" or kind.startswith("decimal"):
            c = text.trimmed_number(c.cast("double"))
        elif kind == "string":
            c = text.safe_cell(c)
        out.append(c.cast("string").alias(name))
    return out


def export_frame(df: DataFrame) -> DataFrame:
    """df as text: ISO dates, decimals of at most six places, no cell that a spreadsheet takes for a formula."""
    return df.select(*export_columns(df))


def write_csv(df: DataFrame, path: str) -> None:
    """Parts of a CSV with a header, written by the executors."""
    export_frame(df).write.mode("errorifexists").csv(path, header=True, quoteAll=False, escape='"', emptyValue="")


def manifest(df: DataFrame, *, assumptions: list[str] = (), limitations: list[str] = ()) -> str:
    """A JSON text: row count, columns and a checksum of the rows that does not depend on their order."""
    cells = export_frame(df)
    row = F.xxhash64(*[F.coalesce(c, F.lit("")) for c in cells.columns])
    found = cells.agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 40)).cast("decimal(38,0)")).alias("x")).first()
    return json.dumps({"rows": found.n, "columns": cells.columns, "checksum": str(found.x or 0), "assumptions": list(assumptions), "limitations": list(limitations)}, sort_keys=True)


def write_single_csv(df: DataFrame, path: str, order: list[str], *, assumptions: list[str] = (), limitations: list[str] = ()) -> dict:
    """One CSV file with a byte order mark at path, in the order of the columns of order, and a manifest beside it; the manifest.

    The file is written under another name by one task, as one file has to be, and renamed when it is whole, by the
    file system of the path, so that a reader never meets a part of it; the manifest, which has the sha256 of the file's
    bytes, is renamed last. An existing file is replaced.
    """
    spark = df.sparkSession
    cells = export_frame(df)
    options = {"header": "false", "escape": '"', "emptyValue": "", "nullValue": ""}
    head = spark.createDataFrame([tuple(cells.columns)], ", ".join(f"`{c}` string" for c in cells.columns)).select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cells.columns]), options).alias("value"))
    body = df.select(F.struct(*[F.col(f"`{c}`") for c in order]).alias("__o"), F.to_csv(F.struct(*[c.alias(n) for c, n in zip(export_columns(df), df.columns, strict=True)]), options).alias("value"))
    part = f"{path}.writing-{uuid.uuid4().hex}"
    lines = head.select(F.lit(0).alias("__k"), F.lit(None).cast(body.schema["__o"].dataType).alias("__o"), F.concat(F.lit("\ufeff"), "value").alias("value")).unionByName(body.withColumn("__k", F.lit(1)))
    lines.repartition(1).sortWithinPartitions("__k", "__o").select("value").write.text(part)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(part).select("path", F.sha2("content", 256).alias("sha256"), "length").first()
    told = {"sha256": found.sha256, "bytes": found.length, "rows": df.count(), "columns": df.columns, "assumptions": list(assumptions), "limitations": list(limitations)}
    rename(spark, found.path, path)
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(part)
    rename(spark, spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(part).first().path, f"{path}.manifest.json")
    file_system(spark, part).delete(spark._jvm.org.apache.hadoop.fs.Path(part), True)
    return told


def file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a file another name of its file system, in place of what had it."""
    at, system = spark._jvm.org.apache.hadoop.fs.Path, file_system(spark, old)
    if not system.rename(at(old), at(new)):
        system.delete(at(new), False)
        if not system.rename(at(old), at(new)):
            raise OSError(f"{old} cannot be renamed to {new}")


class Artifacts:
    """Payloads under their sha256: written once, checked when read or written again."""

    def __init__(self, root: str) -> None:
        self.root = Path(root).resolve()

    def path(self, digest: str) -> Path:
        if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
            raise ValueError("not a sha256")
        return self.root / digest[:2] / digest

    def store(self, content: bytes) -> str:
        digest = hashlib.sha256(content).hexdigest()
        path = self.path(digest)
        if path.exists():
            self.read(digest)
            return digest
        path.parent.mkdir(parents=True, exist_ok=True)
        new = path.with_suffix(f".{os.getpid()}")
        new.write_bytes(content)
        os.replace(new, path)
        return digest

    def read(self, digest: str) -> bytes:
        content = self.path(digest).read_bytes()
        if hashlib.sha256(content).hexdigest() != digest:
            raise ValueError("the artifact's content is not what it was")
        return content


def request_plan(first: str, last: str, days: int = 90) -> list[tuple[str, str]]:
    """Request windows of at most so many days, the latest first."""
    from datetime import date, timedelta

    lo, hi = date.fromisoformat(first), date.fromisoformat(last)
    if hi < lo or not 1 <= days <= 365:
        raise ValueError("the range is empty or a window's length is not 1 to 365 days")
    starts = [lo + timedelta(days=i) for i in range(0, (hi - lo).days + 1, days)]
    return [(s.isoformat(), min(hi, s + timedelta(days=days - 1)).isoformat()) for s in reversed(starts)]
