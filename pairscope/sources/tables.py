"""Reading and writing tables: snapshots, projected reads, exclusive writes, small CSV and JSON documents, digests."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_snapshot(spark: SparkSession, directory: str, pattern: str = "*.parquet", files: int | None = None, marker: str | None = "_SUCCESS", schema: T.StructType | None = None) -> DataFrame:
    """A multi-file snapshot, complete only if its marker is there and it has as many files as stated."""
    fs, where = _fs(spark, directory)
    jvm = spark.sparkContext._jvm
    if marker and not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{directory}/{marker}")):
        raise FileNotFoundError(f"{directory} has no {marker}")
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{directory}/{pattern}"))
    n = len(found) if found is not None else 0
    if files is not None and n != files:
        raise FileNotFoundError(f"{directory} has {n} files, expected {files}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*sorted(f.getPath().toString() for f in found))


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Projected read; only these columns leave the files."""
    return spark.read.parquet(path).select(*columns)


def probe(spark: SparkSession, path: str) -> tuple[int, T.StructType]:
    """Row count and schema; Spark answers the count from the Parquet footers."""
    df = spark.read.parquet(path)
    return df.count(), df.schema


def write_exclusive(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write Parquet once: fails if the path exists; the committer's marker appears last."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """``write_exclusive`` in total order: ranges of the order's columns, each sorted, so that files in name order hold the rows in order."""
    write_exclusive(df.repartitionByRange(*order).sortWithinPartitions(*order), path)


def write_small_csv(df: DataFrame, path: str, digits: int = 8, max_rows: int = 100_000, order: list[str] | None = None) -> None:
    """A report as one CSV file with rounded doubles, sorted by ``order``; refuses tables that are no report."""
    rounded = df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    flat = rounded.select(*[c for c, t in rounded.dtypes if not t.startswith(("array", "struct", "map", "binary"))])
    rows = flat.limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows: write a table instead")
    if order:
        rows = rows.sort_values(order, kind="stable")
    with open(path, "x", encoding="utf-8", newline="") as f:
        rows.to_csv(f, index=False)


def write_json_once(path: str | Path, value: object) -> None:
    """JSON with sorted keys; fails if the file exists; synced to disk."""
    write_text_once(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def write_text_once(path: str | Path, text: str) -> None:
    with open(path, "x", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())


def file_digest(path: str | Path, size: int = 1 << 20) -> str:
    """SHA-256 of a file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(size):
            h.update(piece)
    return h.hexdigest()


def tree_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path and SHA-256 of every file below a path, hashed on the executors; for trees too large for the driver. Files up to 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
