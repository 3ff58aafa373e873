"""Sharded outputs that can be resumed: numbered shards, an index with digests, reuse only of what matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.contracts import ContractError
from pairscope.sources.tables import _fs, write_exclusive


def with_shard(df: DataFrame, row: str = "source_row", size: int = 500) -> DataFrame:
    return df.withColumn("shard_index", F.floor(F.col(row) / size).cast("long"))


def fingerprints(df: DataFrame, columns: list[str], model: str) -> DataFrame:
    """``shard_index``, rows, bounds and an order-free fingerprint of each shard's input under a model."""
    row = F.xxhash64(F.lit(model), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return df.groupBy("shard_index").agg(
        F.count(F.lit(1)).alias("input_rows"), F.min("source_row").alias("row_start"), (F.max("source_row") + 1).alias("row_stop"),
        F.bit_xor(row).alias("input_xor"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("input_sum"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def run_shards(spark: SparkSession, source: DataFrame, columns: list[str], model: str, transform: Callable[[DataFrame], DataFrame], path: str, attempt: int) -> DataFrame:
    """Compute the shards that no earlier attempt holds for the same input and model, and return all of them.

    Each attempt writes ``path/attempt=n`` (data by shard) and ``path/index/attempt=n``; the index is written last, so data of an
    attempt that broke off is never reused. Done shards are left out by an anti-join, not by a list on the driver.
    """
    want = fingerprints(source, columns, model)
    index_path = f"{path}/index"
    keys = ["shard_index", "input_rows", "row_start", "row_stop", "input_xor", "input_sum"]
    if _exists(spark, index_path):
        done = spark.read.parquet(index_path).select(*keys).distinct()
        todo = want.join(done, keys, "left_anti")
    else:
        todo = want
    rows = source.join(todo.select("shard_index"), "shard_index", "left_semi")
    write_exclusive(transform(rows).repartition("shard_index").sortWithinPartitions("shard_index", "source_row"), f"{path}/data/attempt={attempt}", ["shard_index"])
    write_exclusive(todo.coalesce(1), f"{index_path}/attempt={attempt}")
    index = spark.read.option("basePath", index_path).parquet(index_path)
    valid = index.join(want, keys, "left_semi").groupBy("shard_index").agg(F.max("attempt").alias("attempt"))
    data = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    return data.join(valid, ["shard_index", "attempt"], "left_semi").drop("attempt")


def assert_continuous(bounds: DataFrame, rows: int) -> DataFrame:
    """Shards must follow each other without gap and cover all rows; the index is one row a shard."""
    got = bounds.agg(F.count(F.lit(1)).alias("n"), F.max("shard_index").alias("last"), F.sum("input_rows").alias("rows"), F.sum(F.col("row_stop") - F.col("row_start")).alias("span"), F.min("row_start").alias("first")).first()
    if got["n"] and (got["last"] != got["n"] - 1 or got["rows"] != rows or got["span"] != rows or got["first"] != 0):
        raise ContractError(f"shards are not continuous: {got.asDict()}")
    return bounds
