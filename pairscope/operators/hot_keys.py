"""Per-key aggregates that stay balanced when a few keys hold most of the rows.

Method: dense accumulator arrays.

1. Every input split, whatever keys it holds, is read as Arrow batches. Keys are
   dictionary-encoded against the split's own growing dictionary and ``numpy.bincount``
   scatters the batch into dense accumulators (one slot a key). A key that holds a third
   of all rows costs each split one slot, so all tasks take as long as their split is large.
2. A split emits its accumulators as array blocks: keys are hashed to ``blocks`` ranges and
   each non-empty block becomes one row of parallel arrays. A block row is capped at
   ``MAX_SLOTS`` slots, so that no row grows with the number of keys.
3. Blocks are summed by a distributed reduction: block rows are hash-partitioned by block id
   and merged by dictionary code (``numpy.add.at`` over dense arrays). The input of a merge
   task is (splits x distinct keys of its blocks), never the rows of a key.

Only keys' partial sums are shuffled; nothing is collected and nothing is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of one block row; also the number of keys at which a split empties its dictionary.
MAX_SLOTS = 65_536


class _Accumulators:
    """Dense arrays over a growing key dictionary."""

    def __init__(self, metrics: int):
        self.index: dict = {}
        self.count = np.zeros(1024, dtype=np.int64)
        self.sums = np.zeros((metrics, 1024), dtype=np.float64)
        self.some = np.zeros((metrics, 1024), dtype=np.int64)

    def slots(self, keys: list) -> np.ndarray:
        index = self.index
        slots = np.fromiter((index.setdefault(k, len(index)) for k in keys), dtype=np.int64, count=len(keys))
        size = len(self.count)
        while size < len(index):
            size *= 2
        if size > len(self.count):
            grow = size - len(self.count)
            self.count = np.pad(self.count, (0, grow))
            self.sums = np.pad(self.sums, ((0, 0), (0, grow)))
            self.some = np.pad(self.some, ((0, 0), (0, grow)))
        return slots

    def add(self, keys: list, count: np.ndarray, sums: np.ndarray, some: np.ndarray) -> None:
        slots = self.slots(keys)
        np.add.at(self.count, slots, count)
        for m in range(len(sums)):
            np.add.at(self.sums[m], slots, sums[m])
            np.add.at(self.some[m], slots, some[m])


def _block_of(key: str | None, blocks: int) -> int:
    if key is None:
        return 0
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % blocks  # the same on every worker, unlike hash()


_BLOCK = "block int, side int, keys array<string>, counts array<long>, sums array<array<double>>, some array<array<long>>"


def _emit(acc: _Accumulators, side: int, blocks: int) -> Iterator[dict]:
    if not acc.index:
        return
    keys = list(acc.index)
    ids = np.fromiter((_block_of(k, blocks) for k in keys), dtype=np.int64, count=len(keys))
    order = np.argsort(ids, kind="stable")
    edges = np.flatnonzero(np.diff(ids[order])) + 1
    for part in np.split(order, edges):
        for at in range(0, len(part), MAX_SLOTS):
            sel = part[at : at + MAX_SLOTS]
            yield {
                "block": int(ids[sel[0]]),
                "side": side,
                "keys": [keys[i] for i in sel],
                "counts": acc.count[sel].tolist(),
                "sums": acc.sums[:, sel].tolist(),
                "some": acc.some[:, sel].tolist(),
            }


def dense_key_aggregate(
    df: DataFrame,
    keys: dict[str, str],
    metrics: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Counts and metric sums for every key of every key column, in one scan.

    ``keys`` maps a side name to its (string-castable) key column. Result: ``side``,
    ``group_id``, ``n_rows`` and for each metric ``sum_m`` (null when all its values are null)
    and ``n_m`` (its non-null values).

    Null keys form one group whose ``group_id`` is null; the caller decides whether it counts.
    Null and NaN metric values add nothing. An empty table gives an empty result. Ties and
    repeated rows each count. Columns of other names are never read.
    """
    sides = list(keys)
    metrics = list(metrics)
    spark = df.sparkSession
    blocks = blocks or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 16)  # many for each partition, so that they spread evenly
    narrow = df.select(
        *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keys.values())],
        *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)],
    )
    n_m = len(metrics)
    schema = pa.schema(
        [("block", pa.int32()), ("side", pa.int32()), ("keys", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
         ("sums", pa.list_(pa.list_(pa.float64()))), ("some", pa.list_(pa.list_(pa.int64())))]
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accs = [_Accumulators(n_m) for _ in sides]
        for batch in batches:
            values = [np.nan_to_num(batch.column(len(sides) + m).to_numpy(zero_copy_only=False)) for m in range(n_m)]
            there = [
                pc.and_kleene(pc.is_valid(c := batch.column(len(sides) + m)), pc.invert(pc.is_nan(c))).fill_null(False).to_numpy(zero_copy_only=False)
                for m in range(n_m)
            ]
            for s in range(len(sides)):
                coded = batch.column(s).dictionary_encode(null_encoding="encode")
                codes, local = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
                count = np.bincount(codes, minlength=len(local))
                sums = np.array([np.bincount(codes, weights=v, minlength=len(local)) for v in values]).reshape(n_m, len(local))
                some = np.array([np.bincount(codes, weights=t, minlength=len(local)) for t in there]).reshape(n_m, len(local)).astype(np.int64)
                accs[s].add(local, count, sums, some)
                if len(accs[s].index) > MAX_SLOTS:
                    yield pa.RecordBatch.from_pylist(list(_emit(accs[s], s, blocks)), schema=schema)
                    accs[s] = _Accumulators(n_m)
        rows = [r for s, a in enumerate(accs) for r in _emit(a, s, blocks)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out_fields = [("side", pa.string()), ("group_id", pa.string()), ("n_rows", pa.int64())]
    for m in metrics:
        out_fields += [(f"sum_{m}", pa.float64()), (f"n_{m}", pa.int64())]
    out_schema = pa.schema(out_fields)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accs: dict[int, _Accumulators] = {}
        for batch in batches:
            for row in batch.to_pylist():
                acc = accs.setdefault(row["side"], _Accumulators(n_m))
                size = len(row["keys"])
                acc.add(
                    row["keys"],
                    np.asarray(row["counts"], dtype=np.int64),
                    np.asarray(row["sums"], dtype=np.float64).reshape(n_m, size),
                    np.asarray(row["some"], dtype=np.int64).reshape(n_m, size),
                )
        for s, acc in sorted(accs.items()):
            names = list(acc.index)
            for at in range(0, len(names), MAX_SLOTS):
                part = slice(at, min(at + MAX_SLOTS, len(names)))
                n = part.stop - part.start
                cols = [pa.array([sides[s]] * n, pa.string()), pa.array(names[part], pa.string()), pa.array(acc.count[part])]
                for m in range(n_m):
                    cols += [pa.array(acc.sums[m][part], mask=acc.some[m][part] == 0), pa.array(acc.some[m][part])]
                yield pa.RecordBatch.from_arrays(cols, schema=out_schema)

    ddl = "side string, group_id string, n_rows long" + "".join(f", `sum_{m}` double, `n_{m}` long" for m in metrics)
    return narrow.mapInArrow(partial, _BLOCK).repartition(F.col("block")).mapInArrow(merge, ddl)


def hot_groups(df: DataFrame, keys: dict[str, str], min_share: float = 0.01) -> DataFrame:
    """Groups that hold at least ``min_share`` of all rows: ``side``, ``group_id``, ``n_rows``, ``share``.

    Null keys are no group but their rows count in the total. No row at all gives an empty result.
    The row total is one metadata-only count.
    """
    total = df.count()
    agg = dense_key_aggregate(df, keys).filter(F.col("group_id").isNotNull())
    return agg.filter(F.col("n_rows") >= F.lit(min_share) * F.lit(total)).withColumn("share", F.col("n_rows") / F.lit(max(total, 1)).cast("double"))
