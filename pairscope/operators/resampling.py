"""Cluster bootstrap of ratio means: per-cluster sums, then resampled clusters.

Three engines over the same sufficient statistics (one row a cluster: sums and counts, map-side combined):

* ``numpy``: the multinomial draws of a seeded PCG64 stream, in one worker for each stratum; strata run in parallel. The
  universe of clusters is held by that worker, so its size is checked against ``MAX_UNIVERSE``.
* ``poisson``: each cluster draws a Poisson(1) weight for each repetition from a hash of (seed, repetition, cluster). Weights need no
  universe in one place: partitions add up (repetitions x metrics) arrays, and the shuffle is that small whatever the table. For large universes.
* ``hash``: index draws by MD5, as SQL can make them too, for checking the estimator against another engine.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.session import cut_lineage

MAX_UNIVERSE = 2_000_000
DRAWS_AT_ONCE = 4_000_000  # entries of a block of draws
WEIGHTS_AT_ONCE = 16_000_000  # entries of a block of weights: 128 MB
HASHES_AT_ONCE = 16_384  # MD5 sums of one go
PLACES_AT_ONCE = 4_000_000  # places of a pack of the hash engine
RANGES = 50  # ranges of repetitions of the hash engine, at most


def derive_seed(seed: int, *labels: str) -> int:
    """Seed xor the first eight bytes of SHA-256 of the labels."""
    return seed ^ int.from_bytes(hashlib.sha256("\0".join(labels).encode()).digest()[:8], "big")


def cluster_sums(df: DataFrame, keys: list[str], cluster: str, metrics: list[str]) -> DataFrame:
    """Sum and non-null count of each metric by stratum and cluster."""
    aggs = [F.sum(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(f"s_{m}") for m in metrics]
    aggs += [F.count(F.col(m)).alias(f"c_{m}") for m in metrics]
    return df.groupBy(*keys, cluster).agg(*aggs)


def bootstrap_ratio(sums: np.ndarray, counts: np.ndarray, repetitions: int, seed: int, level: float = 0.95, batch: int = 128) -> np.ndarray:
    """(metrics, 3): estimate and percentile bounds; clusters are rows. Draws with an empty denominator are drawn again."""
    if not (counts.sum(axis=0) > 0).all():
        raise ValueError("a metric has no eligible row")
    estimate = sums.sum(axis=0) / counts.sum(axis=0)
    n = len(sums)
    if n == 1:
        return np.stack([estimate] * 3, axis=1)
    rng = np.random.default_rng(seed)
    kept, attempts = [], 0
    have = 0
    step = max(1, DRAWS_AT_ONCE // n)
    batch = max(1, min(batch, WEIGHTS_AT_ONCE // n))
    while have < repetitions:
        attempts += 1
        if attempts > 100 + repetitions:
            raise ValueError("too many draws without eligible rows")
        wanted = min(batch, repetitions - have)
        weights = np.empty((wanted, n))
        for at in range(0, wanted, step):  # as many draws at once as stay small, in the same order of the stream
            draw = rng.integers(0, n, size=(min(step, wanted - at), n))
            for i, row in enumerate(draw):
                weights[at + i] = np.bincount(row, minlength=n)
        below = weights @ counts
        ok = (below > 0).all(axis=1)
        kept.append((weights[ok] @ sums) / below[ok])
        have += int(ok.sum())
    values = np.concatenate(kept)[:repetitions]
    tail = (1 - level) / 2
    return np.stack([estimate, np.quantile(values, tail, axis=0), np.quantile(values, 1 - tail, axis=0)], axis=1)


def intervals_numpy(df: DataFrame, keys: list[str], cluster: str, metrics: list[str], repetitions: int, seed: int, level: float = 0.95, universe: DataFrame | None = None, labels: tuple[str, ...] = ()) -> DataFrame:
    """Long table: keys, ``metric``, ``n_clusters``, ``estimate``, ``ci_lower``, ``ci_upper``.

    With ``universe`` (a table with the cluster column) clusters without eligible rows take part with zero sums; they are not laid out as rows,
    only their number travels. A cluster of the table that is not in the universe is an error when the result is computed, and so is at once more than ``MAX_UNIVERSE`` clusters. Metrics without any
    non-null value and rows without a cluster are left out. Clusters are sorted as strings before drawing, so results do not depend on partitions. ``labels`` come before
    the keys in what seeds are derived from.
    """
    stats = cluster_sums(df.filter(F.col(cluster).isNotNull()), keys, cluster, metrics).withColumn(cluster, F.col(cluster).cast("string"))
    if universe is not None:
        everyone = cut_lineage(universe.select(F.col(cluster).cast("string").alias(cluster)).filter(F.col(cluster).isNotNull()).distinct())
        size = everyone.count()
        if size > MAX_UNIVERSE:
            raise ValueError(f"{size} clusters: use the poisson engine")
        # each cluster's place in the sorted universe: places of absent clusters are what is missing
        stats = stats.join(_places(everyone, cluster), cluster, "left").drop(cluster)  # the place says it in eight bytes
    else:
        size = 0
    schema = ", ".join(f"{k} string" for k in keys) + ", metric string, n_clusters long, estimate double, ci_lower double, ci_upper double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_UNIVERSE:
            raise ValueError(f"{len(pdf)} clusters in one stratum: use the poisson engine")
        if size and pdf["_place"].isna().any():
            raise ValueError("a cluster of the table is not in the universe")
        pdf = pdf.sort_values("_place" if size else cluster)
        live = [m for m in metrics if pdf[f"c_{m}"].sum() > 0]
        if not live:
            return pd.DataFrame(columns=[*keys, "metric", "n_clusters", "estimate", "ci_lower", "ci_upper"])
        n = size or len(pdf)
        at = pdf["_place"].to_numpy(np.int64) if size else np.arange(n)
        sums, counts = np.zeros((n, len(live))), np.zeros((n, len(live)))
        sums[at], counts[at] = pdf[[f"s_{m}" for m in live]].to_numpy(float), pdf[[f"c_{m}" for m in live]].to_numpy(float)
        got = bootstrap_ratio(sums, counts, repetitions, derive_seed(seed, *labels, *map(str, key)), level)
        out = pd.DataFrame(got, columns=["estimate", "ci_lower", "ci_upper"])
        out.insert(0, "metric", live)
        out.insert(1, "n_clusters", n)
        for i, k in enumerate(keys):
            out.insert(i, k, str(key[i]))
        return out

    return stats.groupBy(*keys).applyInPandas(run, schema)


def _places(clusters: DataFrame, cluster: str) -> DataFrame:
    """``cluster`` with ``_place``, its number in the sorted order, without gathering the clusters in one task."""
    from pairscope.operators.curation import source_rows

    return source_rows(clusters.select(cluster), [cluster], "_place")


def intervals_poisson(df: DataFrame, keys: list[str], cluster: str, metrics: list[str], repetitions: int, seed: int, level: float = 0.95) -> DataFrame:
    """As ``intervals_numpy`` for universes of any size: Poisson weights by hash, summed by partial arrays."""
    stats = cluster_sums(df, keys, cluster, metrics).withColumn(cluster, F.xxhash64(F.col(cluster).cast("string")))
    n_m = len(metrics)
    schema = ", ".join(f"{k} string" for k in keys) + ", n long, tops array<double>, lows array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                state = total.setdefault(key, [0, np.zeros((repetitions + 1, n_m)), np.zeros((repetitions + 1, n_m))])
                s, c = part[[f"s_{m}" for m in metrics]].to_numpy(float), part[[f"c_{m}" for m in metrics]].to_numpy(float)
                ids = part[cluster].to_numpy(np.int64).astype(np.uint64)
                for at in range(0, len(ids), 2048):
                    x = ids[at : at + 2048][None, :] ^ (np.arange(1, repetitions + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
                    with np.errstate(over="ignore"):
                        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
                        x ^= x >> np.uint64(31)
                    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                    w = np.searchsorted(_POISSON, u.ravel()).reshape(u.shape).astype(float)  # inverse distribution
                    state[1][1:] += w @ s[at : at + 2048]
                    state[2][1:] += w @ c[at : at + 2048]
                state[0] += len(ids)
                state[1][0] += s.sum(axis=0)
                state[2][0] += c.sum(axis=0)
        if total:
            rows = [{**dict(zip(keys, map(str, k))), "n": v[0], "tops": v[1].ravel().tolist(), "lows": v[2].ravel().tolist()} for k, v in total.items()]
            yield pa.RecordBatch.from_pylist(rows)

    out_schema = ", ".join(f"{k} string" for k in keys) + ", metric string, n_clusters long, estimate double, ci_lower double, ci_upper double"

    def final(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tops = np.sum([np.asarray(t) for t in pdf["tops"]], axis=0).reshape(repetitions + 1, n_m)
        lows = np.sum([np.asarray(t) for t in pdf["lows"]], axis=0).reshape(repetitions + 1, n_m)
        rows = []
        for j, m in enumerate(metrics):
            if lows[0, j] > 0:
                v = tops[1:, j][lows[1:, j] > 0] / lows[1:, j][lows[1:, j] > 0]
                a, b = (np.quantile(v, q) if len(v) else np.nan for q in ((1 - level) / 2, (1 + level) / 2))
                rows.append((*key, m, int(pdf["n"].sum()), tops[0, j] / lows[0, j], a, b))
        return pd.DataFrame(rows, columns=[*keys, "metric", "n_clusters", "estimate", "ci_lower", "ci_upper"])

    return stats.mapInArrow(partial, schema).groupBy(*keys).applyInPandas(final, out_schema)


_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1, np.arange(1, 12)]))


_MD5_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_MD5_S = [np.uint32(x) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]


def md5_heads(prefix: bytes, start: int, stop: int) -> np.ndarray:
    """First four bytes of MD5(prefix + decimal i), as a number, for each i of start .. stop - 1; all of a length are hashed at once."""
    parts = []
    while start < stop:
        digits = len(str(start))
        end = min(stop, 10**digits)
        i, length = np.arange(start, end), len(prefix) + digits
        text = np.zeros((-(-(length + 9) // 64) * 64, end - start), dtype=np.uint8)
        text[: len(prefix)] = np.frombuffer(prefix, dtype=np.uint8)[:, None]
        for k in range(digits):
            text[len(prefix) + k] = 48 + i // 10 ** (digits - 1 - k) % 10
        text[length] = 0x80
        text[-8:] = np.frombuffer((8 * length).to_bytes(8, "little"), dtype=np.uint8)[:, None]
        words = np.ascontiguousarray(np.ascontiguousarray(text.T).view("<u4").T)
        state = [np.full(end - start, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        for at in range(0, len(words), 16):
            a, b, c, d = state
            for j in range(64):
                if j < 16:
                    f, g = d ^ (b & (c ^ d)), j
                elif j < 32:
                    f, g = c ^ (d & (b ^ c)), (5 * j + 1) % 16
                elif j < 48:
                    f, g = b ^ c ^ d, (3 * j + 5) % 16
                else:
                    f, g = c ^ (b | ~d), 7 * j % 16
                f += a
                f += _MD5_K[j]
                f += words[at + g]
                turned = f << _MD5_S[j]
                f >>= np.uint32(32) - _MD5_S[j]
                turned |= f
                turned += b
                a, b, c, d = d, turned, b, c
            state = [x + y for x, y in zip(state, (a, b, c, d))]
        parts.append(state[0].byteswap().astype(np.int64))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def intervals_hash(df: DataFrame, keys: list[str], cluster: str, metrics: list[str], repetitions: int, level: float = 0.95, universe: DataFrame | None = None, block: int = PLACES_AT_ONCE) -> DataFrame:
    """As ``intervals_numpy`` with draws from MD5(stratum|repetition|draw), for checking the estimator against another engine.

    Clusters are numbered in their order as strings. Draws without eligible rows are left out. Draws are never laid out as rows: the clusters' sums are packed by ``block``
    places of a stratum, each pack meets each range of repetitions without a shuffle, and the worker makes the draws and adds up what they hit.
    """
    stats = cluster_sums(df, keys, cluster, metrics).withColumn(cluster, F.col(cluster).cast("string"))
    everyone = cut_lineage((universe if universe is not None else df).select(F.col(cluster).cast("string").alias(cluster)).filter(F.col(cluster).isNotNull()).distinct())
    size = everyone.count()
    known = stats.dropna(subset=keys).join(_places(everyone, cluster), cluster).drop(cluster)
    numbered = known.withColumns({"_label": F.concat_ws("|", *keys), "_block": F.floor(F.col("_place") / block)})
    kinds = dict(stats.dtypes)
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        place = t.column("_place").to_numpy()
        first, span = int(place.min()), int(place.max() - place.min()) + 1
        sums, counts, there = np.zeros((len(metrics), span)), np.zeros((len(metrics), span), dtype=np.int64), np.zeros(span, dtype=np.uint8)
        there[place - first] = 1
        for k, m in enumerate(metrics):
            sums[k, place - first], counts[k, place - first] = t.column(f"s_{m}").to_numpy(), t.column(f"c_{m}").to_numpy()
        out = t.slice(0, 1).select([*keys, "_label"])
        for name, x in (("_first", pa.array([first])), ("_sums", pa.array([sums.tobytes()])), ("_counts", pa.array([counts.tobytes()])), ("_there", pa.array([there.tobytes()]))):
            out = out.append_column(name, x)
        return out

    packed = cut_lineage(numbered.groupBy(*keys, "_block").applyInArrow(pack, f"{key_schema}, _label string, _first long, _sums binary, _counts binary, _there binary"))
    step = -(-repetitions // RANGES)
    ranges = df.sparkSession.range(0, repetitions, step, -(-repetitions // step)).withColumnRenamed("id", "_from")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = lambda n: batch.column(n)[at].as_py()  # noqa: B023, E731
                label, first, start = one("_label"), one("_first"), one("_from")
                there = np.frombuffer(one("_there"), dtype=np.uint8)
                sums, counts = (np.frombuffer(one(n), dtype=kind).reshape(len(metrics), -1) for n, kind in (("_sums", np.float64), ("_counts", np.int64)))
                rows: dict[str, list] = {"rep": [], "metric": [], "hits": [], "top": [], "low": []}
                for rep in range(start, min(start + step, repetitions)):
                    hits, top, low = 0, np.zeros(len(metrics)), np.zeros(len(metrics), dtype=np.int64)
                    for lo in range(0, size, HASHES_AT_ONCE):
                        place = md5_heads("|".join([*[label] * bool(keys), str(rep), ""]).encode(), lo, min(lo + HASHES_AT_ONCE, size)) % size - first
                        if first or len(there) < size:
                            place = place[(place >= 0) & (place < len(there))]
                        hits += int(there[place].sum(dtype=np.int64))
                        top += [x[place].sum() for x in sums]
                        low += [x[place].sum() for x in counts]
                    for n, x in (("rep", [rep] * len(metrics)), ("metric", metrics), ("hits", [hits] * len(metrics)), ("top", top.tolist()), ("low", low.tolist())):
                        rows[n] += x
                same = pa.Table.from_batches([batch.slice(at, 1)]).select(keys).take(pa.array([0] * len(rows["rep"])))
                for n, x in rows.items():
                    same = same.append_column(n, pa.array(x))
                yield from same.combine_chunks().to_batches()

    drawn = packed.hint("shuffle_replicate_nl").crossJoin(ranges).mapInArrow(draw, f"{key_schema}, rep long, metric string, hits long, top double, low long")
    per = drawn.groupBy(*keys, "rep", "metric").agg(F.sum("hits").alias("hits"), F.sum("top").alias("top"), F.sum("low").alias("low")).filter(F.col("hits") > 0)
    values = per.withColumn("v", F.try_divide("top", "low"))
    tail = (1 - level) / 2
    ci = values.groupBy(*keys, "metric").agg(F.expr(f"percentile(v, {tail})").alias("ci_lower"), F.expr(f"percentile(v, {1 - tail})").alias("ci_upper"))
    ratio = lambda m: F.try_divide(F.sum(f"s_{m}"), F.sum(f"c_{m}"))
    estimates = stats.groupBy(*keys).agg(*[ratio(m).alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "estimate")
    return estimates.filter(F.col("estimate").isNotNull()).join(ci, [*keys, "metric"]).withColumn("n_clusters", F.lit(size).cast("long"))
