"""Duplicate-aware retrieval: the rank of each query's best positive document over the whole corpus of its direction.

The score is the cosine in double precision, rounded to nine digits, so that equal vectors tie whatever the block they are multiplied in.
Rank = documents that score higher + documents that score the same and come earlier + 1. Positives of a query are the documents of its
document-language duplicate group.

Physical plan: rows are shuffled to blocks of about ``block`` rows by their group, a block with its queries and documents is one row of a checkpoint, and
blocks meet pair by pair in a Cartesian product that reads the checkpoint: nothing is shuffled or written for a pair of blocks but its counts, added
up over the document blocks of a task. A query's best positive lies in its own block. Groups too large for that are spread over blocks; for their queries a pass
before finds the best positive, and which of them are ahead is merged over blocks as bits. All queries against all documents is what the
measure asks for; its cost is quadratic and spread evenly, its disk is not quadratic. Ranks over documents and over groups come of the same products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.functions import vectors
from pairscope.session import cut_lineage

DIGITS = 9


def usable_pairs(df: DataFrame) -> DataFrame:
    """Rows with both vectors usable, each (pair, direction) once; repeated rows count once."""
    ok = vectors.usable(F.col("query_embedding")) & vectors.usable(F.col("document_embedding"))
    first = F.min(F.struct("source_row", "query_embedding", "document_embedding")).alias("_v")
    return df.filter(ok).groupBy("pair_id", "direction").agg(first).select("pair_id", "direction", "_v.*")


def paired_cosine(df: DataFrame) -> DataFrame:
    """Cosine of each pair's query and document."""
    q, d = F.col("query_embedding"), F.col("document_embedding")
    cosine = vectors.dot(q, d) / (vectors.norm(q) * vectors.norm(d))
    return df.select("pair_id", "direction", F.round(cosine, DIGITS).alias("paired_cosine"))


_PACKED = "slot int, side int, direction string, n long, plain long, hot_names array<string>, rows binary, names array<string>, cosine binary, grps array<string>, hot binary, q binary, d binary, best binary, place binary"
_AHEAD = "slot int, docs binary, groups binary, hot_names array<string>, hot_bits binary"
_RANKED = "pair_id string, direction string, cosine double, docs long, groups long"
TILE = (64, 8_192)  # queries and documents of one product
DOC_BLOCKS = 16  # blocks of documents that one task may meet, beyond four tasks a block of queries


def _raw(x: np.ndarray, kind: type) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, dtype=kind).tobytes()], pa.binary())


def _strings(x: np.ndarray) -> pa.Array:
    return pa.array([x.tolist()], pa.list_(pa.string()))


class _Side:
    """Vectors of a block in single precision with their norms; unit vectors in double precision on demand."""

    def __init__(self, raw: bytes, n: int):
        self.x = np.frombuffer(raw, dtype=np.float32).reshape(n, -1)
        self.norm = np.concatenate([np.linalg.norm(self.x[at : at + 4096].astype(np.float64), axis=1) for at in range(0, n, 4096)])

    def unit(self, some: np.ndarray | slice) -> np.ndarray:
        return self.x[some].astype(np.float64) / self.norm[some, None]


def _exact(q: _Side, i: np.ndarray, d: _Side, j: np.ndarray) -> np.ndarray:
    """Rounded scores of the pairs (i, j), the same for the same vectors wherever they lie."""
    return np.concatenate([np.zeros(0), *[np.round(np.einsum("ij,ij->i", q.unit(i[at : at + 16_384]), d.unit(j[at : at + 16_384])), DIGITS) for at in range(0, len(i), 16_384)]])


def _best(q: _Side, mine: np.ndarray, d: _Side, members: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score and its place, of the queries ``mine`` over the documents ``members`` of their group; the earlier of equal ones."""
    members = members[np.argsort(rows[members], kind="stable")]
    top = np.zeros(len(mine), dtype=np.int64)
    step = max(1, 4_000_000 // len(members))
    for at in range(0, len(mine), step) if len(members) > 1 else ():
        top[at : at + step] = np.round(q.unit(mine[at : at + step]) @ d.unit(members).T, DIGITS).argmax(axis=1)
    return _exact(q, mine, d, members[top]), rows[members[top]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a partition's rows (slot, side, direction, pair_id, source_row, grp, hot, q, d), each query with its best positive among those of its own group."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    t = t.sort_by([("grp", "ascending"), ("source_row", "ascending")]).combine_chunks()
    column = lambda n: t.column(n).to_numpy()
    vectors_of = lambda n: t.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    rows, grps, hot, n = column("source_row").astype(np.int64), column("grp"), column("hot").astype(bool), t.num_rows
    a, b = vectors_of("q").astype(np.float64), vectors_of("d").astype(np.float64)
    dots = np.zeros((3, n))
    for k in range(a.shape[1]):  # left to right, as vectors.dot
        for at, (x, y) in enumerate(((a, b), (a, a), (b, b))):
            dots[at] += x[:, k] * y[:, k]
    raw_q, raw_d = _raw(a, np.float32), _raw(b, np.float32)
    q, d = _Side(raw_q[0].as_py(), n), _Side(raw_d[0].as_py(), n)
    starts = np.flatnonzero(np.r_[True, grps[1:] != grps[:-1]])
    sizes = np.diff(np.r_[starts, n])
    best, place = _exact(q, np.arange(n), d, np.arange(n)), rows.copy()
    for at, m in zip(starts[sizes > 1], sizes[sizes > 1]):
        members = np.arange(at, at + m)
        best[members], place[members] = _best(q, members, d, members, rows)
    first = lambda name, kind: pa.array([t.column(name)[0].as_py()], kind)
    values = [first("slot", pa.int32()), first("side", pa.int32()), first("direction", pa.string()), pa.array([n]), pa.array([int((~hot[starts]).sum())]), _strings(grps[starts][hot[starts]]), _raw(rows, np.int64), _strings(column("pair_id")),
              _raw(dots[0] / (np.sqrt(dots[1]) * np.sqrt(dots[2])), np.float64), _strings(grps), _raw(hot, np.bool_), raw_q, raw_d, _raw(best, np.float64), _raw(place, np.int64)]
    yield pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in _PACKED.split(", ")])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pairs of blocks, one after the other."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {n: batch.column(n)[at].as_py() for n in batch.schema.names}


def _hot_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best positives of a block's queries in groups that are spread over blocks."""
    for x in _met(batches):
        hot, d_hot, grps, d_grps = (np.frombuffer(x["hot"], np.bool_), np.frombuffer(x["d_hot"], np.bool_), np.array(x["grps"], object), np.array(x["d_grps"], object))
        q, d, rows = _Side(x["q"], len(hot)), _Side(x["d"], len(d_hot)), np.frombuffer(x["rows"], np.int64)
        best, place = np.full(len(hot), -np.inf), np.zeros(len(hot), np.int64)
        for g in set(grps[hot].tolist()) & set(d_grps[d_hot].tolist()):
            mine = np.flatnonzero(grps == g)
            best[mine], place[mine] = _best(q, mine, d, np.flatnonzero(d_grps == g), rows)
        yield pa.RecordBatch.from_arrays([pa.array([x["slot"]], pa.int32()), _raw(best, np.float64), _raw(place, np.int64)], names=["slot", "best", "place"])


def _hot_merge(t: pa.Table) -> pa.Table:
    best, place = (np.stack([np.frombuffer(x.as_py(), kind) for x in t.column(n)]) for n, kind in (("best", np.float64), ("place", np.int64)))
    top = best.max(axis=0)
    where = np.where(best == top, place, np.iinfo(np.int64).max).min(axis=0)
    return pa.table([t.column("slot").slice(0, 1), _raw(top, np.float64), _raw(where, np.int64)], names=["slot", "hot_best", "hot_place"])


def _count_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and groups before the best positive of each query of a block, over all document blocks that the task meets.

    Products are in single precision; a score within its error of the best positive's is computed anew in double precision.
    """
    total: dict[int, list] = {}
    for x in _met(batches):
        n, best, place, own = x["n"], np.frombuffer(x["best"], np.float64), np.frombuffer(x["place"], np.int64), np.array(x["grps"], object)
        if x["hot_best"] is not None:
            hot = np.frombuffer(x["hot"], np.bool_)
            best, place = np.where(hot, np.frombuffer(x["hot_best"], np.float64), best), np.where(hot, np.frombuffer(x["hot_place"], np.int64), place)
        names, d_hot, rows = np.array(x["d_grps"], object), np.frombuffer(x["d_hot"], np.bool_), np.frombuffer(x["rows"], np.int64)
        q, d = _Side(x["q"], n), _Side(x["d"], len(names))
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        sizes = np.diff(np.r_[starts, len(names)])
        alone = np.repeat((sizes == 1) & ~d_hot[starts], sizes)
        order = np.r_[np.flatnonzero(alone), np.flatnonzero(~alone)]  # groups of one document first, the others together
        single = int(alone.sum())
        many = starts[(sizes > 1) | d_hot[starts]]
        group_of = np.cumsum(np.r_[True, names[order[single:]][1:] != names[order[single:]][:-1]]) - 1 if len(many) else np.zeros(0, np.int64)
        number = np.searchsorted(names[starts], own)  # place of the query's group among the names here
        name_of = np.repeat(np.arange(len(starts)), sizes)
        docs, groups = np.zeros(n, np.int64), np.zeros(n, np.int64)
        seen = {str(g): np.zeros(n, bool) for g in names[many][d_hot[many]]}
        dim = q.x.shape[1]
        margin = np.float32((dim + 8) * 2.0**-23)
        columns = np.empty((dim + 1, len(names)), np.float32)
        columns[:dim], columns[dim] = d.unit(slice(None))[order].T, 1
        some = np.empty((TILE[0], dim + 1), np.float32)
        for at in range(0, n, TILE[0]):
            m = min(TILE[0], n - at)
            some[:m, :dim], some[:m, dim] = q.unit(slice(at, at + m)), -best[at : at + m]  # a product is a score less the best positive's
            shared = np.zeros((m, len(group_of)), bool)
            for lo in range(0, len(names), TILE[1]):
                hi = min(lo + TILE[1], len(names))
                s = some[:m] @ columns[:, lo:hi]
                over = s > margin
                docs[at : at + m] += [np.count_nonzero(r) for r in over]
                cut = min(max(single, lo), hi) - lo
                groups[at : at + m] += [np.count_nonzero(r) for r in over[:, :cut]]
                if cut < hi - lo:
                    shared[:, lo + cut - single : hi - single] = over[:, cut:]
                unsure = np.flatnonzero((s >= -margin) ^ over)
                if len(unsure):
                    i, j = np.divmod(unsure, hi - lo)
                    i, to = i + at, order[j + lo]
                    score = _exact(q, i, d, to)
                    tie = score == best[i]
                    docs += np.bincount(i[(score > best[i]) | (tie & (rows[to] < place[i]))], minlength=n)
                    before = (score > best[i]) | (tie & (name_of[to] < number[i]))
                    groups += np.bincount(i[before & (j + lo < single)], minlength=n)
                    late = before & (j + lo >= single)
                    shared[i[late] - at, j[late] + lo - single] = True
            if len(many):
                any_of = np.logical_or.reduceat(shared, np.flatnonzero(np.r_[True, group_of[1:] != group_of[:-1]]), axis=1)
                for k in np.flatnonzero(d_hot[many]):
                    seen[str(names[many[k]])][at : at + m] = any_of[:, k]
                groups[at : at + m] += any_of[:, ~d_hot[many]].sum(axis=1)
        state = total.setdefault(x["slot"], [np.zeros(n, np.int64), np.zeros(n, np.int64), {}])
        state[0] += docs
        state[1] += groups
        for g, bits in seen.items():
            state[2][g] = state[2].get(g, False) | bits
    for slot, (docs, groups, seen) in total.items():
        bits = np.packbits(np.stack(list(seen.values())), axis=1) if seen else np.zeros(0, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), _raw(docs, np.int32), _raw(groups, np.int32), pa.array([list(seen)], pa.list_(pa.string())), _raw(bits, np.uint8)], names=["slot", "docs", "groups", "hot_names", "hot_bits"])


def _ranked(counts: pa.Table, block: pa.Table) -> pa.Table:
    """One row a query from the counts of all tasks that met its block."""
    names = pa.array(block.column("names")[0].as_py(), pa.string())
    n = len(names)
    docs, groups, seen = np.ones(n, np.int64), np.ones(n, np.int64), {}
    for r in counts.to_pylist():
        docs += np.frombuffer(r["docs"], np.int32)
        groups += np.frombuffer(r["groups"], np.int32)
        if r["hot_names"]:
            bits = np.unpackbits(np.frombuffer(r["hot_bits"], np.uint8).reshape(len(r["hot_names"]), -1), axis=1, count=n)
            for g, x in zip(r["hot_names"], bits):
                seen[g] = seen.get(g, 0) | x
    for x in seen.values():
        groups += x
    return pa.table([names, pa.array([block.column("direction")[0].as_py()] * n, pa.string()), pa.array(np.frombuffer(block.column("cosine")[0].as_py(), np.float64)), pa.array(docs), pa.array(groups)], names=["pair_id", "direction", "cosine", "docs", "groups"])


def _hot_hashes(df: DataFrame, named: DataFrame, most: int) -> list[int]:
    """Hashes of groups with more than ``most`` rows of vectors: at most four for each block. Counted by hash, so small ones may be among them."""
    h = lambda c, pt: F.struct(F.lit(pt).alias("pt"), F.xxhash64(c).alias("h"), F.col(c).isNotNull().alias("ok"))
    either = named.select("pair_id", F.explode(F.array(h("pt_duplicate_group_id", True), h("en_duplicate_group_id", False))).alias("x")).select("pair_id", "x.*").filter("ok")
    many = either.groupBy("h").count().filter(F.col("count") > most).select("h").collect()  # of all pairs, of which only some may have vectors
    if not many:
        return []
    some = either.join(F.broadcast(df.sparkSession.createDataFrame(many, "h long")), "h", "left_semi")
    rows = df.select("pair_id", (F.col("direction") == "en_to_pt").alias("pt")).join(some.hint("shuffle_merge"), ["pair_id", "pt"])
    return [r.h for r in rows.groupBy("h").count().filter(F.col("count") > most).select("h").collect()]


def both_ranks(df: DataFrame, groups: DataFrame, block: int = 16_384) -> DataFrame:
    """``pair_id``, ``direction``, ``paired_cosine``, rank over documents and over groups (``docs``, ``groups``), and how many there are of each (``n_docs``, ``n_groups``)."""
    spark = df.sparkSession
    n = {r.direction: r["count"] for r in df.filter(F.col("direction").isNotNull()).groupBy("direction").count().collect()}  # one row a direction
    sides = {d: k for k, d in enumerate(sorted(n))}
    blocks = {d: max(math.ceil(c / block), min(4, math.ceil(c / 1024))) for d, c in n.items()}
    look = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("direction")] if of else F.lit(1)
    slots = max([1, *blocks.values()]) * max(1, len(sides))
    target = F.when(F.col("direction") == "en_to_pt", F.col("pt_duplicate_group_id")).otherwise(F.col("en_duplicate_group_id"))
    named = groups.select("pair_id", "pt_duplicate_group_id", "en_duplicate_group_id")
    # rows of a pair meet in one shuffle, which serves repeated rows and the join alike
    base = usable_pairs(df.filter(F.col("direction").isNotNull()).select("pair_id", "direction", "source_row", "query_embedding", "document_embedding").repartition("pair_id")).join(named.hint("shuffle_merge"), "pair_id")
    base = base.withColumn("grp", target).filter(F.col("grp").isNotNull())
    hot = _hot_hashes(df, named, block // 4)
    base = base.withColumn("h", F.xxhash64("grp"))
    if hot:
        base = base.join(F.broadcast(spark.createDataFrame([(h, True) for h in hot], "h long, hot boolean")), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    else:
        base = base.withColumn("hot", F.lit(False))
    place = F.pmod(F.when(F.col("hot"), F.xxhash64("pair_id")).otherwise(F.col("h")), look(blocks)).cast("int")
    side = look(sides).cast("int")
    rows = base.select((place * max(1, len(sides)) + side).alias("slot"), side.alias("side"), "direction", "pair_id", "source_row", "grp", "hot", F.col("query_embedding").alias("q"), F.col("document_embedding").alias("d"))
    packed = cut_lineage(rows.repartitionById(slots, F.col("slot")).mapInArrow(_pack, _PACKED))
    queries = packed.select("slot", "side", "n", "grps", "hot", "q", "best", "place")
    documents = packed.select(F.col("side").alias("d_side"), F.col("grps").alias("d_grps"), F.col("hot").alias("d_hot"), "rows", "d", F.size("hot_names").alias("d_spread")).coalesce(max(min(slots, 4), math.ceil(slots / DOC_BLOCKS)))
    same = F.abs(F.col("d_side") - F.col("side")) < 1  # no equality: blocks meet where they are stored, nothing is shuffled
    if hot:
        spread = packed.filter(F.size("hot_names") > 0).select("slot", "side", "grps", "hot", "q")
        met = documents.filter(F.col("d_spread") > 0).hint("shuffle_replicate_nl").join(spread, same)
        top = met.mapInArrow(_hot_best, "slot int, best binary, place binary").groupBy("slot").applyInArrow(_hot_merge, "slot int, hot_best binary, hot_place binary")
        queries = cut_lineage(queries.join(top, "slot", "left").repartitionById(slots, F.col("slot")))
    else:
        queries = queries.withColumns({"hot_best": F.lit(None).cast("binary"), "hot_place": F.lit(None).cast("binary")})
    counted = documents.hint("shuffle_replicate_nl").join(queries, same).mapInArrow(_count_ahead, _AHEAD)
    ranked = counted.groupBy("slot").cogroup(packed.select("slot", "direction", "names", "cosine").groupBy("slot")).applyInArrow(_ranked, _RANKED)
    total = packed.groupBy("direction").agg(F.sum("n").alias("n_docs"), (F.sum("plain") + F.size(F.array_distinct(F.flatten(F.collect_list("hot_names"))))).alias("n_groups"))
    return ranked.join(F.broadcast(total), "direction").select("pair_id", "direction", F.round("cosine", DIGITS).alias("paired_cosine"), "docs", "groups", "n_docs", "n_groups")  # one row a direction


def as_ranks(both: DataFrame, dedup: bool = False) -> DataFrame:
    """One of the two ranks of ``both_ranks`` in the columns of ``retrieval_ranks``."""
    rank = F.col("groups" if dedup else "docs")
    return both.select("pair_id", "direction", "paired_cosine", rank.alias("retrieval_rank"), (F.lit(1.0) / rank).alias("reciprocal_rank"), (rank <= 1).alias("hit_at_1"), (rank <= 5).alias("hit_at_5"),
                       F.col("n_groups" if dedup else "n_docs").alias("n_candidates"))


def retrieval_ranks(df: DataFrame, groups: DataFrame, block: int = 16_384, dedup: bool = False) -> DataFrame:
    """``pair_id``, ``direction``, ``paired_cosine``, ``retrieval_rank``, ``reciprocal_rank``, ``hit_at_1``, ``hit_at_5``, ``n_candidates``.

    ``df``: pair_id, source_row, direction, query_embedding, document_embedding; ``groups``: pair_id, pt_duplicate_group_id,
    en_duplicate_group_id. With ``dedup`` a candidate is a group, scored by its best member and placed by its id; else a
    document, placed by source_row. Unusable vectors and pairs without a group take no part. An empty table gives an empty result.
    """
    return as_ranks(both_ranks(df, groups, block), dedup)


def wide(ranks: DataFrame) -> DataFrame:
    """One row a pair with the columns of both directions."""
    cols = ["paired_cosine", "retrieval_rank", "reciprocal_rank", "hit_at_1", "hit_at_5"]
    aggs = [F.max(F.when(F.col("direction") == d, F.col(c))).alias(f"{c}_{d}") for d in ("en_to_pt", "pt_to_en") for c in cols]
    return ranks.groupBy("pair_id").agg(*aggs)


def summary(ranks: DataFrame) -> DataFrame:
    """Mean cosine, reciprocal rank and hit rates of each direction."""
    return ranks.groupBy("direction").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("paired_cosine"), 6).alias("mean_cosine"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg(F.col("hit_at_1").cast("double")), 6).alias("recall_at_1"), F.round(F.avg(F.col("hit_at_5").cast("double")), 6).alias("recall_at_5"),
    )


def assert_aligned(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Vectors of which every pair has exactly one row in each direction, under its own row number, all of one size; raises otherwise. Two aggregates."""
    dims = [F.size("query_embedding"), F.size("document_embedding")]
    per = vectors.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id").alias("k"), F.min(F.least(*dims)).alias("low"), F.max(F.greatest(*dims)).alias("high"))
    joined = pairs.select("pair_id", F.col("source_row").alias("_row")).join(vectors.select("pair_id", "source_row", "direction"), "pair_id")
    same = {r.direction: r.n for r in joined.filter(F.col("_row") == F.col("source_row")).groupBy("direction").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    found = {r.direction: r for r in per.collect()}
    total = pairs.count()
    for d in ("en_to_pt", "pt_to_en"):
        r = found.get(d)
        if r is None or r.n != total or r.k != total or same.get(d) != total:
            raise ValueError(f"{d} does not cover every pair once in its place")
        if r.low != r.high or r.low <= 0:
            raise ValueError(f"vectors of {d} differ in size")
    return vectors
