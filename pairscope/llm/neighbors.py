"""The k most similar vectors for every vector, by an inverted file with product-quantised residuals.

1. Fit, on a bounded sample: centroids by k-means on the unit sphere in two levels (groups, and cells inside each group), one set for each
   partition value (direction), and codebooks for the residuals (vector minus centroid) of ``SUBSPACES`` parts. The sample, and with it the
   number of cells, grows with the square root of the table; groups are made as many as keep each within a block.
2. Index every vector: nearest cell and residual code.
3. Probe: a query visits its nearest cell and each cell j whose centroid is no further than a neighbour could make up for.
   A document d of cosine >= c to the query q lies in cell j only if c * (c1 - cj).q <= sqrt(1 - c*c) * (cj - c1).u for the
   unit direction u of d across q; over directions that product spreads by |cj - c1| / sqrt(dim), so ``spread`` standard
   deviations of it bound the gap. Near queries visit one cell, queries between cells several; no fixed number of probes. A spread of
   sqrt(dim) (``EXACT``) bounds every direction: nothing is missed.
4. Score by asymmetric distance tables (query against codewords, summed by code). A score errs by at most the length of the
   document's quantisation error, so every document whose score and error reach ``min_cosine`` is reranked by the exact cosine:
   nothing of a visited cell is lost. The k best ids of a block, ties by id, are merged over the blocks.

Equal vectors are one row: a batch sends a vector once, documents with their k smallest ids (no other id can be among the k
best), queries with all their ids; a block merges the rows of equal vectors again. So copies fill no places and no task.

What is shuffled is a document once, for its group, and a query once for each group it visits (cells that lie together share a group), not for
each cell. A group that the sample shows to be larger than a block, of documents or of queries, is cut on that side by its own count, and only
then is the other side sent more than once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBSPACES = 8
CODEWORDS = 64
EXACT = math.inf  # spread at which every cell is visited that can hold a neighbour
MAX_PARTITIONS = 64  # each has a model, which travels with the tasks


@dataclass(frozen=True)
class IvfPq:
    """Fitted index of one partition value."""

    centroids: np.ndarray  # (lists, dim)
    codebooks: np.ndarray  # (subspaces, codewords, dim / subspaces)
    group: np.ndarray  # (lists,): group of each cell

    def assign(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centroids.T, axis=1)

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = unit - self.centroids[cell]
        parts = np.split(rest, len(self.codebooks), axis=1)
        codes = [np.argmin((b * b).sum(1) - 2 * (p @ b.T), axis=1) for p, b in zip(parts, self.codebooks)]
        return np.stack(codes, axis=1).astype(np.uint8)

    def probes(self, unit: np.ndarray, min_cosine: float, spread: float) -> list[np.ndarray]:
        sims = unit @ self.centroids.T
        best = sims.argmax(axis=1)
        gap = sims[np.arange(len(unit)), best][:, None] - sims
        apart = np.sqrt(np.maximum(0, ((self.centroids**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * self.centroids @ self.centroids.T)))
        reach = math.sqrt(1 - min_cosine**2) / min_cosine * min(1.0, spread / math.sqrt(unit.shape[1])) * apart[best] + 1e-6
        return [np.flatnonzero(row) for row in gap <= reach]

    def tables(self, unit: np.ndarray) -> np.ndarray:
        parts = np.split(unit, len(self.codebooks), axis=1)
        return np.stack([p @ b.T for p, b in zip(parts, self.codebooks)])  # (subspaces, queries, codewords)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, sphere: bool) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        owner = np.argmax(x @ centers.T - (0 if sphere else (centers**2).sum(1) / 2), axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, x)
        count = np.bincount(owner, minlength=len(centers))
        empty = count == 0
        centers = np.where(empty[:, None], x[rng.choice(len(x), len(centers))], sums / np.maximum(count, 1)[:, None])
        if sphere:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32)


def fit(unit: np.ndarray, lists: int, groups: int = 1, seed: int = 17) -> IvfPq:
    """Centroids in ``groups`` groups and codebooks from unit vectors."""
    rng = np.random.default_rng(seed)
    dim = unit.shape[1]
    subspaces = SUBSPACES if dim % SUBSPACES == 0 else next(s for s in (4, 2, 1) if dim % s == 0)
    tops = _kmeans(unit, groups, 8, rng, True)
    owner = np.argmax(unit @ tops.T, axis=1)
    cells, group = [], []
    for t in range(len(tops)):
        mine = unit[owner == t]
        if len(mine):
            cells.append(_kmeans(mine, max(1, min(len(mine), round(lists * len(mine) / len(unit)))), 8, rng, True))
            group.append(np.full(len(cells[-1]), len(group)))
    centroids = np.concatenate(cells)
    rest = unit - centroids[np.argmax(unit @ centroids.T, axis=1)]
    rest = rest[rng.choice(len(rest), min(len(rest), 8192), replace=False)]
    books = [_kmeans(p, CODEWORDS, 8, rng, False) for p in np.split(rest, subspaces, axis=1)]
    width = max(len(b) for b in books)
    return IvfPq(centroids, np.stack([np.pad(b, ((0, width - len(b)), (0, 0)), mode="edge") for b in books]), np.concatenate(group))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they are and the mask of usable rows: right length, no null or infinite entry, not zero."""
    usable = np.zeros(len(column), dtype=bool)
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    out = np.zeros((len(column), dim), dtype=np.float32)
    right = np.flatnonzero(sizes == dim)
    if len(right):
        flat = column.take(pa.array(right)).flatten()
        out[right] = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(right), dim)
        usable[right] = True
    norm = np.linalg.norm(out.astype(np.float64), axis=1)
    usable &= np.isfinite(norm) & (norm > 0)
    return out, usable


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def _distinct(raw: list, ids: list[list[str]], least: int | None = None) -> tuple[list[int], list[list[str]]]:
    """First position and sorted distinct ids (the ``least`` smallest) of each distinct key."""
    first: dict = {}
    held: list[set[str]] = []
    for i, (key, more) in enumerate(zip(raw, ids)):
        at = first.setdefault(key, (i, len(held)))[1]
        if at == len(held):
            held.append(set(more))
        else:
            held[at].update(more)
            if least and len(held[at]) > 64 * least:
                held[at] = set(sorted(held[at])[:least])
    return [i for i, _ in first.values()], [sorted(x)[:least] for x in held]


def _search(docs: pa.Table, queries: pa.Table, index: IvfPq, k: int, min_cosine: float) -> tuple[list[str], list[str], np.ndarray]:
    """Query ids, document ids and cosines of the k best document ids of each query, over the cells of one group."""
    dim = index.centroids.shape[1]
    at, doc_ids = _distinct(docs.column("vec").to_pylist(), docs.column("ids").to_pylist(), k)
    docs = docs.take(pa.array(at, pa.int64()))
    raw_d = np.frombuffer(b"".join(docs.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dim)
    doc_cell = np.frombuffer(b"".join(docs.column("cells").to_pylist()), dtype=np.int32)
    codes = np.frombuffer(b"".join(docs.column("code").to_pylist()), dtype=np.uint8).reshape(len(raw_d), -1)
    order = np.argsort(doc_cell, kind="stable")
    raw_d, doc_cell, codes, doc_ids = raw_d[order], doc_cell[order], codes[order], [doc_ids[i] for i in order]
    at, query_ids = _distinct(queries.column("vec").to_pylist(), queries.column("ids").to_pylist())
    queries = queries.take(pa.array(at, pa.int64()))
    raw_q = np.frombuffer(b"".join(queries.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dim)
    visits = [np.frombuffer(x, dtype=np.int32) for x in queries.column("cells").to_pylist()]
    visit_q, visit_cell = np.repeat(np.arange(len(visits)), [len(v) for v in visits]), np.concatenate(visits)
    by_cell = np.argsort(visit_cell, kind="stable")
    visit_q, visit_cell = visit_q[by_cell], visit_cell[by_cell]
    q, d = _unit(raw_q), _unit(raw_d)
    len_q, len_d = (np.linalg.norm(x.astype(np.float64), axis=1) for x in (raw_q, raw_d))
    names, number = np.unique(np.array([x for ids in doc_ids for x in ids], dtype=object), return_inverse=True)
    n_ids = np.array([len(x) for x in doc_ids])
    id_start = np.cumsum(n_ids) - n_ids
    decoded = index.centroids[doc_cell] + np.concatenate([book[codes[:, m]] for m, book in enumerate(index.codebooks)], axis=1)
    bar = (min_cosine - 1e-5 - np.linalg.norm(d - decoded, axis=1)).astype(np.float32)
    rows, cols, cosines = [], [], []
    for cell in np.unique(doc_cell):
        lo, hi = np.searchsorted(doc_cell, cell), np.searchsorted(doc_cell, cell, "right")
        who = visit_q[np.searchsorted(visit_cell, cell) : np.searchsorted(visit_cell, cell, "right")]
        for start in range(0, len(who), 512):
            mine = who[start : start + 512]
            block = q[mine]
            tables = index.tables(block)
            score = np.repeat((block @ index.centroids[cell])[:, None], hi - lo, axis=1)
            for m in range(len(tables)):
                score += tables[m].take(codes[lo:hi, m], axis=1)
            near = score >= bar[lo:hi]
            if np.count_nonzero(near) * 16 > near.size:  # many are left: one product is cheaper than as many single ones
                near &= block @ d[lo:hi].T >= np.float32(min_cosine - 1e-5)
            near_r, near_c = np.nonzero(near)
            for some in range(0, len(near_r), 65_536):
                r, c = mine[near_r[some : some + 65_536]], near_c[some : some + 65_536] + lo
                exact = np.einsum("ij,ij->i", raw_q[r].astype(np.float64), raw_d[c].astype(np.float64)) / (len_q[r] * len_d[c])
                good = exact >= min_cosine
                rows.append(r[good])
                cols.append(c[good])
                cosines.append(exact[good])
    if not rows:
        return [], [], np.zeros(0)
    r, c, s = map(np.concatenate, (rows, cols, cosines))
    rep = np.repeat(np.arange(len(r)), n_ids[c])
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(n_ids[c]) - n_ids[c], n_ids[c])
    r, s, who = r[rep], s[rep], number[id_start[c[rep]] + nth]
    order = np.lexsort((who, -s, r))
    r, s, who = r[order], s[order], who[order]
    if len(names) < n_ids.sum():  # an id with several vectors counts with its best
        once = np.sort(np.unique(r * len(names) + who, return_index=True)[1])
        r, s, who = r[once], s[once], who[once]
    start = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    top = np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0)) < k
    r, s, who = r[top], s[top], who[top]
    copies = np.array([len(x) for x in query_ids])[r]
    rep = np.repeat(np.arange(len(r)), copies)
    return [x for i in r for x in query_ids[i]], names[who[rep]].tolist(), s[rep]


def top_neighbors(
    df: DataFrame,
    id_column: str,
    partition_column: str,
    query_column: str,
    document_column: str,
    k: int = 5,
    min_cosine: float = 0.9,
    sample_rows: int = 16_384,
    rows_per_list: int = 512,
    spread: float = 1.2,
    block_rows: int = 16_384,
) -> DataFrame:
    """``partition``, ``query_id``, ``document_id``, ``cosine``, ``place`` of the k nearest documents of each query.

    Null vectors, vectors with null or infinite entries, zero vectors and vectors of another length than most take no part.
    Vectors need not be of unit length. Repeated rows count once (a document by its id, with its best cosine). Equal cosines
    are ordered by document id. Null ids or partitions take no part. A table without usable vectors gives an empty result, one with
    more than ``MAX_PARTITIONS`` partition values an error.

    ``sample_rows`` (or 32 times the square root of a partition's rows, if that is more) bounds the rows fitted on (a hash sample, for each
    partition value); all rows are indexed and all are queries. With ``spread=EXACT`` the result is exact.
    """
    spark = df.sparkSession
    schema = "partition string, query_id string, document_id string, cosine double"
    base = df.select(
        F.col(partition_column).cast("string").alias("part"), F.col(id_column).cast("string").alias("id"),
        F.col(query_column).cast("array<float>").alias("q"), F.col(document_column).cast("array<float>").alias("d"),
    ).filter(F.col("part").isNotNull() & F.col("id").isNotNull())
    usable = F.col("d").isNotNull() | F.col("q").isNotNull()
    facts = base.filter(usable).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.mode(F.size(F.coalesce("d", "q"))).alias("dim")).limit(MAX_PARTITIONS + 1).collect()  # one row a direction
    if len(facts) > MAX_PARTITIONS:
        raise ValueError(f"more than {MAX_PARTITIONS} values of {partition_column}")
    want = {r.part: max(sample_rows, int(32 * math.sqrt(r.n))) for r in facts}
    share = {r.part: min(1.0, want[r.part] / r.n) for r in facts}
    models: dict[str, IvfPq] = {}
    doc_blocks: dict[int, int] = {}  # blocks of the groups that the sample shows to be large
    query_blocks: dict[int, int] = {}
    names = sorted(share)
    code_of = {p: i for i, p in enumerate(names)}
    wide = 1 << 24  # more than the groups of any partition
    if facts:
        part_share = F.create_map(*[F.lit(x) for p in names for x in (p, int(share[p] * 1_000_000) + 1)])[F.col("part")]
        # by vector and id, so that neither hides a hot one; repeated rows once
        picked = base.filter(usable & (F.pmod(F.xxhash64("id", "d", "q", F.lit(3)), F.lit(1_000_000)) < part_share)).distinct()
        sample = picked.select("part", "q", "d").limit(2 * sum(want.values())).toArrow()
        sample_part = np.array(sample.column("part").to_pylist(), dtype=object)
        for row in facts:
            mine = pa.array(np.flatnonzero(sample_part == row.part))
            raw, ok = _matrix(sample.column("d").combine_chunks().take(mine), row.dim)
            if not ok.any():
                continue
            unit = _unit(raw[ok])
            lists = max(1, min(row.n // rows_per_list, len(unit) // 16))
            groups = min(lists, max(round(math.sqrt(lists) / 2), math.ceil(1.5 * row.n / block_rows)))
            model = models[row.part] = fit(unit, lists, groups)
            raw, ok = _matrix(sample.column("q").combine_chunks().take(mine), row.dim)
            seen_d = np.bincount(model.group[model.assign(unit)]) / share[row.part]
            seen_q = np.zeros(1)
            if ok.any():
                visits = [np.unique(model.group[x]) for x in model.probes(_unit(raw[ok]), min_cosine, spread)]
                seen_q = np.bincount(np.concatenate(visits)) / share[row.part]
            for seen, blocks, size in ((seen_d, doc_blocks, 2 * block_rows), (seen_q, query_blocks, 4 * block_rows)):
                blocks.update({code_of[row.part] * wide + int(g): math.ceil(seen[g] / size) for g in np.flatnonzero(seen > size)})
    if not models:
        return spark.createDataFrame([], schema + ", place int")

    side = pa.schema([("cell_group", pa.int64()), ("cells", pa.binary()), ("ids", pa.list_(pa.string())), ("vec", pa.binary()), ("code", pa.binary())])

    def place(column: str, is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = np.array(batch.column("part").to_pylist(), dtype=object)
                ids = batch.column("id")
                for p, model in models.items():
                    mine = np.flatnonzero(parts == p)
                    if not len(mine):
                        continue
                    vectors, ok = _matrix(batch.column(column).take(pa.array(mine)), model.centroids.shape[1])
                    vectors, mine = vectors[ok], mine[ok]
                    if not len(mine):
                        continue
                    raw = [v.tobytes() for v in vectors]
                    at, names_of = _distinct(raw, [[x] for x in ids.take(pa.array(mine)).to_pylist()], None if is_query else k)
                    unit, raw = _unit(vectors[at]), [raw[i] for i in at]
                    if is_query:
                        rep, groups, cells = [], [], []
                        for i, visited in enumerate(model.probes(unit, min_cosine, spread)):
                            group = model.group[visited]
                            for g in np.unique(group):
                                rep.append(i)
                                groups.append(int(g))
                                cells.append(visited[group == g].astype(np.int32).tobytes())
                        codes = [b""] * len(rep)
                    else:
                        rep = range(len(unit))
                        owner = model.assign(unit)
                        groups = model.group[owner]
                        cells = [c.tobytes() for c in owner.astype(np.int32)]
                        codes = [c.tobytes() for c in model.encode(unit, owner)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(groups, dtype=np.int64) + code_of[p] * wide), pa.array(cells, pa.binary()), pa.array([names_of[i] for i in rep], pa.list_(pa.string())), pa.array([raw[i] for i in rep], pa.binary()), pa.array(codes, pa.binary())], schema=side
                    )

        return run

    ddl = "cell_group long, cells binary, ids array<string>, vec binary, code binary"
    docs = base.filter(F.col("d").isNotNull()).select("part", "id", "d").mapInArrow(place("d", False), ddl)
    queries = base.filter(F.col("q").isNotNull()).select("part", "id", "q").mapInArrow(place("q", True), ddl)

    def number_of(blocks: dict[int, int]):
        """Blocks of a row's group on one side; the maps hold at most (groups) entries, bounded by the sample."""
        return F.coalesce(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("cell_group")], F.lit(1)) if blocks else F.lit(1)

    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    own = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")  # noqa: E731  of the type of ``every``, or equal keys would part
    keys = ["cell_group"]
    if doc_blocks or query_blocks:
        n_d, n_q = number_of(doc_blocks), number_of(query_blocks)
        docs = docs.withColumn("db", own("vec", n_d)).withColumn("qb", every(n_q))  # equal vectors meet in one block
        queries = queries.withColumn("qb", own("ids", n_q)).withColumn("db", every(n_d))  # ids of a hot vector are spread
        keys = ["cell_group", "db", "qb"]
    out_schema = pa.schema([("partition", pa.string()), ("query_id", pa.string()), ("document_id", pa.string()), ("cosine", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        part = names[left.column("cell_group")[0].as_py() // wide]
        query_ids, doc_ids, s = _search(left, right, models[part], k, min_cosine)
        return pa.table([pa.array([part] * len(s), pa.string()), pa.array(query_ids, pa.string()), pa.array(doc_ids, pa.string()), pa.array(s)], schema=out_schema)

    found = docs.groupBy(*keys).cogroup(queries.drop("code").groupBy(*keys)).applyInArrow(search, schema)
    # at most (visited blocks x k) rows a query: sorted, repeated documents left out and cut inside one array
    best = found.groupBy("partition", "query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "document_id"))).alias("_all"))
    again = lambda x, i: F.exists(F.slice("_all", 1, i), lambda y: y["document_id"] == x["document_id"])
    once = F.when(F.size(F.array_distinct("_all.document_id")) == F.size("_all"), F.col("_all")).otherwise(F.filter("_all", lambda x, i: ~again(x, i)))
    return best.select("partition", "query_id", F.posexplode(F.slice(once, 1, k)).alias("place", "_d")).select(
        "partition", "query_id", F.col("_d.document_id").alias("document_id"), (-F.col("_d.far")).alias("cosine"), (F.col("place") + 1).cast(T.IntegerType()).alias("place")
    )
