"""Evaluation passages inside a large corpus: which documents hold them, which items leaked.

Method: CGK random-walk embedding. Texts are folded to words (case, accents, punctuation and spacing go). Every window of
``window`` words, of items and of documents, is walked over with shared random bits: a step writes the word under the pointer and
moves on or stays by a bit of step and word. The embedding maps few edits to a small Hamming distance, so windows within
``max_edits`` word edits agree in most places. Bit-sampling tables hash sampled places of the walk; ``tables_for`` finds by simulation how
many are needed so that an edited window is met with the target recall. Equal windows collide in every table. An exact way handles the rest:
``max_edits + 1`` parts of a window cannot all be edited, so each part of ``LEAST_PART`` words or more is a table too, and no edited
window is missed. Windows with more words that no item has than edits are allowed are left out
before, as they can be near none. Every candidate is verified by the exact edit distance of the item's window to the best stretch of the document around the
hit, of whatever length. A window of the whole item would miss passages that are a part of it, so windows are of the size of a passage.

Items are a stated query set: their windows travel with the task, in blocks of at most ``BLOCK_WINDOWS`` windows (about 20 MB);
a larger set makes more passes over the corpus, never a larger broadcast. Documents are read once a pass, where they are, whole;
only matches leave a task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WINDOWS = 200_000
SAMPLED = 7  # places of a walk that a table hashes: enough to hold several words, as a walk may stay on one
LEAST_PART = 3  # words
MOST_TABLES = 48
FILTER_BITS = 20
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Folding(dict):
    """Characters without their accents, filled as they come."""

    def __missing__(self, code: int) -> str:
        self[code] = got = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        return got


_FOLDING = _Folding()


def words(text: str) -> list[str]:
    """Folded words of a text."""
    if not text.isascii():
        text = text.translate(_FOLDING)
    return _WORD.findall(text.casefold())


def hash_words(tokens: list[str], vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many of the words before each place are not in the vocabulary (sorted hashes)."""
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    codes, unique = pd.factorize(np.array(tokens, dtype=object))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in unique], dtype=np.uint64)
    strange = np.zeros(len(hashes), dtype=bool) if vocabulary is None else ~np.isin(hashes, vocabulary)
    return hashes[codes], np.r_[0, np.cumsum(strange[codes], dtype=np.int64)]


@lru_cache(16)
def tables_for(window: int, max_edits: int, recall: float) -> int:
    """Tables needed so that a window of ``max_edits`` edits is met with probability ``recall``: by simulation on random words, at most ``MOST_TABLES``."""
    if max_edits == 0:
        return 1
    rng = np.random.default_rng(101)
    n = 2_000
    plain = rng.integers(1, 2**63, (n, window), dtype=np.uint64)
    edited = np.zeros_like(plain)
    for row, out in zip(plain, edited):
        w = row.tolist()
        for _ in range(max_edits):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            new = [int(rng.integers(1, 2**63))]
            w = [*w[:at], *(new if kind == 0 else [*new, w[at]] if kind == 1 else []), *w[at + 1 :]]
        out[:] = [*w, *rng.integers(1, 2**63, window).tolist()][:window]  # what follows in the document
    met = np.cumsum(embed_keys(plain, MOST_TABLES) == embed_keys(edited, MOST_TABLES), axis=0) > 0
    enough = np.flatnonzero(met.mean(axis=1) >= recall)
    return int(enough[0]) + 1 if len(enough) else MOST_TABLES


def embed_keys(tokens: np.ndarray, tables: int, seed: int = 29) -> np.ndarray:
    """(tables, n) keys of windows (n, w): the sampled places of their random walks, hashed.

    Each table has a walk of its own, and every other one reads the window from its end, so that an edit near either end, after which
    a walk may not find back, spoils few tables.
    """
    n, w = tokens.shape
    keys = np.zeros((tables, n), dtype=np.uint64)
    begin = np.arange(n) * w
    places = max(3 * w // 2, SAMPLED)  # later ones lie beyond the end for most walks
    for t, key in enumerate(keys):
        rng = np.random.default_rng([seed, t])
        salt = rng.integers(1, 2**63, places, dtype=np.uint64) | np.uint64(1)
        sampled = set(rng.choice(places, SAMPLED, replace=False).tolist())
        flat = (tokens[:, ::-1] if t % 2 else tokens).ravel()
        at = begin.copy()
        with np.errstate(over="ignore"):
            for j in range(max(sampled) + 1):
                if j < w:  # no walk is beyond its window yet
                    token = flat[at]
                else:
                    token = flat[np.minimum(at, begin + w - 1)]
                    token[at >= begin + w] = 0
                if j in sampled:
                    key ^= token
                    key *= _ODD
                    key ^= key >> np.uint64(29)
                at += ((token * salt[j]) >> np.uint64(63)).astype(np.int64)
    return keys


def part_keys(tokens: np.ndarray) -> np.ndarray:
    """(1, n) keys of runs of words (n, w): all their words, hashed."""
    keys = np.zeros((1, len(tokens)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for token in tokens.T:
            keys = (keys ^ token) * _ODD
            keys ^= keys >> np.uint64(29)
    return keys


def edit_distances(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Word edits between each row of ``a`` (n, w) and the nearest stretch of the same row of ``b`` (n, m); ``limit + 1`` if there are more.

    Zero words of ``b`` are none and match nothing.
    """
    n, m = b.shape
    row = np.zeros((m + 1, n), dtype=np.int16)
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[0] = i + 1
        for j in range(m):
            new[j + 1] = np.minimum(np.minimum(row[j + 1], new[j]) + 1, row[j] + (a[:, i] != b[:, j]))
        row = new
    return np.minimum(row.min(axis=0), limit + 1)


def _windows(flat: np.ndarray, sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and owner of every window of w words that lies in one text."""
    ends = np.cumsum(sizes)
    n = np.maximum(sizes - w + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), n)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - sizes, n)
    return starts, owner


class _Table:
    """Keys of a block of item windows, sorted, with a bit filter before the search."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[keys >> np.uint64(64 - FILTER_BITS)] = True

    def meet(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, item window) of every equal pair."""
        maybe = np.flatnonzero(self.filter[keys >> np.uint64(64 - FILTER_BITS)])
        low, high = np.searchsorted(self.keys, keys[maybe], "left"), np.searchsorted(self.keys, keys[maybe], "right")
        n = high - low
        first = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else low
        return np.repeat(maybe, n), self.order[first + np.arange(n.sum())]


def leaked(
    documents: DataFrame, id_column: str, text_column: str, items: DataFrame, item_id: str, item_text: str,
    window: int = 10, max_edits: int = 1, recall: float = 0.95,
) -> DataFrame:
    """Distinct ``doc_id``, ``item_id`` with ``n_windows`` (windows of the item that are met) and ``edits`` (fewest) for every document that
    holds ``window`` words of an item within ``max_edits`` word edits (put in, left out or replaced).

    Null ids or texts take no part; items shorter than the window have no match, nor have documents shorter by more than ``max_edits``; an empty item set or corpus gives
    an empty result. Repeated documents report once. Documents of any length are read whole. Columns of other names are not read.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, n_windows long, edits int"
    ids, rows = [], []
    tables = tables_for(window, max_edits, recall)
    queries = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).dropna().dropDuplicates()
    passes: list[DataFrame] = []
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).dropna()
    out_schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("edits", pa.int32())])

    bounds = [round(window * j / (max_edits + 1)) for j in range(max_edits + 2)]
    parts = [(a, b - a) for a, b in zip(bounds, bounds[1:])] if max_edits and window // (max_edits + 1) >= LEAST_PART else []

    def search(block: np.ndarray, owners: np.ndarray) -> DataFrame:
        held = [(0, window, lambda x: embed_keys(x, tables), [_Table(k) for k in embed_keys(block, tables)])]
        held += [(offset, length, part_keys, [_Table(part_keys(block[:, offset : offset + length])[0])]) for offset, length in parts]
        vocabulary = np.unique(block)

        def candidates(flat: np.ndarray, strange: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Distinct (document, item window, where the window would begin), as each table meets them."""
            met = []
            for offset, length, keys_of, found in held:
                starts, owner = _windows(flat, sizes, length)
                # every word that no item has is an edit, so a window with more of them than edits is near no item
                able = strange[starts + length] - strange[starts] <= (max_edits if length == window else 0)
                starts, owner = starts[able], owner[able]
                for at in range(0, len(starts), 50_000):
                    first = starts[at : at + 50_000]
                    for table, keys in zip(found, keys_of(flat[first[:, None] + np.arange(length)])):
                        hit, k = table.meet(keys)
                        met.append(np.stack([owner[at + hit], k, first[hit] - offset]))
            every = np.concatenate(met, axis=1) if met else np.zeros((3, 0), np.int64)
            return tuple(np.unique(every, axis=1)) if every.shape[1] else tuple(every)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                split = [words(t) for t in batch.column("text").to_pylist()]
                flat, strange = hash_words([w for s in split for w in s], vocabulary)
                sizes = np.array([len(s) for s in split], dtype=np.int64)
                end = np.cumsum(sizes)
                doc, k, place = candidates(flat, strange, sizes)
                edits = np.full(len(doc), max_edits + 1)
                for at in range(0, len(doc), 20_000):
                    some = slice(at, at + 20_000)
                    # the document's words around the hit; none beyond its ends
                    where = place[some, None] + np.arange(-max_edits, window + max_edits)
                    inside = (where >= (end - sizes)[doc[some], None]) & (where < end[doc[some], None])
                    around = np.where(inside, flat[np.clip(where, 0, max(len(flat) - 1, 0))], np.uint64(0))
                    edits[some] = edit_distances(block[k[some]], around, max_edits)
                good = edits <= max_edits
                doc, k, edits = doc[good], k[good], edits[good]
                if not len(doc):
                    continue
                best = pd.DataFrame({"d": doc, "i": owners[k], "k": k, "e": edits}).groupby(["d", "i"], sort=True).agg(n=("k", "nunique"), e=("e", "min")).reset_index()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(best["d"].to_numpy())), pa.array(best["i"].to_numpy(), pa.int64()), pa.array(best["n"].to_numpy(), pa.int64()), pa.array(best["e"].to_numpy(), pa.int32())], schema=out_schema
                )

        return docs.mapInArrow(run, schema)

    def flush() -> None:
        if rows:
            passes.append(search(np.concatenate(rows), np.concatenate(ids)))
            rows.clear()
            ids.clear()

    held = 0
    for row in queries.orderBy("i").toLocalIterator():  # one partition at a time
        flat, _ = hash_words(words(row.t))
        starts, _ = _windows(flat, np.array([len(flat)]), window)
        if len(starts):
            if held + len(starts) > BLOCK_WINDOWS:
                flush()
                held = 0
            rows.append(flat[starts[:, None] + np.arange(window)])
            ids.append(np.full(len(starts), row.i))
            held += len(starts)
    flush()
    if not passes:
        return spark.createDataFrame([], schema)
    found = passes[0]
    for other in passes[1:]:
        found = found.unionByName(other)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min("edits").alias("edits"))
