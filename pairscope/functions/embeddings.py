"""Embedding backends: the protocol, the form of prompts, checks of what a backend gives, the frozen-encoder contract."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.functions.vectors import synthetic_vector

#: Direction -> (query column, document column, instruction of the query)
DIRECTIONS = {
    "en_to_pt": ("translation_en", "source_pt", "Given an English answer, find the Portuguese answer it translates"),
    "pt_to_en": ("source_pt", "translation_en", "Given a Portuguese answer, find its English translation"),
}
_REVISION = re.compile(r"[0-9a-f]{40}")


class EmbeddingBackend(Protocol):
    """Loaded once a worker; encodes lists of texts to matrices with one row a text."""

    def encode_queries(self, texts: list[str], instruction: str) -> np.ndarray: ...
    def encode_documents(self, texts: list[str]) -> np.ndarray: ...


def query_prompt(instruction: str, text: str) -> str:
    """Fixed form of an instructed query, for backends that take prompts."""
    return f"Instruct: {instruction}\nQuery: {text}"


class SyntheticBackend:
    """Deterministic unit vectors from hashes; equal texts have equal vectors."""

    def __init__(self, dimension: int, seed: int = 1729):
        self.dimension, self.seed = dimension, seed

    def encode_queries(self, texts: list[str], instruction: str) -> np.ndarray:
        return np.array([synthetic_vector(t, self.dimension, self.seed, f"query\0{instruction}") for t in texts]).reshape(len(texts), self.dimension)

    def encode_documents(self, texts: list[str]) -> np.ndarray:
        return np.array([synthetic_vector(t, self.dimension, self.seed, "document") for t in texts]).reshape(len(texts), self.dimension)


def checked(matrix: np.ndarray, rows: int, dimension: int) -> np.ndarray:
    """Unit rows as float32; raises on another shape, on entries that are not finite and on zero rows."""
    m = np.asarray(matrix, dtype=np.float32)
    if m.shape != (rows, dimension):
        raise ValueError(f"the backend gave {m.shape}, expected {(rows, dimension)}")
    if not np.isfinite(m).all():
        raise ValueError("the backend gave entries that are not finite")
    norms = np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    if (norms == 0).any():
        raise ValueError("the backend gave a zero vector")
    return (m / norms).astype(np.float32)


def validate_encoder(config: dict, allowed: dict[str, str]) -> None:
    """Raise unless the encoder is one of ``allowed`` (repository -> revision), pinned to a 40-digit revision, frozen, free of remote code, normalised."""
    repository, revision = str(config.get("repository")), str(config.get("revision"))
    if not _REVISION.fullmatch(revision):
        raise ValueError("the revision must be a full commit digest")
    if allowed.get(repository) != revision:
        raise ValueError("the encoder and its revision are not on the list")
    for key, want in (("frozen", True), ("trust_remote_code", False), ("normalize_embeddings", True)):
        if bool(config.get(key)) is not want:
            raise ValueError(f"{key} must be {want}")


def embed_pairs(pairs: DataFrame, make: Callable[[], EmbeddingBackend], dimension: int, directions: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """``pair_id``, ``source_row``, ``direction``, ``query_embedding``, ``document_embedding``: two rows a pair, encoded in Arrow batches where the rows are.

    The backend is made once a task. Pairs with a null text have no row in either direction. Vectors are of fixed size, unit length and finite, or the task fails.
    """
    chosen = directions or DIRECTIONS
    columns = sorted({c for q, d, _ in chosen.values() for c in (q, d)})
    rows = pairs.select("pair_id", "source_row", *columns)
    for c in columns:
        rows = rows.filter(F.col(c).isNotNull())
    schema = pa.schema([("pair_id", pa.string()), ("source_row", pa.int64()), ("direction", pa.string()), ("query_embedding", pa.list_(pa.float32())), ("document_embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        for batch in batches:
            n = batch.num_rows
            for name in sorted(chosen):
                query, document, instruction = chosen[name]
                parts = [checked(m, n, dimension) for m in (backend.encode_queries(batch.column(query).to_pylist(), instruction), backend.encode_documents(batch.column(document).to_pylist()))]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dimension, pa.int32()), pa.array(p.ravel())) for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column("pair_id").cast(pa.string()), batch.column("source_row").cast(pa.int64()), pa.array([name] * n, pa.string()), *lists], schema=schema)

    return rows.mapInArrow(run, "pair_id string, source_row long, direction string, query_embedding array<float>, document_embedding array<float>")


def encode_udf(make: Callable[[], EmbeddingBackend], dimension: int, instruction: str | None = None):
    """A backend as an iterator UDF on a text column: queries with an instruction, else documents. Null gives null."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = make()
        for texts in batches:
            there = texts.dropna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if len(there):
                got = backend.encode_documents(there.tolist()) if instruction is None else backend.encode_queries(there.tolist(), instruction)
                out[there.index] = list(checked(got, len(there), dimension))
            yield out

    return encode
