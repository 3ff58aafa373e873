"""Dense vectors as arrays: norm, dot product, unit form, deterministic embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, left to right; null or shorter arrays give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def usable(v: Column) -> Column:
    """Not null, no null, NaN or infinite entry, not all zero."""
    entries = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & entries & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    """Vector of length one in double precision; a zero vector gives null."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def synthetic_vector(text: str, dimension: int, seed: int, domain: str) -> np.ndarray:
    """Deterministic unit vector: bytes of a SHA-256 counter stream mapped to [-1, 1]."""
    head = f"{seed}\0{domain}\0{text}".encode()
    raw = b"".join(hashlib.sha256(head + i.to_bytes(4, "big")).digest() for i in range(-(-dimension // 32)))[:dimension]
    v = (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 127.5) / 127.5
    return (v / np.linalg.norm(v)).astype(np.float32)


def synthetic_embedding(dimension: int, seed: int = 1729, instruction: str | None = None) -> Callable[[Column], Column]:
    """UDF factory of the deterministic backend; with an instruction it encodes queries, else documents. Null gives null."""
    domain = f"query\0{instruction}" if instruction is not None else "document"

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: synthetic_vector(t, dimension, seed, domain), na_action="ignore")

    return encode
