"""Reference-free quality of a pair: the estimator protocol and the deterministic estimator."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QualityEstimator(Protocol):
    """Loaded once a worker; scores lists of pairs."""

    def __enter__(self) -> QualityEstimator: ...
    def __exit__(self, *_: object) -> None: ...
    def score(self, sources: list[str], translations: list[str]) -> list[float]: ...


def synthetic_quality(source: Column, translation: Column) -> Column:
    """First eight bytes of sha256(source, NUL, translation) over 2^64 - 1, in the JVM. Null gives null."""
    text = F.concat(source, F.decode(F.unhex(F.lit("00")), "UTF-8"), translation)
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551615.0)


def synthetic_quality_py(source: str, translation: str) -> float:
    return int.from_bytes(hashlib.sha256(f"{source}\0{translation}".encode()).digest()[:8], "big") / float(2**64 - 1)


def quality_udf(make: Callable[[], QualityEstimator]) -> Callable[[Column, Column], Column]:
    """A model plug-in as an iterator UDF: one model a worker, Arrow batches, finite scores required."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with make() as model:
            for source, translation in batches:
                values = pd.Series(model.score(source.tolist(), translation.tolist()), dtype="float64")
                if len(values) != len(source) or not values.map(pd.notna).all():
                    raise ValueError("the estimator must return one finite score a pair")
                yield values

    return score
