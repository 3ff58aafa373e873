"""Hashed surrogate ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "v1"
SEPARATOR = "\x1f"


def stable_id(namespace: str, *parts: Column, version: str = VERSION) -> Column:
    """SHA-256 of version, namespace and parts; null parts count as empty, so that no part is skipped."""
    cells = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(version), F.lit(namespace), *cells), 256)


def stable_id_py(namespace: str, *parts: object, version: str = VERSION) -> str:
    """The same id on the driver."""
    text = SEPARATOR.join([version, namespace, *("" if p is None else str(p) for p in parts)])
    return hashlib.sha256(text.encode()).hexdigest()
