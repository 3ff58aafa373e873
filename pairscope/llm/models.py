"""Fitted models kept beside the checkpoints: fitted once for given tables and parameters, then loaded.

The key of a model is a fingerprint of its name, its parameters, the source of the modules it is made by and the files of the tables it is
fitted on (path, length, time of change). A changed file, parameter or line of code gives another key, so a stale model is never loaded.
A model is written as one row of a Parquet table in the shared checkpoint folder, so every driver of the cluster finds it.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable
from pathlib import Path
from types import ModuleType

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from pairscope.session import checkpoint_root

Arrays = dict[str, np.ndarray]


def fingerprint(name: str, tables: list[DataFrame], params: dict, modules: list[ModuleType]) -> str:
    """Hex digest of everything a fit depends on. Tables that are not read from files give a key of their own plan."""
    spark = tables[0].sparkSession
    parts: list = [name, sorted(params.items())]
    parts += [hashlib.sha256(Path(m.__file__).read_bytes()).hexdigest() for m in modules]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for t in tables:
        files = sorted(t.inputFiles())
        parts.append(t.columns)
        if not files:
            parts.append(t._jdf.queryExecution().analyzed().toString())
        for f in files:
            path = jvm.org.apache.hadoop.fs.Path(f)
            status = path.getFileSystem(conf).getFileStatus(path)
            parts.append([f, status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()[:32]


def _pack(arrays: Arrays) -> bytearray:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return bytearray(out.getvalue())


def _unpack(raw: bytes) -> Arrays:
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def _read(spark: SparkSession, path: str) -> Arrays | None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    try:
        if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            return None
        return _unpack(spark.read.parquet(path).first()["model"])
    except (Py4JError, PySparkException, ValueError, TypeError):  # a model that cannot be read is fitted anew
        return None


def stored(name: str, tables: list[DataFrame], params: dict, modules: list[ModuleType], fit: Callable[[], Arrays]) -> Arrays:
    """Arrays of the model with this fingerprint, fitted and written if there is none."""
    spark = tables[0].sparkSession
    # the folder above the one of this application's checkpoints, which has a name of its own
    path = f"{checkpoint_root(spark).rsplit('/', 1)[0]}/models/{name}-{fingerprint(name, tables, params, modules)}"
    if (got := _read(spark, path)) is not None:
        return got
    arrays = fit()
    spark.createDataFrame([(_pack(arrays),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return arrays
