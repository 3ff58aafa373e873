"""Mixing sources to target weights by iterative proportional fitting.

1. Every document's size in tokens of a public tokenizer, in Arrow batches where the rows are.
2. Token mass of each cell (source, language, topic): one map-side combined aggregate. Labels are put into classes first: the
   ``max_classes`` languages and topics of most tokens are classes of their own, all others one class together, so that the cells are at most
   targets x (classes + 1) x (classes + 1) many, whatever is written into the columns; only they come to the driver.
3. Raking: cell weights are scaled in turn to the source, language and topic marginals, kept at or under the source's largest
   number of repeats, and end on the source marginal, which is the one that must hold.
4. Sampling: a document of weight w is taken floor(w) times and once more with probability w - floor(w). The draw is systematic
   within salted strata of a source of about ``STRATUM_ROWS`` documents: they are laid end to end by size and taken where the running
   weight passes a whole number, so sizes are spread evenly and the tokens reached differ from the target by about one document a stratum.

The total is, unless given, the largest at which every source that has documents reaches its share within its repeats.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscope.session import cut_lineage

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# The public vocabulary's pre-tokenisation pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
STRATUM_ROWS = 20_000


@lru_cache(4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text_column: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The table with a column ``tokens``; null text counts none."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoder = _encoder(tokenizer)
        return texts.map(lambda t: len(encoder.encode_ordinary(t)) if isinstance(t, str) else 0)

    return df.withColumn("tokens", count(F.col(text_column).cast("string")))


def rake(mass: np.ndarray, cell: list[np.ndarray], targets: list[np.ndarray], cap: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of cells: ``cell[m]`` gives each cell's place in marginal m and ``targets[m]`` the token mass wanted there.

    Marginals are met in turn; weights stay at or under ``cap``; the first marginal is met last.
    """
    w = np.ones(len(mass))
    for _ in range(rounds):
        before = w.copy()
        for m in reversed(range(len(cell))):
            have = np.bincount(cell[m], weights=w * mass, minlength=len(targets[m]))
            w = np.minimum(w * np.divide(targets[m], have, out=np.ones_like(have), where=have > 0)[cell[m]], cap)
        for _ in range(30):  # what caps cut off goes to the other cells of the same source
            have = np.bincount(cell[0], weights=w * mass, minlength=len(targets[0]))
            w = np.minimum(w * np.divide(targets[0], have, out=np.ones_like(have), where=have > 0)[cell[0]], cap)
        if np.abs(w - before).max() < 1e-9:
            break
    return w


def _language(column: str):
    # spelled variants of one label: the part before a hyphen; no label and "undetermined" are one class
    lang = F.lower(F.trim(F.split(F.col(column), "[-_]")[0]))
    return F.when(lang.isNull() | (lang == "und") | (lang == ""), "und").otherwise(lang)


def _classes(sized: DataFrame, column: str, most: int) -> DataFrame:
    """Labels of most tokens (ties by label) as they are, the others as one class."""
    top = [r[column] for r in sized.groupBy(column).agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), column).limit(most).collect()]
    return sized.withColumn(column, F.when(F.col(column).isin(top), F.col(column)).otherwise(F.lit("(others)")))


def _plan(sized: DataFrame, goal: dict[str, tuple[float, int]], total: float | None) -> tuple[list[tuple], list[tuple]]:
    """Weights of cells and the report rows."""
    cells = sized.groupBy("source", "_lang", "_topic").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    mass_of: dict[str, float] = {}
    for r in cells:
        mass_of[r.source] = mass_of.get(r.source, 0) + (r.tokens or 0)
    usable = {s: (share, cap) for s, (share, cap) in goal.items() if share > 0 and cap > 0 and mass_of.get(s, 0) > 0}
    rows_of: dict[str, int] = {}
    for r in cells:
        rows_of[r.source] = rows_of.get(r.source, 0) + r.n
    report = [(s, share, cap, int(mass_of.get(s, 0)), s in usable, 1 + rows_of.get(s, 0) // STRATUM_ROWS) for s, (share, cap) in sorted(goal.items())]
    cells = [r for r in cells if r.source in usable and (r.tokens or 0) > 0]
    if not cells:
        return [], report
    reachable = min(cap * mass_of[s] / share for s, (share, cap) in usable.items())
    total = reachable if total is None else total
    sources = sorted(usable)
    mass = np.array([float(r.tokens) for r in cells])
    own = np.array([sources.index(r.source) for r in cells])
    by_source = np.array([min(usable[s][0] * total, usable[s][1] * mass_of[s]) for s in sources])
    marginals, goals = [own], [by_source]
    for column in ("_lang", "_topic"):  # language and topic keep their shares of the corpus
        names = sorted({r[column] for r in cells})
        place = np.array([names.index(r[column]) for r in cells])
        share = np.bincount(place, weights=mass)
        marginals.append(place)
        goals.append(share / share.sum() * by_source.sum())
    cap = np.array([float(usable[r.source][1]) for r in cells])
    w = rake(mass, marginals, goals, cap)
    return [(r.source, r._lang, r._topic, float(x)) for r, x in zip(cells, w)], report


def mix(
    documents: DataFrame, targets: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    lang_column: str = "lang", topic_column: str = "prompt_family", total_tokens: float | None = None, tokenizer: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken",
    max_classes: int = 32, max_targets: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    Selection: ``doc_id``, ``source``, ``tokens``, ``copies`` (1 or more) of every document taken; no document is taken more than its
    source's ``max_repeats`` times. Report: for each target source its target share, the share reached, tokens and documents.

    Sources without a target are not taken. Sources with a target but no documents are reported with share 0; the other sources keep their
    target shares relative to each other. Null or empty texts have no tokens and are not taken; null language and topic are classes of
    their own. Repeated document rows are separate documents. Empty tables give an empty selection. More than ``max_targets`` target sources are an error.
    """
    spark = documents.sparkSession
    base = documents.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), _language(lang_column).alias("_lang"),
                            F.coalesce(F.col(topic_column).cast("string"), F.lit("none")).alias("_topic"), F.col(text_column).cast("string").alias("_t")).filter(F.col("source").isNotNull())
    wanted = targets.dropna(subset=["source", "target_share", "max_repeats"]).groupBy("source").agg(F.min("target_share").alias("share"), F.min("max_repeats").alias("cap")).limit(max_targets + 1).collect()
    if len(wanted) > max_targets:
        raise ValueError(f"more than {max_targets} target sources")
    goal = {r.source: (float(r.share), max(int(r.cap), 0)) for r in wanted}
    base = base.join(F.broadcast(spark.createDataFrame([(s,) for s in goal], "source string")), "source", "left_semi")  # at most max_targets rows; other sources are not taken
    sized = cut_lineage(token_counts(base, "_t", tokenizer).drop("_t"))  # texts are read and encoded once
    for column in ("_lang", "_topic"):
        sized = _classes(sized, column, max_classes)
    weights, report = _plan(sized, goal, total_tokens)
    schema = "doc_id long, source string, tokens long, copies long"
    if not weights:
        picked = spark.createDataFrame([], schema)
    else:
        table = spark.createDataFrame(weights, "source string, _lang string, _topic string, _w double")
        caps = spark.createDataFrame([(s, int(c), k) for s, _, c, _, _, k in report], "source string, _cap long, _k long")
        # both tables hold at most (targets x classes x classes) rows
        with_w = sized.filter("tokens > 0").join(F.broadcast(table), ["source", "_lang", "_topic"]).join(F.broadcast(caps), "source")
        hashed = with_w.withColumn("_u", F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 40)))
        # a source of any size is cut into strata, so none is one task
        salted = hashed.withColumn("_s", F.pmod(F.xxhash64("doc_id", F.lit(43)), F.col("_k")))
        order = Window.partitionBy("source", "_s").orderBy("tokens", "_u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        offset = F.pmod(F.xxhash64("source", "_s"), F.lit(10_000)) / 10_000.0
        line = salted.withColumn("_run", F.sum(F.col("_w") - F.floor("_w")).over(order))
        extra = F.floor(F.col("_run") + offset) - F.floor(F.col("_run") - (F.col("_w") - F.floor("_w")) + offset)
        picked = line.withColumn("copies", F.least(F.floor("_w") + extra, F.col("_cap"))).filter("copies > 0").select("doc_id", "source", "tokens", F.col("copies").cast("long").alias("copies"))
    goal = spark.createDataFrame([r[:5] for r in report], "source string, target_share double, max_repeats long, available_tokens long, reachable boolean")
    sums = picked.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    joined = goal.join(F.broadcast(sums), "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    shares = joined.withColumn("share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0)))
    return picked, shares.select("source", "target_share", "share", "reachable", "max_repeats", "available_tokens", "tokens", "documents", "most_copies")
