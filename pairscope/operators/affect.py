"""Affect profiles of texts: token networks, lexicon shares, valence, distances between profiles."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMOTIONS = ("anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust")
VALENCES = ("ambivalent", "negative", "neutral", "positive")


def shares(counts: list[Column]) -> Column:
    """Array of shares of the total; all zero if the total is zero. Null counts are zero."""
    clean = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in counts]
    total = sum(clean[1:], clean[0])
    return F.when(total > 0, F.array(*[c / total for c in clean])).otherwise(F.array(*[F.lit(0.0)] * len(clean)))


def _half(p: Column, q: Column) -> Column:
    term = lambda a, b: F.when(a > 0, a * F.log2(a / ((a + b) / 2))).otherwise(F.lit(0.0))
    return F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x)


def js_distance(p: Column, q: Column) -> Column:
    """Base-2 Jensen-Shannon distance of two share arrays. Both empty: 0; one empty: the root of one half; null gives null."""
    both = (_half(p, q) + _half(q, p)) / 2
    return F.when(p.isNull() | q.isNull(), F.lit(None).cast("double")).when((total(p) == 0) & (total(q) == 0), F.lit(0.0)).when((total(p) == 0) | (total(q) == 0), F.sqrt(F.lit(0.5))).otherwise(F.sqrt(F.greatest(both, F.lit(0.0))))


def deltas(p: Column, q: Column) -> Column:
    """Signed differences q - p."""
    return F.zip_with(q, p, lambda a, b: a - b)


def mean_abs_delta(p: Column, q: Column) -> Column:
    n = F.size(p)
    return F.when(n > 0, F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / n).otherwise(F.lit(0.0))


NONZERO = ("both_nonzero", "both_zero", "one_nonzero")


def nonzero_flags(p: Column, q: Column) -> list[Column]:
    """both nonzero, both zero, exactly one nonzero."""
    a, b = total(p) > 0, total(q) > 0
    return [(a & b).alias("both_nonzero"), (~a & ~b).alias("both_zero"), (a != b).alias("one_nonzero")]


def valence(positive: Column, negative: Column) -> Column:
    """Ambivalent before positive before negative before neutral; null flags count as false."""
    p, n = F.coalesce(positive, F.lit(False)), F.coalesce(negative, F.lit(False))
    return F.when(p & n, "ambivalent").when(p, "positive").when(n, "negative").otherwise("neutral")


def tokens(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Lower-cased words with their places."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.select(F.col(id_column).alias("id"), F.posexplode(words).alias("place", "token"))


def networks(df: DataFrame, id_column: str, text: str, max_distance: int = 2) -> DataFrame:
    """``id``, ``n_nodes``, ``n_edges``, ``density`` of the co-occurrence network of each text.

    Nodes are distinct lower-cased tokens; every pair of different tokens within ``max_distance`` places is an edge, each time it occurs, so that the
    density 2E / (N (N - 1)) may exceed 1; it is 0 for one node or none. Neighbours are read from the token array itself, so nothing is
    joined and a long text stays in one row.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = df.select(F.col(id_column).alias("id"), words.alias("_w"))
    rest = lambda d: F.greatest(F.size("_w") - d, F.lit(0))
    differ = lambda d: F.size(F.filter(F.zip_with(F.slice("_w", 1, rest(d)), F.slice("_w", d + 1, rest(d)), lambda a, b: a != b), lambda x: x))
    edges = sum((differ(d) for d in range(2, max_distance + 1)), differ(1)).cast("long")
    out = rows.select("id", F.size(F.array_distinct("_w")).cast("long").alias("n_nodes"), edges.alias("n_edges"))
    n = F.col("n_nodes")
    return out.withColumn("density", F.when(n > 1, 2.0 * F.col("n_edges") / (n * (n - 1))).otherwise(F.lit(0.0)))


_COUNTS = T.StructType([T.StructField("n_nodes", T.LongType()), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("matched", T.LongType())])
_WORDS = re.compile(r"[^\W_]+")


def _profile_udf(lexicon: dict[str, int]):
    """Distinct tokens, tokens of each of the twelve classes, tokens with an emotion. ``lexicon``: token -> bits of its emotions and valences."""
    emotions, positive, negative = (1 << len(EMOTIONS)) - 1, 1 << len(EMOTIONS), 2 << len(EMOTIONS)

    @F.pandas_udf(_COUNTS)
    def profile(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            nodes = set(_WORDS.findall(t.lower())) if isinstance(t, str) else ()
            counts, matched = [0] * (len(EMOTIONS) + len(VALENCES)), 0
            plain = 0
            for w in nodes:
                bits = lexicon.get(w, 0)
                if not bits:
                    plain += 1
                    continue
                matched += bool(bits & emotions)
                for i in range(len(EMOTIONS)):
                    counts[i] += bits >> i & 1
                p, n = bits & positive, bits & negative
                counts[len(EMOTIONS) + VALENCES.index("ambivalent" if p and n else "positive" if p else "negative" if n else "neutral")] += 1
            counts[len(EMOTIONS) + VALENCES.index("neutral")] += plain
            rows.append((len(nodes), counts, matched))
        return pd.DataFrame(rows, columns=["n_nodes", "counts", "matched"])

    return profile


def lexicon_profile(df: DataFrame, id_column: str, text: str, lexicon: DataFrame, max_lexicon: int = 200_000) -> DataFrame:
    """``id``, ``n_nodes``, emotion counts and shares, valence shares, coverages.

    ``lexicon``: token, emotion (one row for each emotion of a token; ``positive`` and ``negative`` are valences). Up to ``max_lexicon`` rows it travels
    with the task and each text is profiled where it is, in one Arrow pass; a larger one is joined to the tokens. Each text's distinct
    tokens count once. Texts without tokens, and null texts, have zero shares.
    """
    terms = lexicon.select(F.lower("token").alias("token"), "emotion").distinct()
    few = terms.limit(max_lexicon + 1).collect()
    if len(few) <= max_lexicon:
        bit = {e: 1 << i for i, e in enumerate((*EMOTIONS, "positive", "negative"))}
        words: dict[str, int] = {}
        for r in few:
            if r.token is not None and r.emotion in bit:
                words[r.token] = words.get(r.token, 0) | bit[r.emotion]
        made = df.select(F.col(id_column).alias("id"), _profile_udf(words)(F.col(text)).alias("_p"))
        names = [*EMOTIONS, *VALENCES]
        everyone = made.select("id", F.col("_p.n_nodes").alias("n_nodes"), *[F.col("_p.counts")[i].alias(f"{e}_count") for i, e in enumerate(names)], F.col("_p.matched").alias("matched_nodes"))
    else:
        everyone = _profile_by_join(df, id_column, text, terms)
    n = F.col("n_nodes")
    return everyone.select(
        "id", "n_nodes", *[f"{e}_count" for e in (*EMOTIONS, *VALENCES)], shares([F.col(f"{e}_count") for e in EMOTIONS]).alias("emotion_shares"),
        shares([F.col(f"{v}_count") for v in VALENCES]).alias("valence_shares"),
        F.when(n > 0, F.col("matched_nodes") / n).otherwise(F.lit(0.0)).alias("emotion_coverage"),
        F.when(n > 0, (n - F.col("neutral_count")) / n).otherwise(F.lit(0.0)).alias("valence_coverage"),
    )


def _profile_by_join(df: DataFrame, id_column: str, text: str, terms: DataFrame) -> DataFrame:
    nodes = tokens(df, id_column, text).select("id", "token").distinct()
    hits = nodes.join(terms, "token", "left").groupBy("id", "token").agg(
        *[F.max((F.col("emotion") == e).cast("int")).alias(e) for e in EMOTIONS],
        F.max(F.col("emotion") == "positive").alias("_p"), F.max(F.col("emotion") == "negative").alias("_n"),
    )
    kind = valence(F.col("_p"), F.col("_n"))
    some = F.greatest(*[F.coalesce(F.col(e), F.lit(0)) for e in EMOTIONS])
    per = hits.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_nodes"), *[F.sum(F.coalesce(F.col(e), F.lit(0))).alias(f"{e}_count") for e in EMOTIONS],
        *[F.count_if(kind == v).alias(f"{v}_count") for v in VALENCES], F.sum(some).alias("matched_nodes"),
    )
    return df.select(F.col(id_column).alias("id")).join(per, "id", "left").fillna(0)


FAMILIES = ("emotion", "valence")
DISTANCES = ("emotion_js_distance", "valence_js_distance", "emotion_mean_abs_delta", "valence_mean_abs_delta", "density_abs_delta")


def pair_features(pairs: DataFrame, lexicon: DataFrame, id_column: str = "pair_id", sides: dict[str, str] | None = None) -> DataFrame:
    """One row a pair: node counts, densities, shares and coverages of both texts, their signed differences and the five ``DISTANCES``.

    ``sides``: prefix -> text column, first and second (differences are second minus first). Ids must be unique. A null text counts as one without tokens.
    """
    first, second = sides or {"pt": "source_pt", "en": "translation_en"}
    columns = sides or {"pt": "source_pt", "en": "translation_en"}
    out = None
    for side, column in columns.items():
        profile = lexicon_profile(pairs, id_column, column, lexicon).select(
            F.col("id").alias(id_column), F.col("n_nodes").alias(f"{side}_n_nodes"), *[F.col(f"{f}_{x}").alias(f"{side}_{f}_{x}") for f in FAMILIES for x in ("shares", "coverage")])
        net = networks(pairs, id_column, column).select(F.col("id").alias(id_column), F.col("density").alias(f"{side}_density"))
        both = profile.join(net, id_column)
        out = both if out is None else out.join(both, id_column)
    for f in FAMILIES:
        p, q = F.col(f"{first}_{f}_shares"), F.col(f"{second}_{f}_shares")
        out = out.withColumn(f"{f}_deltas", deltas(p, q)).withColumn(f"{f}_js_distance", js_distance(p, q)).withColumn(f"{f}_mean_abs_delta", mean_abs_delta(p, q))
        out = out.withColumns({f"{f}_{name}": flag for name, flag in zip(NONZERO, nonzero_flags(p, q))})
    return out.withColumn("density_abs_delta", F.abs(F.col(f"{second}_density") - F.col(f"{first}_density")))
