"""The analysis frame and its summaries: strata, language-matched, length, retrieval, encoder and affect sensitivities.

Every summary is a set of (keys, metrics) cells over the frame. Estimates are plain aggregates; intervals are those of the cluster bootstrap
over all clusters of the frame, with seeds derived from the name of the summary and its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.contracts import ContractError
from pairscope.functions.text import length_band
from pairscope.operators import affect, sensitivity, strata
from pairscope.operators.resampling import intervals_numpy

DIRECTIONS = ("en_to_pt", "pt_to_en")
DIRECTIONAL = tuple(f"{m}_{d}" for d in DIRECTIONS for m in ("paired_cosine", "hit_at_1", "hit_at_5", "reciprocal_rank"))
METRICS = ("score", *affect.DISTANCES, *DIRECTIONAL)
META = ("pair_id", "participant_id", "cohort_id", "prompt_family", "pt_word_count", "exact_normalized_copy", "pt_duplicate_group_id", "en_duplicate_group_id")
#: Predictors of the quality score.
DESIGN = ("paired_cosine_en_to_pt", "paired_cosine_pt_to_en", *affect.DISTANCES, "log1p_pt_word_count")


def frame(pairs: DataFrame, wide: DataFrame, scores: DataFrame, features: DataFrame, check: bool = False) -> DataFrame:
    """One row for each pair that has retrieval in both directions, a score and affect features; metrics as doubles.

    With ``check`` a repeated pair or a null metric is an error (one aggregate).
    """
    both = wide.filter(F.col("retrieval_rank_en_to_pt").isNotNull() & F.col("retrieval_rank_pt_to_en").isNotNull())
    out = pairs.select(*META).join(both.select("pair_id", *[F.col(c).cast("double").alias(c) for c in DIRECTIONAL]), "pair_id")
    out = out.join(scores.select("pair_id", F.col("score").cast("double").alias("score")).filter(F.col("score").isNotNull()), "pair_id").join(features, "pair_id")
    if check:
        got = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id").alias("k"), *[F.count_if(F.col(m).isNull() | F.isnan(m)).alias(m) for m in METRICS]).first()
        if got.n != got.k:
            raise ContractError(f"{got.n - got.k} repeated pairs")
        if bad := {m: got[m] for m in METRICS if got[m]}:
            raise ContractError(f"nulls in {bad}")
    return out


def estimates(df: DataFrame, keys: list[str], metrics: list[str], cluster: str = "participant_id") -> DataFrame:
    """Long table: keys, ``n_pairs``, ``n_participants``, ``metric``, ``estimate`` (mean of the non-null values)."""
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(cluster).alias("n_participants"), *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    return wide.unpivot([*keys, "n_pairs", "n_participants"], metrics, "metric", "estimate").filter(F.col("estimate").isNotNull())


def with_intervals(df: DataFrame, keys: list[str], metrics: list[str], universe: DataFrame, name: str, repetitions: int, seed: int, cluster: str = "participant_id") -> DataFrame:
    """``estimates`` with ``n_clusters``, ``ci_lower`` and ``ci_upper``; the seed comes of ``name`` and the keys."""
    narrow = df.select(*keys, cluster, *[F.col(m).cast("double").alias(m) for m in metrics])
    intervals = intervals_numpy(narrow, keys, cluster, metrics, repetitions, seed, universe=universe, labels=(name,)).drop("estimate")
    return estimates(df, keys, metrics, cluster).join(intervals, [*keys, "metric"])


# --- the cells of each summary: (rows with keys, keys, metrics) ---------------------------------------------------


def strata_cells(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """All strata, the fourteen metrics."""
    return strata.all_strata(df), ["stratum_type", "stratum_value"], list(METRICS)


def matched_cells(df: DataFrame, flags: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Pairs whose both languages match, the fourteen metrics. ``flags``: pair_id and ``flag_both_match``."""
    kept = df.join(flags.filter(F.col("flag_both_match")).select("pair_id"), "pair_id", "left_semi")
    return kept.withColumn("subset", F.lit("both_languages_match")), ["subset"], list(METRICS)


def length_cells(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """First-rank rates by length band."""
    return df.withColumn("length_band", length_band(F.col("pt_word_count"))).filter(F.col("length_band").isNotNull()), ["length_band"], [f"hit_at_1_{d}" for d in DIRECTIONS]


def retrieval_cells(ranks: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Reciprocal rank and hit rates of another construction of retrieval, by direction, with its candidates."""
    rows = ranks.select("pair_id", "direction", "n_candidates", *[F.col(m).cast("double").alias(m) for m in ("reciprocal_rank", "hit_at_1", "hit_at_5")])
    return rows.join(pairs.select("pair_id", "participant_id"), "pair_id"), ["direction", "n_candidates"], ["reciprocal_rank", "hit_at_1", "hit_at_5"]


def encoder_cells(primary: DataFrame, comparison: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Comparison minus primary, by direction, of pairs present in both."""
    metrics = ["paired_cosine", "reciprocal_rank", "hit_at_1", "hit_at_5"]
    number = lambda d: d.select("pair_id", "direction", *[F.col(m).cast("double").alias(m) for m in metrics])
    rows = sensitivity.encoder_differences(number(primary), number(comparison), metrics)
    return rows.join(pairs.select("pair_id", "participant_id"), "pair_id"), ["direction"], [f"delta_{m}" for m in metrics]


def nonzero_cells(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Distances of each family over pairs whose both profiles of the family are not empty."""
    rows = None
    for f in affect.FAMILIES:
        mine = df.filter(F.col(f"{f}_both_nonzero")).select("participant_id", F.lit(f).alias("family"), F.col(f"{f}_js_distance").alias("js_distance"), F.col(f"{f}_mean_abs_delta").alias("mean_abs_delta"))
        rows = mine if rows is None else rows.unionByName(mine)
    return rows, ["family"], ["js_distance", "mean_abs_delta"]


def coverage_flags(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Eleven coverage diagnostics of each family and two of empty networks."""
    made = {}
    for f in affect.FAMILIES:
        for side in ("pt", "en"):
            full = affect.total(F.col(f"{side}_{f}_shares")) > 0
            covered = F.col(f"{side}_{f}_coverage") > 0
            made[f"{side}_{f}_profile_nonzero"] = full
            made[f"{side}_{f}_lexicon_coverage"] = F.col(f"{side}_{f}_coverage")
            made[f"{side}_{f}_lexicon_coverage_nonzero"] = covered
            made[f"{side}_{f}_coverage_profile_disagreement"] = covered != full
        for name in affect.NONZERO:
            made[f"{f}_{name}"] = F.col(f"{f}_{name}")
    for side in ("pt", "en"):
        made[f"{side}_nodes_zero"] = F.col(f"{side}_n_nodes") == 0
    return df.withColumns({k: v.cast("double") for k, v in made.items()}), list(made)


def coverage_cells(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """The coverage diagnostics, overall and by length band."""
    rows, flags = coverage_flags(df)
    return sensitivity.with_bands(rows), ["stratum_type", "stratum_value"], flags


def named_counts(df: DataFrame, language: DataFrame, candidates: DataFrame) -> DataFrame:
    """The thirteen counts that a run is accepted by, one row each: ``name``, ``actual``.

    ``language``: flags of the verified pairs; ``candidates``: direction and ``n_groups``, the targets after duplicates are merged.
    """
    rows, _ = coverage_flags(df)
    both, bad = F.col("flag_both_match"), F.col("flag_pt_explicit_mismatch") | F.col("flag_en_explicit_mismatch")
    hit = lambda c: F.count_if(F.col(c) == 1.0)
    parts = [
        rows.agg(F.count(F.lit(1)).alias("paired_rows"), hit("emotion_both_nonzero").alias("emotion_both_nonzero_pairs"),
                 F.count_distinct(F.when(F.col("emotion_both_nonzero") == 1.0, F.col("participant_id"))).alias("emotion_both_nonzero_clusters"), hit("valence_both_nonzero").alias("valence_both_nonzero_pairs"),
                 hit("pt_nodes_zero").alias("pt_nodes_zero"), hit("en_nodes_zero").alias("en_nodes_zero"),
                 *[hit(f"{s}_emotion_coverage_profile_disagreement").alias(f"{s}_emotion_coverage_profile_disagreement") for s in ("pt", "en")]),
        language.agg(F.count_if(both).alias("language_both_expected"), F.count_if(~both & ~bad).alias("language_ambiguous_only"), F.count_if(bad).alias("language_explicit_mismatch")),
        candidates.agg(*[F.max(F.when(F.col("direction") == d, F.col("n_groups"))).alias(f"target_candidates_{d}") for d in DIRECTIONS]),
    ]
    out = None
    for p in parts:  # one row each
        long = p.unpivot([], p.columns, "name", "actual")
        out = long if out is None else out.unionByName(long)
    return out
