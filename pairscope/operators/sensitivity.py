"""Sensitivity package: language-matched estimates, coverage flags, length bands, encoder differences, affect coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.functions.text import length_band
from pairscope.operators.resampling import intervals_numpy

LANGUAGE_FLAGS = (
    "pt_matches_expected", "en_matches_expected", "both_match", "pt_ambiguous", "en_ambiguous", "either_ambiguous", "pt_explicit_mismatch", "en_explicit_mismatch", "ambiguous_only",
)


def language_flags(df: DataFrame) -> DataFrame:
    """Nine flags of a verification row; null inputs count as false."""
    c = lambda name: F.coalesce(F.col(name), F.lit(False))
    pt, en, pa, ea = c("pt_matches_expected"), c("en_matches_expected"), c("pt_ambiguous"), c("en_ambiguous")
    pt_bad, en_bad = ~pt & ~pa, ~en & ~ea
    flags: list[Column] = [pt, en, pt & en, pa, ea, pa | ea, pt_bad, en_bad, (pa | ea) & ~pt_bad & ~en_bad]
    return df.select("*", *[f.alias(f"flag_{n}") for n, f in zip(LANGUAGE_FLAGS, flags)])


def with_bands(df: DataFrame, words: str = "pt_word_count") -> DataFrame:
    """Each row in ``overall`` and in its length band."""
    cells = F.array(F.struct(F.lit("overall").alias("t"), F.lit("all").alias("v")), F.struct(F.lit("length_band").alias("t"), length_band(F.col(words)).alias("v")))
    return df.withColumn("_c", F.explode(cells)).filter(F.col("_c.v").isNotNull()).select("*", F.col("_c.t").alias("stratum_type"), F.col("_c.v").alias("stratum_value")).drop("_c")


def flag_rates(df: DataFrame, flags: list[str], words: str = "pt_word_count", cluster: str = "participant_id") -> DataFrame:
    """Rows, clusters and rate of each flag, overall and by length band."""
    aggs = [F.avg(F.col(f).cast("double")).alias(f) for f in flags]
    rates = with_bands(df, words).groupBy("stratum_type", "stratum_value").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(cluster).alias("n_participants"), *aggs)
    return rates.unpivot(["stratum_type", "stratum_value", "n_pairs", "n_participants"], flags, "flag", "rate")


def flag_intervals(df: DataFrame, flags: list[str], repetitions: int, seed: int, words: str = "pt_word_count", cluster: str = "participant_id") -> DataFrame:
    """As ``flag_rates`` with cluster-bootstrap intervals; the universe is all clusters of the table."""
    values = df.select(cluster, words, *[F.col(f).cast("double").alias(f) for f in flags])
    return intervals_numpy(with_bands(values, words), ["stratum_type", "stratum_value"], cluster, flags, repetitions, seed, universe=df)


def flag_cells(df: DataFrame, words: str = "pt_word_count", cluster: str = "participant_id") -> tuple[DataFrame, list[str], list[str]]:
    """Rows, keys and metrics of the language flags, overall and by length band."""
    flags = [f"flag_{n}" for n in LANGUAGE_FLAGS]
    return with_bands(df.select(cluster, words, *[F.col(f).cast("double").alias(f) for f in flags]), words), ["stratum_type", "stratum_value"], flags


def matched_means(df: DataFrame, metrics: list[str], cluster: str = "participant_id") -> DataFrame:
    """Means over pairs whose both languages match; ``n_universe`` counts the clusters of all pairs."""
    kept = df.filter(F.col("flag_both_match"))
    universe = df.agg(F.count_distinct(cluster).alias("n_universe"))
    means = kept.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(cluster).alias("n_participants"), *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    return means.join(universe).unpivot(["n_pairs", "n_participants", "n_universe"], metrics, "metric", "estimate")  # one row each


def encoder_differences(primary: DataFrame, comparison: DataFrame, metrics: list[str]) -> DataFrame:
    """Comparison minus primary for each pair and direction present in both."""
    keys = ["pair_id", "direction"]
    a = primary.select(*keys, *[F.col(m).cast("double").alias(f"_a_{m}") for m in metrics])
    b = comparison.select(*keys, *[F.col(m).cast("double").alias(f"_b_{m}") for m in metrics])
    return a.join(b, keys).select(*keys, *[(F.col(f"_b_{m}") - F.col(f"_a_{m}")).alias(f"delta_{m}") for m in metrics])


def acceptance_counts(df: DataFrame, named: dict[str, Column], expected: dict[str, int] | None = None) -> DataFrame:
    """Named counts in one aggregate; with ``expected`` a second column tells whether each agrees."""
    row = df.agg(*[F.count_if(c).alias(n) for n, c in named.items()])
    long = row.unpivot([], list(named), "name", "actual")
    if expected is None:
        return long
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("name")]
    return long.withColumn("expected", want.cast("long")).withColumn("agrees", F.col("actual") == want.cast("long"))
