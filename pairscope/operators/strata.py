"""Strata and summaries: one pass over the rows, each row sown into the strata it belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.functions.text import length_band
from pairscope.operators.curation import one_per_group


def with_strata(df: DataFrame, subsets: bool = True) -> DataFrame:
    """Rows by stratum: ``stratum_type``, ``stratum_value``.

    Overall; each cohort; each prompt family; each length band; and the subsets of more than two words, more than five words and no
    exact copy. Null cohorts and families have no stratum; a null copy flag counts as no copy.
    """
    cell = lambda kind, value, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kind).alias("t"), value.cast("string").alias("v")))
    words = F.col("pt_word_count")
    cells = [cell("overall", F.lit("all")), cell("cohort", F.col("cohort_id"), F.col("cohort_id").isNotNull()), cell("prompt_family", F.col("prompt_family"), F.col("prompt_family").isNotNull()),
             cell("length_band", length_band(words), words.isNotNull())]
    if subsets:
        cells += [cell("subset", F.lit("more_than_2_words"), words > 2), cell("subset", F.lit("more_than_5_words"), words > 5),
                  cell("subset", F.lit("not_exact_copy"), ~F.coalesce(F.col("exact_normalized_copy"), F.lit(False)))]
    return df.withColumn("_s", F.explode(F.array_compact(F.array(*cells)))).select("*", F.col("_s.t").alias("stratum_type"), F.col("_s.v").alias("stratum_value")).drop("_s")


def with_one_per_response(df: DataFrame) -> DataFrame:
    """Rows of the subset with one row (the smallest pair_id) for each Portuguese duplicate group."""
    one = one_per_group(df, "pt_duplicate_group_id", "pair_id")
    return one.withColumn("stratum_type", F.lit("subset")).withColumn("stratum_value", F.lit("one_per_pt_response"))


def all_strata(df: DataFrame) -> DataFrame:
    """Rows of every stratum, that of one row for each response included."""
    return with_strata(df).unionByName(with_one_per_response(df))


def stratum_means(df: DataFrame, metrics: list[str], cluster: str = "participant_id") -> DataFrame:
    """Long summary: stratum, metric, rows, clusters, mean over non-null values. Strata without rows are absent."""
    sown = all_strata(df)
    aggs = [F.avg(F.col(m).cast("double")).alias(m) for m in metrics]
    wide = sown.groupBy("stratum_type", "stratum_value").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(cluster).alias("n_participants"), *aggs)
    return wide.unpivot(["stratum_type", "stratum_value", "n_pairs", "n_participants"], metrics, "metric", "estimate").filter(F.col("estimate").isNotNull())
