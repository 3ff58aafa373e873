"""Cohort curation: duplicates, complete groups, prompts, participants, splits, lineage, audits.

Deterministic keep-first everywhere (``row_number`` over a stated order, or ``min_by``), never ``dropDuplicates`` on part of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``, ties by all other columns. Null keys are a key.

    Aggregation with ``min`` of a struct instead of a window: it combines on the map side, so a hot key costs each
    input split one row.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def with_group_size(df: DataFrame, keys: list[str], name: str, hot_share: float = 0.001) -> DataFrame:
    """The table with each row's group size. Null keys get null.

    Sizes are counted with map-side combining. Groups of at least ``hot_share`` of all rows, of which there are at most ``1 / hot_share``, are
    broadcast, so that their rows are never gathered; rows of the other groups are joined, where no key holds more than that share.
    """
    known = df.filter(F.greatest(*[F.col(k).isNull() for k in keys]) == F.lit(False)) if len(keys) > 1 else df.filter(F.col(keys[0]).isNotNull())
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    least = max(int(df.count() * hot_share), 1000)
    hot = sizes.filter(F.col(name) >= least).withColumnRenamed(name, "_hot")
    marked = df.join(F.broadcast(hot), keys, "left")  # at most 1 / hot_share rows
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot").join(sizes.filter(F.col(name) < least), keys, "left")
    columns = [*df.columns, name]
    return marked.filter(F.col("_hot").isNotNull()).withColumnRenamed("_hot", name).select(*columns).unionByName(rest.select(*columns))


def attach_counts(df: DataFrame, keys: list[str], record_keys: list[str], translation: str) -> DataFrame:
    """Every row with ``ingestion_record_count`` (rows of its ``record_keys``) and ``translation_variant_count`` (distinct translations of its ``keys``).

    Both are counted with map-side combining and joined to the rows; null keys are keys like any other (null-safe).
    """
    counts = df.groupBy(*record_keys).agg(F.count(F.lit(1)).alias("ingestion_record_count"))
    variants = df.groupBy(*keys).agg(F.count_distinct(translation).alias("translation_variant_count"))
    same = lambda a, b, ks: [a[k].eqNullSafe(b[f"_{k}"]) for k in ks]
    renamed = lambda d, ks: d.select(*[F.col(k).alias(f"_{k}") for k in ks], *[c for c in d.columns if c not in ks])
    c, v = renamed(counts, record_keys), renamed(variants, keys)
    out = df.join(c, same(df, c, record_keys), "left").drop(*[f"_{k}" for k in record_keys])
    return out.join(v, same(out, v, keys), "left").drop(*[f"_{k}" for k in keys])


def complete_groups(df: DataFrame, keys: list[str], item: str, size: int = 3) -> DataFrame:
    """Rows of the groups that hold exactly ``size`` distinct items; a semi-join, so no column is added. Null items do not count."""
    whole = df.groupBy(*keys).agg(F.count_distinct(item).alias("_n")).filter(F.col("_n") == size).select(*keys)
    return df.join(whole, keys, "left_semi")


def translation_variants(df: DataFrame, keys: list[str], translation: str) -> DataFrame:
    """Distinct translations of each source: ``n_variants``, and ``n_records``."""
    return df.groupBy(*keys).agg(F.count_distinct(translation).alias("n_variants"), F.count(F.lit(1)).alias("n_records"))


def participants(df: DataFrame) -> DataFrame:
    return df.select("participant_id", "cohort_id", "year").distinct()


def prompts(df: DataFrame) -> DataFrame:
    return df.select(F.concat("cohort_id", F.lit("_q"), F.col("question_index").cast("string")).alias("prompt_id"), "cohort_id", "year", "question_index", "prompt_family").distinct()


def splits_leave_one_out(df: DataFrame, folds: list[str]) -> DataFrame:
    """A row for each participant and fold: held-out if the participant is of the fold's cohort, else train. Folds are few and given."""
    fold = F.explode(F.array(*[F.lit(f) for f in sorted(folds)])).alias("fold_id")
    return df.select("participant_id", "cohort_id", fold).select(
        "participant_id", "fold_id", F.when(F.col("cohort_id") == F.col("fold_id"), "held_out").otherwise("train").alias("role")
    )


def attach_lineage(lineage: DataFrame, pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Every lineage record with its pair's columns; records without a pair keep nulls.

    Null keys match nothing and would all hash to one task; they are kept apart from the shuffle.
    """
    known, unknown = lineage.filter(F.col(key).isNotNull()), lineage.filter(F.col(key).isNull())
    joined = known.join(pairs, key, "left")
    missing = [F.lit(None).cast(t).alias(c) for c, t in pairs.dtypes if c != key]
    return joined.unionByName(unknown.select(*lineage.columns, *missing))


def source_rows(df: DataFrame, order: list[str], name: str = "source_row") -> DataFrame:
    """Stable 0-based row numbers in the curated order without gathering the table in one task.

    Range partitions are sorted and counted; a row's number is its place in its partition plus the rows of the earlier partitions.
    The counts (one row a partition) are the only thing joined.
    """
    from pairscope.session import cut_lineage

    ordered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    counts = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))  # one row a partition
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ordered.withColumn("_i", local).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") - 1 + F.col("_o")).drop("_p", "_i", "_o")


def one_per_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """The row of smallest ``order`` of each group; null groups have none."""
    return keep_first(df.filter(F.col(group).isNotNull()), [group], [order])


def qc_summary(df: DataFrame, words: str, flag: str, keys: list[str]) -> DataFrame:
    """Global counts, share flags and exact median in a single aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_distinct(k).alias(f"n_{k}") for k in keys],
        F.count_if(F.col(flag)).alias(f"n_{flag}"),
        F.count_if(F.col(words) <= 2).alias("n_up_to_2_words"),
        F.count_if(F.col(words) <= 5).alias("n_up_to_5_words"),
        F.median(words).cast("double").alias("median_words"),
        F.max(words).cast("long").alias("max_words"),
    )


def shard_bounds(df: DataFrame, row: str, size: int) -> DataFrame:
    """Bounds and row count of each shard of ``size`` rows."""
    shard = F.floor(F.col(row) / size).cast("long").alias("shard_index")
    return df.groupBy(shard).agg(F.min(row).alias("row_start"), (F.max(row) + 1).alias("row_stop"), F.count(F.lit(1)).alias("input_rows"))


def sum_flags(df: DataFrame, flags: list[str]) -> list[Column]:
    """Counts of true flags, null as false."""
    return [F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f"n_{f}") for f in flags]
