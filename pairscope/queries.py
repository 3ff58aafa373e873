"""Registry of the core queries: name -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope import queries_reference as reference
from pairscope.operators.hot_keys import dense_key_aggregate, hot_groups
from pairscope.session import table

Query = Callable[[SparkSession, str], DataFrame]
SIDES = {"pt": "pt_duplicate_group_id", "en": "en_duplicate_group_id"}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at least one per cent of all rows of paired_responses."""
    return hot_groups(table(spark, d, "paired_responses"), SIDES, 0.01).select("side", "group_id")


def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and word totals of every duplicate group of both sides, whatever its size."""
    df = table(spark, d, "paired_responses")
    agg = dense_key_aggregate(df, SIDES, ["pt_word_count", "en_word_count"]).filter(F.col("group_id").isNotNull())
    return agg.select(
        "side",
        "group_id",
        "n_rows",
        F.col("sum_pt_word_count").cast("long").alias("pt_words"),
        F.col("sum_en_word_count").cast("long").alias("en_words"),
    )


QUERIES: dict[str, Query] = {"p3_found": p3_found, "p3_group_sizes": p3_group_sizes}

ORACLES: dict[str, str] = {
    "p3_found": """
        WITH n AS (SELECT count(*) AS n FROM paired_responses),
        g AS (SELECT 'pt' AS side, pt_duplicate_group_id AS group_id, count(*) AS c FROM paired_responses GROUP BY 2
              UNION ALL
              SELECT 'en', en_duplicate_group_id, count(*) FROM paired_responses GROUP BY 2)
        SELECT side, group_id FROM g, n WHERE group_id IS NOT NULL AND c >= 0.01 * n.n
    """,
    "p3_group_sizes": """
        SELECT 'pt' AS side, pt_duplicate_group_id AS group_id, count(*) AS n_rows,
               sum(pt_word_count)::BIGINT AS pt_words, sum(en_word_count)::BIGINT AS en_words
        FROM paired_responses WHERE pt_duplicate_group_id IS NOT NULL GROUP BY 2
        UNION ALL
        SELECT 'en', en_duplicate_group_id, count(*), sum(pt_word_count)::BIGINT, sum(en_word_count)::BIGINT
        FROM paired_responses WHERE en_duplicate_group_id IS NOT NULL GROUP BY 2
    """,
}

QUERIES.update(reference.QUERIES)
ORACLES.update(reference.ORACLES)
