"""Checks that tables keep their contracts. Each costs at most one aggregate job; ``audit`` puts several into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_COLUMNS = frozenset({"source_pt", "translation_en", "source_text", "translated_text", "prompt_pt", "text"})


class ContractError(ValueError):
    """A table breaks its contract."""


def assert_columns(df: DataFrame, required: list[str], exact: bool = False, ordered: bool = False) -> DataFrame:
    """Required (or exactly these, or exactly in this order) columns; metadata only."""
    have = df.columns
    bad = have != required if ordered else set(have) != set(required) or len(have) != len(required) if exact else not set(required) <= set(have)
    if bad:
        raise ContractError(f"columns {have} do not fit {required}")
    return df


def assert_no_text(df: DataFrame, forbidden: frozenset[str] = TEXT_COLUMNS) -> DataFrame:
    if held := forbidden & set(df.columns):
        raise ContractError(f"text columns are not allowed here: {sorted(held)}")
    return df


def null_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: nulls of each column, and ``total``; one aggregate."""
    columns = columns or df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return counts.withColumn("total", total)


def audit(df: DataFrame, keys: list[str] | None = None, rows: int | None = None, not_null: list[str] | None = None, finite: list[str] | None = None, non_negative: list[str] | None = None, non_empty: list[str] | None = None) -> DataFrame:
    """Key uniqueness, row count, nulls, finiteness, signs and empty texts in a single aggregate; raises on the first breach. Nulls are neither negative nor empty."""
    exprs = [F.count(F.lit(1)).alias("_n")]
    if keys:
        exprs.append(F.count_distinct(F.struct(*keys)).alias("_k"))
    exprs += [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in not_null or ()]
    exprs += [F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(f"_inf_{c}") for c in finite or ()]
    exprs += [F.count_if(F.col(c) < 0).alias(f"_neg_{c}") for c in non_negative or ()]
    exprs += [F.count_if(F.trim(F.col(c)) == "").alias(f"_blank_{c}") for c in non_empty or ()]
    got = df.agg(*exprs).first()
    for c in non_negative or ():
        if got[f"_neg_{c}"]:
            raise ContractError(f"{got[f'_neg_{c}']} values of {c} are negative")
    for c in non_empty or ():
        if got[f"_blank_{c}"]:
            raise ContractError(f"{got[f'_blank_{c}']} texts of {c} are empty")
    if rows is not None and got["_n"] != rows:
        raise ContractError(f"{got['_n']} rows, expected {rows}")
    if keys and got["_k"] != got["_n"]:
        raise ContractError(f"{got['_n'] - got['_k']} repeated keys {keys}")
    for c in not_null or ():
        if got[f"_null_{c}"]:
            raise ContractError(f"{got[f'_null_{c}']} nulls in {c}")
    for c in finite or ():
        if got[f"_inf_{c}"]:
            raise ContractError(f"{got[f'_inf_{c}']} values of {c} are not finite")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables in which every key is unique and present on both sides."""
    n_left, n_right = (d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*keys)).alias("k")).first() for d in (left, right))
    if n_left.n != n_left.k or n_right.n != n_right.k:
        raise ContractError(f"{keys} repeat")
    out = left.join(right, keys)
    if out.count() != n_left.n or n_left.n != n_right.n:
        raise ContractError(f"{keys} do not match one to one")
    return out


def frames_differ(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of either table that the other lacks, counting repeats: ``side`` and the shared columns."""
    shared = columns or [c for c in a.columns if c in b.columns]
    x, y = a.select(*shared), b.select(*shared)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


#: Column types of the domain tables, as DDL.
SCHEMAS = {
    "paired_responses": "pair_id string, participant_id string, cohort_id string, year int, question_index int, prompt_id string, prompt_family string, source_pt string, translation_en string, "
    "pt_word_count int, en_word_count int, exact_normalized_copy boolean, pt_duplicate_group_id string, pt_duplicate_group_size bigint, en_duplicate_group_id string, en_duplicate_group_size bigint, "
    "ingestion_record_count bigint, translation_variant_count bigint",
    "participants": "participant_id string, cohort_id string, year int",
    "prompts": "prompt_id string, cohort_id string, year int, question_index int, prompt_family string, prompt_pt string",
    "language_verification": "pair_id string, pt_predicted string, pt_expected_confidence double, pt_matches_expected boolean, pt_ambiguous boolean, en_predicted string, en_expected_confidence double, "
    "en_matches_expected boolean, en_ambiguous boolean",
    "pair_vectors": "pair_id string, source_row bigint, direction string, query_embedding array<float>, document_embedding array<float>",
}


def assert_schema(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of a domain table, in any order; metadata only."""
    want = {}
    depth, start, text = 0, 0, SCHEMAS[table] + ","
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = text[start:i].split()
            want[name], start = kind, i + 1
    have = dict(df.dtypes)
    if bad := {k: (v, have.get(k)) for k, v in want.items() if have.get(k) != v}:
        raise ContractError(f"{table}: {bad}")
    return df
