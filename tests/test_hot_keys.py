from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pairscope.operators.hot_keys import dense_key_aggregate, hot_groups

SCHEMA = "k string, e string, m double, side string, group_id string"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.side, r.group_id): (r.n_rows, r.sum_m, r.n_m) for r in dense_key_aggregate(df, {"pt": "k", "en": "e"}, ["m"], **kw).collect()}


def test_counts_sums_nulls_and_clashing_columns(spark):
    rows = [("a", "x", 1.0, "z", "z"), ("a", None, None, "z", "z"), (None, "x", 2.0, "z", "z"), ("a", "x", float("nan"), None, None), ("", "x", 4.0, None, None)]
    got = run(spark, rows)
    assert got[("pt", "a")] == (3, 1.0, 1) and got[("pt", None)] == (1, 2.0, 1) and got[("pt", "")] == (1, 4.0, 1)
    assert got[("en", "x")] == (4, 7.0, 3) and got[("en", None)] == (1, None, 0)


def test_one_key_of_a_third_of_all_rows_and_many_small_ones(spark):
    keys = ["hot"] * 5000 + [f"k{i % 7000}" for i in range(10_000)]
    got = run(spark, [(k, None, 1.0, None, None) for k in keys])
    want = Counter(keys)
    assert {k: v[0] for (s, k), v in got.items() if s == "pt"} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dense_key_aggregate(df, {"pt": "k"}, ["m"]).count() == 0 and hot_groups(df, {"pt": "k"}).count() == 0


def test_threshold_counts_null_rows_in_the_total_and_takes_ties(spark):
    df = spark.createDataFrame([("a",)] * 2 + [(None,)] * 6 + [("b",)] * 2, "k string")
    assert {r.group_id for r in hot_groups(df, {"pt": "k"}, 0.2).collect()} == {"a", "b"}
    assert hot_groups(df, {"pt": "k"}, 0.21).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ç", "", None]), max_size=60))
def test_equals_brute_force(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.group_id: r.n_rows for r in dense_key_aggregate(df, {"s": "k"}).collect()} == Counter(keys)
