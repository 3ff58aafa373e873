import os

import duckdb
import pytest

import __spark_entry__ as entry
from pairscope import queries as core


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(core.ORACLES) <= set(core.QUERIES) and len(core.ORACLES) > 50


@pytest.mark.parametrize("name", ["p3_found", "p3_group_sizes", "complete_triads", "retrieval_ranks", "strata_means", "language_coverage", "loco_metrics"])
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    got = core.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    rel = con.execute(core.ORACLES[name])
    names = [c[0] for c in rel.description]
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    key = lambda r: tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(key, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(key, want))


def test_tables_keep_their_schemas(spark, data):
    from pairscope.contracts import SCHEMAS, ContractError, assert_schema

    for name in SCHEMAS:
        assert_schema(spark.read.parquet(f"{data}/{name}.parquet"), name)
    with pytest.raises(ContractError):
        assert_schema(spark.range(1), "prompts")
