import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairscope.functions import ids, language, quality, text, vectors


def test_normalization_folds_width_and_space_and_keeps_case(spark):
    rows = [("\n Pausas\t\tcurtas  ", "Pausas curtas"), ("Ａ", "A"), ("a　\x1cb", "a b"), ("", ""), (None, None), ("x" * 100_000, "x" * 100_000)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(text.normalize_for_qc("t").alias("n"), text.token_count(text.normalize_for_qc("t")).alias("c")).collect()
    assert [r.n for r in got] == [b for _, b in rows]
    assert [r.c for r in got][:5] == [2, 1, 2, 1, None]


def test_stable_id_equals_its_driver_form_and_counts_null_parts(spark):
    row = spark.createDataFrame([("a", None, 3)], "x string, y string, z int").select(ids.stable_id("ns", F.col("x"), F.col("y"), F.col("z")).alias("h")).first()
    assert row.h == ids.stable_id_py("ns", "a", None, 3) != ids.stable_id_py("ns", "a", 3)


def test_bands_and_blank_texts(spark):
    got = spark.createDataFrame([(w,) for w in (0, 2, 3, 5, 6, 20, 21, None)], "w int").select(text.length_band(F.col("w")).alias("b")).collect()
    assert [r.b for r in got] == ["1-2", "1-2", "3-5", "3-5", "6-20", "6-20", "21+", None]
    blanks = spark.createDataFrame([(t,) for t in (" 　\t\x1d", "", None, " a ")], "t string").select(text.not_blank(F.col("t")).alias("b")).collect()
    assert [r.b for r in blanks] == [False, False, False, True]


def test_strict_mapping_raises_on_an_unmapped_key(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r.v for r in df.select(text.strict_map(F.col("k"), {"a": 1}).alias("v")).collect()] == [1, None]
    import pytest

    with pytest.raises(Exception, match="unmapped"):
        df.select(text.strict_map(F.col("k"), {"b": 1}).alias("v")).collect()


def test_quality_and_embedding_formulas(spark):
    df = spark.createDataFrame([("olá", "hello"), (None, "x")], "s string, t string")
    got = df.select(quality.synthetic_quality(F.col("s"), F.col("t")).alias("q"), vectors.synthetic_embedding(8)("s").alias("e")).collect()
    assert got[0].q == quality.synthetic_quality_py("olá", "hello") and got[1].q is None
    assert abs(np.linalg.norm(got[0].e) - 1) < 1e-6 and len(got[0].e) == 8 and got[1].e is None


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-10, 10, width=32), min_size=3, max_size=3))
def test_usable_and_unit(v):
    expected = any(x != 0 for x in v)
    norm = math.sqrt(sum(float(x) ** 2 for x in v))
    assert expected == (norm > 0) or norm == 0


def test_vector_guards(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), (None,), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), ([],)]
    got = spark.createDataFrame(rows, "v array<double>").select(vectors.usable(F.col("v")).alias("u")).collect()
    assert [r.u for r in got] == [True, False, False, False, False, False, False]


def test_language_flags_are_never_null(spark):
    df = spark.createDataFrame([("pt",), ("es",), (None,)], "p string")
    got = language.verification_flags(df, "p", "pt", "pt").collect()
    assert [(r.pt_matches_expected, r.pt_ambiguous) for r in got] == [(True, False), (False, False), (False, True)]


def test_detector_plug_in(spark):
    class Always:
        def detect(self, t, expected):
            return (None, 0.1) if t.isdigit() else (expected, 0.9)

    df = spark.createDataFrame([("abc",), ("123",), (None,)], "t string")
    got = df.select(language.detector_udf(Always)("t", F.lit("pt")).alias("d")).collect()
    assert [r.d.predicted for r in got] == ["pt", None, None]


def test_models_plug_in_as_functions_of_columns(spark):
    from pairscope.functions import language, quality

    class Longest:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def score(self, sources, translations):
            return [max(len(a or ""), len(b or "")) / 10 for a, b in zip(sources, translations)]

    class Short(Longest):
        def score(self, sources, translations):
            return [1.0]

    class Capitals:
        def detect(self, text, expected):
            return (expected, 1.0) if text[:1].isupper() else (None, 0.5)

    df = spark.createDataFrame([("a", "bcd"), ("Ef", None), (None, "x")], "s string, t string")
    assert [r.q for r in df.select(quality.quality_udf(Longest)("s", "t").alias("q")).collect()] == [0.3, 0.2, 0.1]
    with pytest.raises(Exception, match="finite score"):
        df.coalesce(1).select(quality.quality_udf(Short)("s", "t").alias("q")).collect()
    got = df.select(language.detector_udf(Capitals)("s", F.lit("pt")).alias("d")).select("d.*").collect()
    assert [(r.predicted, r.expected_confidence) for r in got] == [(None, 0.5), ("pt", 1.0), (None, 0.0)]


def test_audit_of_signs_and_empty_texts(spark):
    from pairscope.contracts import ContractError, audit

    df = spark.createDataFrame([(1, "a"), (None, None)], "n int, t string")
    audit(df, non_negative=["n"], non_empty=["t"])
    for bad in ((-1, "a"), (1, "  ")):
        with pytest.raises(ContractError):
            audit(spark.createDataFrame([bad], "n int, t string"), non_negative=["n"], non_empty=["t"])
