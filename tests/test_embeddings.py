import numpy as np
import pytest

from pairscope.functions import embeddings

REVISION = "0123456789abcdef0123456789abcdef01234567"


def test_prompts_have_their_form():
    assert embeddings.query_prompt("Find it", "a text") == "Instruct: Find it\nQuery: a text"


@pytest.mark.parametrize("bad", [np.zeros((2, 4)), np.ones((3, 4)), np.ones((2, 5)), np.full((2, 4), np.nan)])
def test_bad_matrices_are_refused(bad):
    with pytest.raises(ValueError):
        embeddings.checked(bad, 2, 4)


def test_rows_come_out_as_units():
    assert np.allclose(np.linalg.norm(embeddings.checked(np.array([[3.0, 4.0], [0.0, 2.0]]), 2, 2), axis=1), 1)


def test_frozen_encoders():
    good = {"repository": "org/model", "revision": REVISION, "frozen": True, "trust_remote_code": False, "normalize_embeddings": True}
    embeddings.validate_encoder(good, {"org/model": REVISION})
    for change in ({"revision": "main"}, {"repository": "org/other"}, {"frozen": False}, {"trust_remote_code": True}, {"normalize_embeddings": False}, {"revision": REVISION[::-1]}):
        with pytest.raises(ValueError):
            embeddings.validate_encoder({**good, **change}, {"org/model": REVISION})


def test_two_rows_a_pair_of_unit_vectors(spark):
    rows = [("a", 0, "olá", "hello"), ("b", 1, "olá", None), ("c", 2, "", "x" * 100_000)]
    df = spark.createDataFrame(rows, "pair_id string, source_row long, source_pt string, translation_en string")
    out = embeddings.embed_pairs(df, lambda: embeddings.SyntheticBackend(8), 8).collect()
    assert sorted((r.pair_id, r.direction) for r in out) == [("a", "en_to_pt"), ("a", "pt_to_en"), ("c", "en_to_pt"), ("c", "pt_to_en")]
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 and len(v) == 8 for r in out for v in (r.query_embedding, r.document_embedding))
    one, two = (next(r for r in out if r.pair_id == "a" and r.direction == d) for d in ("en_to_pt", "pt_to_en"))
    assert one.query_embedding != two.document_embedding  # queries carry their instruction
    assert embeddings.embed_pairs(df.limit(0), lambda: embeddings.SyntheticBackend(8), 8).count() == 0
    encode = embeddings.encode_udf(lambda: embeddings.SyntheticBackend(8), 8)
    got = [r.v for r in df.select(encode("translation_en").alias("v")).collect()]
    assert got[1] is None and len(got[0]) == 8
