import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairscope import contracts
from pairscope.operators import affect, curation, resampling, retrieval, ridge, sensitivity, strata


def test_curation_keeps_the_smallest_and_whole_groups(spark):
    df = spark.createDataFrame([("p1", 1, "b"), ("p1", 1, "a"), ("p1", 2, "c"), ("p1", 3, "d"), ("p2", 1, "e"), ("p2", 2, None)], "p string, q int, r string")
    assert {(r.p, r.q, r.r) for r in curation.keep_first(df, ["p", "q"], ["r"]).collect()} >= {("p1", 1, "a"), ("p2", 1, "e")}
    assert {r.p for r in curation.complete_groups(df, ["p"], "q").collect()} == {"p1"}
    assert curation.keep_first(df.limit(0), ["p"], ["r"]).count() == 0


def test_lineage_keeps_records_without_a_pair(spark):
    lin = spark.createDataFrame([("r1", "a"), ("r2", None), ("r3", "zz")], "rec string, pair_id string")
    pairs = spark.createDataFrame([("a", 7)], "pair_id string, n int")
    assert {(r.rec, r.n) for r in curation.attach_lineage(lin, pairs).collect()} == {("r1", 7), ("r2", None), ("r3", None)}


def test_source_rows_are_the_sorted_places(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, str(i)) for i in range(1000)], "a int, b string").repartition(5)
    got = curation.source_rows(df, ["a", "b"]).collect()
    want = {k: i for i, k in enumerate(sorted((r.a, r.b) for r in got))}
    assert all(r.source_row == want[(r.a, r.b)] for r in got)


def _retrieval(spark, rows, groups, **kw):
    rows = [(a, b, c, q and [float(x) for x in q], d and [float(x) for x in d]) for a, b, c, q, d in rows]
    v = spark.createDataFrame(rows, "source_row long, pair_id string, direction string, query_embedding array<float>, document_embedding array<float>")
    g = spark.createDataFrame(groups, "pair_id string, pt_duplicate_group_id string, en_duplicate_group_id string")
    return {(r.pair_id, r.direction): r for r in retrieval.retrieval_ranks(v, g, **kw).collect()}


F1 = [
    (0, "p0", "en_to_pt", [1.0, 0, 0], [0.8, 0.2, 0]), (1, "p1", "en_to_pt", [1.0, 0, 0], [1.0, 0, 0]), (2, "p2", "en_to_pt", [0, 1.0, 0], [0, 1.0, 0]),
    (0, "p0", "pt_to_en", [1.0, 0, 0], [0.8, 0.2, 0]), (1, "p1", "pt_to_en", [0, 1.0, 0], [0, 1.0, 0]), (2, "p2", "pt_to_en", [1.0, 0, 0], [1.0, 0, 0]),
]
G1 = [("p0", "pt-a", "en-x"), ("p1", "pt-a", "en-y"), ("p2", "pt-b", "en-x")]


def test_multi_positive_groups_are_of_the_document_language(spark):
    got = _retrieval(spark, F1, G1)
    assert got[("p0", "en_to_pt")].retrieval_rank == got[("p0", "pt_to_en")].retrieval_rank == 1
    assert got[("p0", "en_to_pt")].hit_at_1 and got[("p0", "en_to_pt")].n_candidates == 3


@pytest.mark.parametrize("dedup", [False, True])
def test_ranks_equal_brute_force_with_ties_and_blocks(spark, dedup):
    rng = np.random.default_rng(4)
    base = rng.integers(-2, 3, (12, 4)).astype(float) + 0.5
    n = 90
    q, d = base[rng.integers(0, 12, n)], base[rng.integers(0, 12, n)]
    grp = [f"g{int(x):02d}" for x in rng.integers(0, 25, n)]
    rows = [(i, f"p{i:03d}", "en_to_pt", q[i].tolist(), d[i].tolist()) for i in range(n)] + [(n, "zero", "en_to_pt", [0.0] * 4, [0.0] * 4), (n + 1, "null", "en_to_pt", None, None)]
    got = _retrieval(spark, rows + rows[:5], [(f"p{i:03d}", grp[i], "e") for i in range(n)], block=20, dedup=dedup)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(d).T, 9)
    for i in range(n):
        if dedup:
            names = sorted(set(grp))
            best = [max(s[i][j] for j in range(n) if grp[j] == g) for g in names]
            order = sorted(range(len(names)), key=lambda k: (-best[k], names[k]))
            want = 1 + order.index(names.index(grp[i]))
        else:
            order = sorted(range(n), key=lambda j: (-s[i][j], j))
            want = 1 + min(order.index(j) for j in range(n) if grp[j] == grp[i])
        assert got[(f"p{i:03d}", "en_to_pt")].retrieval_rank == want
    assert ("zero", "en_to_pt") not in got


def test_retrieval_of_an_empty_table(spark):
    assert _retrieval(spark, [], G1) == {}


def test_bootstrap_is_deterministic_and_handles_zero_clusters(spark):
    sums, counts = np.array([[4.0], [6.0]]), np.array([[2.0], [2.0]])
    a = resampling.bootstrap_ratio(sums, counts, 200, 42, batch=17)
    assert a[0, 0] == 2.5 and np.array_equal(a, resampling.bootstrap_ratio(sums, counts, 200, 42, batch=17))
    only = resampling.bootstrap_ratio(np.array([[4.0], [0.0]]), np.array([[2.0], [0.0]]), 50, 1)
    assert only.tolist() == [[2.0, 2.0, 2.0]]
    with pytest.raises(ValueError):
        resampling.bootstrap_ratio(np.zeros((2, 1)), np.zeros((2, 1)), 10, 1)


def test_engines_agree_on_estimate_and_roughly_on_bounds(spark):
    rng = np.random.default_rng(0)
    rows = [("s", f"c{i % 60}", float(x)) for i, x in enumerate(rng.normal(5, 2, 600))] + [("s", "c1", None)]
    df = spark.createDataFrame(rows, "t string, c string, m double")
    a = resampling.intervals_numpy(df, ["t"], "c", ["m"], 500, 7).first()
    b = resampling.intervals_poisson(df, ["t"], "c", ["m"], 500, 7).first()
    h = resampling.intervals_hash(df, ["t"], "c", ["m"], 200).first()
    assert abs(a.estimate - b.estimate) < 1e-9 and abs(a.estimate - h.estimate) < 1e-9
    assert abs(a.ci_lower - b.ci_lower) < 0.08 and abs(a.ci_upper - b.ci_upper) < 0.08 and abs(a.ci_lower - h.ci_lower) < 0.1


def test_strata_and_one_per_response(spark):
    rows = [("a", "u1", "c1", "f", 1, False, "g1"), ("b", "u1", "c1", "f", 4, True, "g1"), ("c", "u2", None, None, 30, None, None)]
    df = spark.createDataFrame(rows, "pair_id string, participant_id string, cohort_id string, prompt_family string, pt_word_count int, exact_normalized_copy boolean, pt_duplicate_group_id string")
    got = {(r.stratum_type, r.stratum_value): (r.n_pairs, r.estimate) for r in strata.stratum_means(df, ["pt_word_count"]).collect()}
    assert got[("overall", "all")] == (3, 35 / 3) and got[("subset", "one_per_pt_response")] == (1, 1.0) and got[("subset", "not_exact_copy")] == (2, 15.5)
    assert ("cohort", None) not in got and got[("length_band", "21+")] == (1, 30.0)


def test_js_distance_rules(spark):
    rows = [([0.75, 0.25], [0.5, 0.5]), ([0.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])]
    got = [r.d for r in spark.createDataFrame(rows, "p array<double>, q array<double>").select(affect.js_distance(F.col("p"), F.col("q")).alias("d")).collect()]
    assert got[0] == pytest.approx(0.2208957688490173) and got[1] == 0 and got[2] == pytest.approx(0.7071067811865476) and got[3] is None and got[4] == pytest.approx(1.0)


def test_network_and_lexicon(spark):
    df = spark.createDataFrame([(1, "Hope support. hope uncertainty"), (2, ""), (3, None), (4, "one")], "i int, t string")
    net = {r.id: (r.n_nodes, r.n_edges, r.density) for r in affect.networks(df, "i", "t").collect()}
    assert net[1] == (3, 4, pytest.approx(4 / 3)) and net[2] == (0, 0, 0.0) and net[3] == (0, 0, 0.0) and net[4] == (1, 0, 0.0)
    lex = spark.createDataFrame([("hope", "joy"), ("support", "joy"), ("uncertainty", "fear"), ("hope", "positive"), ("support", "positive"), ("uncertainty", "negative")], "token string, emotion string")
    r = {x.id: x for x in affect.lexicon_profile(df, "i", "t", lex).collect()}
    joy = affect.EMOTIONS.index("joy")
    assert r[1].joy_count == 2 and r[1].emotion_shares[joy] == pytest.approx(2 / 3) and r[1].valence_shares[3] == pytest.approx(2 / 3) and r[1].emotion_coverage == 1
    assert r[3].n_nodes == 0 and sum(r[3].emotion_shares) == 0


def _closed_form(x, y, alpha):
    m, sd = x.mean(0), x.std(0)
    z = (x - m) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - w @ m, w


def test_ridge_equals_closed_form_and_tunes_on_training_cohorts_only(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)) * [1, 5, 0.2], columns=list("abc"))
    pdf["y"] = pdf.a - 2 * pdf.b + rng.normal(size=200)
    pdf["cohort"] = [f"c{i % 4}" for i in range(200)]
    preds, metrics = ridge.leave_one_cohort_out(spark.createDataFrame(pdf), "cohort", list("abc"), "y")
    got = preds.toPandas()
    assert len(got) == 200
    for held, part in got.groupby("cohort"):
        rest = pdf[pdf.cohort != held]
        alpha = part.alpha.iloc[0]
        b, w = _closed_form(rest[list("abc")].to_numpy(), rest.y.to_numpy(), alpha)
        assert np.allclose(part.predicted, b + part[list("abc")].to_numpy() @ w)
    m = {r.cohort: r for r in metrics.collect()}
    assert all(r.r2 > 0.9 and r.pearson_r > 0.9 for r in m.values())
    constant = spark.createDataFrame([("x", 1.0, 3.0), ("x", 2.0, 3.0), ("y", 1.0, 3.0), ("y", 5.0, 3.0), ("y", None, 1.0)], "cohort string, a double, y double")
    rows = ridge.leave_one_cohort_out(constant, "cohort", ["a"], "y")[1].collect()
    assert all(r.r2 is None and r.pearson_r is None for r in rows)
    assert ridge.leave_one_cohort_out(constant.limit(0), "cohort", ["a"], "y")[0].count() == 0


def test_language_flags_rates_and_encoder_delta(spark):
    rows = [("p", True, True, False, False, 1), ("q", False, True, True, False, 3), ("r", False, None, False, None, None)]
    df = spark.createDataFrame(rows, "participant_id string, pt_matches_expected boolean, en_matches_expected boolean, pt_ambiguous boolean, en_ambiguous boolean, pt_word_count int")
    flags = sensitivity.language_flags(df)
    got = {(r.stratum_type, r.stratum_value, r.flag): r.rate for r in sensitivity.flag_rates(flags, [f"flag_{f}" for f in sensitivity.LANGUAGE_FLAGS]).collect()}
    assert got[("overall", "all", "flag_both_match")] == pytest.approx(1 / 3) and got[("overall", "all", "flag_pt_explicit_mismatch")] == pytest.approx(1 / 3)
    a = spark.createDataFrame([("p", "d", True), ("q", "d", False)], "pair_id string, direction string, hit boolean")
    b = spark.createDataFrame([("p", "d", True), ("q", "d", True)], "pair_id string, direction string, hit boolean")
    assert sensitivity.encoder_differences(a, b, ["hit"]).agg(F.avg("delta_hit")).first()[0] == 0.5
    bounds = sensitivity.flag_intervals(flags, ["flag_both_match"], 100, 1).collect()
    assert all(r.ci_lower <= r.estimate <= r.ci_upper for r in bounds)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    contracts.audit(df, keys=["k"], rows=2, not_null=["k"])
    for bad in ({"rows": 3}, {"not_null": ["v"]}):
        with pytest.raises(contracts.ContractError):
            contracts.audit(df, **bad)
    with pytest.raises(contracts.ContractError):
        contracts.audit(df.unionAll(df), keys=["k"])
    with pytest.raises(contracts.ContractError):
        contracts.assert_no_text(df.withColumn("text", F.lit("x")))
    with pytest.raises(contracts.ContractError):
        contracts.one_to_one(df, df.limit(1), ["k"])
    assert contracts.frames_differ(df, df.unionAll(df.limit(1))).count() == 1
    assert contracts.null_audit(df).first().total == 1
    json.dumps(contracts.audit(df).columns)


def test_intervals_cover_every_stratum_with_the_stated_repetitions(spark, data, monkeypatch):
    import inspect

    from pairscope import queries_reference as q

    assert q.REPETITIONS == 2_000
    assert all("REPETITIONS" in inspect.getsource(q.QUERIES[n]) for n in ("bootstrap_ci_numpy", "bootstrap_ci_poisson", "language_coverage_intervals"))
    monkeypatch.setattr(q, "REPETITIONS", 20)
    want = {(r.stratum_type, r.stratum_value) for r in q.QUERIES["strata_means"](spark, data).select("stratum_type", "stratum_value").distinct().collect()}
    assert ("subset", "one_per_pt_response") in want
    for name in ("bootstrap_ci_numpy", "bootstrap_ci_poisson"):
        assert {(r.stratum_type, r.stratum_value) for r in q.QUERIES[name](spark, data).collect()} == want


def test_clusters_outside_the_universe_are_an_error(spark):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 3.0), ("s", None, 9.0)], "t string, c string, m double")
    universe = spark.createDataFrame([("a",), ("b",), ("z",)], "c string")
    got = resampling.intervals_numpy(df, ["t"], "c", ["m"], 200, 7, universe=universe).first()
    assert got.n_clusters == 3 and got.estimate == 2.0 and 1.0 <= got.ci_lower <= got.ci_upper <= 3.0
    with pytest.raises(Exception, match="not in the universe"):
        resampling.intervals_numpy(df, ["t"], "c", ["m"], 200, 7, universe=universe.filter("c <> 'b'")).collect()


def test_an_empty_cluster_changes_no_conditional_mean(spark):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 3.0)], "t string, c string, m double")
    got = resampling.intervals_numpy(df, ["t"], "c", ["m"], 100, 42, universe=spark.createDataFrame([("a",), ("b",)], "c string")).first()
    assert (got.estimate, got.ci_lower, got.ci_upper) == (2.0, 2.0, 2.0)


def test_blocks_of_draws_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    s, c = rng.normal(size=(37, 2)), rng.integers(0, 3, (37, 2)).astype(float)
    whole = resampling.bootstrap_ratio(s, c, 300, 5)
    monkeypatch.setattr(resampling, "DRAWS_AT_ONCE", 40)
    assert np.array_equal(whole, resampling.bootstrap_ratio(s, c, 300, 5))


def test_group_sizes_of_hot_null_and_small_groups(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"g{i // 2}", i) for i in range(100)] + [(None, i) for i in range(7)]
    got = curation.with_group_size(spark.createDataFrame(rows, "g string, i int"), ["g"], "n", 0.1).collect()
    assert len(got) == len(rows) and {(r.g, r.n) for r in got if r.g in ("hot", "g3", None)} == {("hot", 3000), ("g3", 2), (None, None)}
    assert curation.with_group_size(spark.createDataFrame(rows[:0], "g string, i int"), ["g"], "n").count() == 0


def test_counts_are_attached_to_every_row(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), (None, "x", 4), (None, None, 5)]
    got = {r.i: (r.ingestion_record_count, r.translation_variant_count) for r in curation.attach_counts(spark.createDataFrame(rows, "k string, t string, i int"), ["k"], ["k", "t"], "t").collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (1, 2), 4: (1, 1), 5: (1, 1)}


def test_folds_hold_out_one_cohort(spark):
    df = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u3", "b")], "participant_id string, cohort_id string")
    good = curation.splits_leave_one_out(df, ["a", "b"])
    assert ridge.assert_folds(df, good, "cohort_id") is good
    for bad in (good.filter("not (participant_id = 'u1' and fold_id = 'a')"), good.withColumn("role", F.lit("train")), good.withColumn("role", F.when(F.col("participant_id") == "u3", "train").otherwise("held_out")).unionByName(good), good.limit(0)):
        with pytest.raises(ValueError):
            ridge.assert_folds(df, bad, "cohort_id")
    p = spark.createDataFrame([("x",), ("y",)], "pair_id string")
    assert ridge.assert_predicted_once(p, p) is p
    for bad in (p.unionByName(p), p.limit(1)):
        with pytest.raises(ValueError):
            ridge.assert_predicted_once(bad, p)


def test_vectors_must_cover_every_pair_in_its_place(spark):
    pairs = spark.createDataFrame([("a", 0), ("b", 1)], "pair_id string, source_row long")
    rows = [(p, r, d, [1.0, 0.0], [1.0, 0.0]) for p, r in (("a", 0), ("b", 1)) for d in ("en_to_pt", "pt_to_en")]
    make = lambda x: spark.createDataFrame(x, "pair_id string, source_row long, direction string, query_embedding array<float>, document_embedding array<float>")
    retrieval.assert_aligned(make(rows), pairs)
    for bad in (rows[:3], [*rows, rows[0]], [("a", 1, *rows[0][2:]), *rows[1:]], [(*rows[0][:3], [1.0], [1.0]), *rows[1:]]):
        with pytest.raises(ValueError):
            retrieval.assert_aligned(make(bad), pairs)


def test_affect_features_of_pairs(spark):
    lex = spark.createDataFrame([("bom", "joy"), ("bom", "positive"), ("good", "joy"), ("good", "positive"), ("ruim", "sadness"), ("ruim", "negative")], "token string, emotion string")
    rows = [("p", "bom bom ruim", "good day"), ("q", None, ""), ("r", "nada aqui", "good")]
    df = spark.createDataFrame(rows, "pair_id string, source_pt string, translation_en string")
    got = {r.pair_id: r for r in affect.pair_features(df, lex).collect()}
    assert got["p"].emotion_mean_abs_delta == pytest.approx(1 / 8) and got["p"].emotion_both_nonzero and got["p"].pt_density == 2.0  # bom and ruim are neighbours twice, two nodes
    assert got["q"].emotion_js_distance == 0 and got["q"].emotion_both_zero and got["q"].density_abs_delta == 0 and got["q"].pt_n_nodes == 0
    assert got["r"].emotion_js_distance == pytest.approx(0.5**0.5) and got["r"].emotion_one_nonzero and got["r"].valence_both_nonzero
    joined = {r.id: r for r in affect.lexicon_profile(df, "pair_id", "source_pt", lex, max_lexicon=0).collect()}
    for r in affect.lexicon_profile(df, "pair_id", "source_pt", lex).collect():
        assert r == joined[r.id]


@pytest.mark.parametrize("dedup", [False, True])
@pytest.mark.parametrize("block", [16_384, 40])
def test_ranks_equal_brute_force_with_a_hot_group(spark, dedup, block):
    rng = np.random.default_rng(11)
    n = 300
    q, d = rng.normal(size=(n, 8)).astype("f4"), rng.normal(size=(n, 8)).astype("f4")
    d[5:9] = d[4]  # ties
    grp = np.array(["hot" if i % 3 == 0 else f"g{i // 4}" for i in range(n)])
    rows = [(i, f"p{i:03d}", "en_to_pt", q[i].tolist(), d[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "source_row long, pair_id string, direction string, query_embedding array<float>, document_embedding array<float>")
    groups = spark.createDataFrame([(f"p{i:03d}", g, g) for i, g in enumerate(grp.tolist())], "pair_id string, pt_duplicate_group_id string, en_duplicate_group_id string")
    unit = lambda x: x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(d).T, 9)
    want = []
    for i in range(n):
        if dedup:
            best = {g: s[i][grp == g].max() for g in set(grp.tolist())}
            order = sorted(best, key=lambda g: (-best[g], g))
            want.append(order.index(grp[i]) + 1)
        else:
            order = sorted(range(n), key=lambda j: (-s[i][j], j))
            want.append(min(k for k, j in enumerate(order) if grp[j] == grp[i]) + 1)
    got = {r.pair_id: r.retrieval_rank for r in retrieval.retrieval_ranks(df, groups, block=block, dedup=dedup).collect()}
    assert [got[f"p{i:03d}"] for i in range(n)] == want


def test_hash_draws_are_those_of_md5():
    for prefix in (b"family|7|", b"x" * 70 + b"|0|"):
        want = [int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:8], 16) for i in range(95, 1203)]
        assert resampling.md5_heads(prefix, 95, 1203).tolist() == want


def test_hash_engine_equals_brute_force_over_packs(spark):
    rows = [(f"s{i % 2}", f"c{i % 23:02d}", float(i % 7)) for i in range(90) if i % 2 or i % 23 < 9]
    df, u, got = spark.createDataFrame(rows, "t string, c string, m double"), sorted({c for _, c, _ in rows}), {}
    for t in ("s0", "s1"):
        v = []
        for rep in range(40):
            hit = [u[int(hashlib.md5(f"{t}|{rep}|{k}".encode()).hexdigest()[:8], 16) % len(u)] for k in range(len(u))]
            x = [m for c in hit for t2, c2, m in rows if t2 == t and c2 == c]
            v += [sum(x) / len(x)] * bool(x)
        got[t] = np.quantile(v, [0.025, 0.975])
    for r in resampling.intervals_hash(df, ["t"], "c", ["m"], 40, block=5).collect():
        assert np.allclose([r.ci_lower, r.ci_upper], got[r.t]) and r.n_clusters == len(u)


def test_hash_engine_over_more_draws_than_rows_could_hold(spark):
    df = spark.range(30_000).selectExpr("'a' AS t", "id AS c", "cast(id % 10 AS double) AS m")
    r = resampling.intervals_hash(df, ["t"], "c", ["m"], 1_700).first()  # 51 million draws
    half = 1.96 * np.sqrt(8.25 / 30_000)
    assert r.estimate == 4.5 and abs(r.ci_lower - 4.5 + half) < 0.1 * half and abs(r.ci_upper - 4.5 - half) < 0.1 * half


@pytest.mark.parametrize("block", [16_384, 60])
def test_both_ranks_come_of_one_pass_whose_shuffle_does_not_grow_with_the_blocks(spark, block):
    rng = np.random.default_rng(3)
    n = 400
    v, grp = rng.normal(size=(n, 2, 8)).astype("f4"), [f"g{i % 3 if i < 90 else i // 3}" for i in range(n)]
    v[7, 1] = v[300, 1] = v[120, 1]  # ties across groups
    df = spark.createDataFrame([(i, f"p{i:03d}", "en_to_pt", v[i, 0].tolist(), v[i, 1].tolist()) for i in range(n)], "source_row long, pair_id string, direction string, query_embedding array<float>, document_embedding array<float>")
    groups = spark.createDataFrame([(f"p{i:03d}", g, g) for i, g in enumerate(grp)], "pair_id string, pt_duplicate_group_id string, en_duplicate_group_id string")
    both = retrieval.both_ranks(df, groups, block)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and all("q#" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    u = v / np.linalg.norm(v.astype(float), axis=2, keepdims=True)
    s = np.round(u[:, 0] @ u[:, 1].T, 9)
    for r in both.collect():
        i = int(r.pair_id[1:])
        top = {g: max(s[i][j] for j in range(n) if grp[j] == g) for g in set(grp)}
        order = sorted(range(n), key=lambda j: (-s[i][j], j))
        assert r.docs == 1 + min(order.index(j) for j in range(n) if grp[j] == grp[i])
        assert r.groups == 1 + sorted(top, key=lambda g: (-top[g], g)).index(grp[i])
        assert (r.n_docs, r.n_groups) == (n, len(top))


def test_sensitivity_intervals_rank_once_for_each_encoder(spark, data, monkeypatch):
    from pairscope import queries_reference as q

    calls, real = [], retrieval.both_ranks
    monkeypatch.setattr(retrieval, "both_ranks", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setattr(q, "REPETITIONS", 20)
    got = {(r.summary, r.cell.split("|")[0], r.metric): r for r in q.sensitivity_intervals(spark, data).collect()}
    assert len(calls) == 2
    for name, summary in (("target_dedup", q.retrieval_sensitivity), ("encoder_difference", q.encoder_summary)):
        for r in summary(spark, data).collect():
            mine = got[(name, r.direction, r.metric)]
            assert round(mine.estimate, 6) == r.estimate and mine.n_pairs == r.n_pairs and mine.ci_lower <= mine.ci_upper
    assert {k[0] for k in got} == {"both_languages_match", "length_recall", "target_dedup", "encoder_difference", "affect_nonzero", "affect_coverage"}
