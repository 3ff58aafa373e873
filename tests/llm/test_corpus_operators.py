import os

import numpy as np
import pytest

from pairscope.llm import leakage, mixing, neighbors, toxicity

LONG = "Nada de novo por aqui hoje. " * 8000


# --- neighbours --------------------------------------------------------------------------------------------------


def _vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    d = rng.normal(size=(n, 16))
    q = d[rng.integers(0, n, n)] + 0.08 * rng.normal(size=(n, 16))
    return q, d * rng.uniform(0.5, 3, (n, 1))


def _exact(q, d, ids, k, c):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit(q.astype("f4")) @ unit(d.astype("f4")).T
    return {(ids[i], ids[j]) for i in range(len(q)) for j in sorted(np.flatnonzero(s[i] >= c), key=lambda j: -s[i][j])[:k]}


@pytest.mark.parametrize("block", [8192, 64])
def test_recall_against_brute_force(spark, block):
    q, d = _vectors(1500)
    ids = [f"p{i:04d}" for i in range(len(q))]
    rows = [("x", i, a.tolist(), b.tolist()) for i, a, b in zip(ids, q, d)]
    rows += rows[:40] + [("x", "n1", None, [1.0] * 16), ("x", "n2", [0.0] * 16, [0.0] * 16), ("x", "n3", [float("nan")] * 16, [float("inf")] * 16), ("x", "n4", [1.0], [1.0]), (None, "n5", [1.0] * 16, [1.0] * 16)]
    df = spark.createDataFrame(rows, "direction string, pair_id string, query array<float>, document array<float>")
    out = neighbors.top_neighbors(df, "pair_id", "direction", "query", "document", 5, 0.9, rows_per_list=100, block_rows=block).collect()
    got = {(r.query_id, r.document_id) for r in out if not r.query_id.startswith("n") and not r.document_id.startswith("n")}
    want = _exact(q, d, ids, 5, 0.9)
    assert len(got & want) / len(want) >= 0.95 and len(got - want) <= 0.01 * len(want)
    assert len({(r.query_id, r.document_id) for r in out}) == len(out) and max(r.place for r in out) <= 5


@pytest.mark.parametrize("lists", [100, 100_000])
def test_exact_mode_misses_nothing_whatever_the_blocks(spark, lists, request):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the small partitions are put together, and what must meet does anyway
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.enabled", "true"))
    q, d = _vectors(1200, 3)
    ids = [f"p{i:04d}" for i in range(len(q))]
    df = spark.createDataFrame([("x", i, a.tolist(), b.tolist()) for i, a, b in zip(ids, q, d)], "direction string, pair_id string, query array<float>, document array<float>").repartition(3)
    # with 100,000 rows a list there is one group, which both sides must cut
    out = neighbors.top_neighbors(df, "pair_id", "direction", "query", "document", 5, 0.9, rows_per_list=lists, block_rows=64, spread=neighbors.EXACT).collect()
    assert {(r.query_id, r.document_id) for r in out} == _exact(q, d, ids, 5, 0.9)


def test_ties_and_empty(spark):
    rows = [("x", i, [1.0, 0.0], [1.0, 0.0]) for i in "dbca"]
    df = spark.createDataFrame(rows, "part string, id string, q array<float>, d array<float>")
    got = neighbors.top_neighbors(df, "id", "part", "q", "d", 2, 0.9).collect()
    assert {(r.query_id, r.document_id) for r in got} == {(q, d) for q in "abcd" for d in "ab"}
    assert neighbors.top_neighbors(df.limit(0), "id", "part", "q", "d").count() == 0


@pytest.mark.parametrize("block", [8192, 32])
def test_copies_take_no_places_of_other_documents(spark, block):
    line = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0, 0.0]
    near = [("x", f"n{i}", line(0.02 * i), line(0.02 * i)) for i in range(1, 6)]
    rows = [("x", "rep", None, line(0.0))] * 150 + near  # one document, repeated
    rows += [("y", f"c{i:03d}", line(0.0), line(0.0)) for i in range(200)] + [("y", "z", None, line(0.001))]  # 200 documents of one vector
    rows += [("w", "many", None, line(0.0001 * i)) for i in range(150)] + [("w", *r[1:]) for r in near]  # one document of many vectors
    rows += [("x", "q", line(0.0), None), ("y", "q", line(0.0), None), ("w", "q", line(0.0), None)]
    df = spark.createDataFrame(rows, "part string, id string, q array<float>, d array<float>").repartition(3)
    got = {}
    for r in sorted(neighbors.top_neighbors(df, "id", "part", "q", "d", 5, 0.9, block_rows=block).collect(), key=lambda r: r.place):
        got.setdefault((r.partition, r.query_id), []).append(r.document_id)
    assert got["x", "q"] == ["rep", "n1", "n2", "n3", "n4"]
    assert got["w", "q"] == ["many", "n1", "n2", "n3", "n4"]
    assert all(got["y", q] == [f"c{i:03d}" for i in range(5)] for q in ["q", *(f"c{i:03d}" for i in range(200))])


def test_probes_reach_as_far_as_recall_needs():
    import inspect

    assert inspect.signature(neighbors.top_neighbors).parameters["spread"].default >= 1.2


# --- leakage -----------------------------------------------------------------------------------------------------

ITEM = "um carrinho azul descreve o painel regional perto de outro monitor antes que cada sensor semanal bloqueia o extintor verde"


def _leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.edits for r in leakage.leaked(d, "doc_id", "text", i, "item_id", "text", **kw).collect()}


def test_ten_words_whatever_case_accents_and_punctuation(spark):
    words = ITEM.split()
    docs = [(1, "Antes. " + " ".join(words[3:13]).upper() + "! Depois", 0), (2, " ".join(words[3:12]), 0), (3, ", ".join(words), 0), (4, None, 0), (5, "", 0), (6, LONG + ITEM + LONG, 0), (3, ", ".join(words), 0),
            (7, ITEM.replace("e", "é", 3), 0)]
    items = [(70, ITEM), (71, "curto demais"), (72, None), (None, ITEM), (70, ITEM)]
    assert _leaks(spark, docs, items, max_edits=0) == {(1, 70): 0, (3, 70): 0, (6, 70): 0, (7, 70): 0}
    assert _leaks(spark, docs, items) == {(1, 70): 0, (2, 70): 1, (3, 70): 0, (6, 70): 0, (7, 70): 0}
    assert _leaks(spark, docs, items[1:3]) == {} and _leaks(spark, [], items) == {}


@pytest.mark.parametrize("window, edits", [(10, 1), (12, 1), (24, 2)])
def test_the_embedding_alone_reaches_the_target_recall(spark, monkeypatch, window, edits):
    monkeypatch.setattr(leakage, "LEAST_PART", 1000)  # no part lookups
    rng = np.random.default_rng(8)
    vocabulary = [f"palavra{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, window))) for i in range(200)]
    docs = []
    for i, text in items:
        w = text.split()
        for _ in range(edits):
            p, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w = [*w[:p], *(["outra"] if kind == 0 else ["outra", w[p]] if kind == 1 else []), *w[p + 1 :]]
        docs.append((i, " ".join([*rng.choice(vocabulary, 20), *w, *rng.choice(vocabulary, 20)]), 0))
    got = _leaks(spark, docs, items, window=window, max_edits=edits, recall=0.95)
    assert sum((i, i) in got for i in range(200)) >= 180


def test_verified_edits_equal_a_plain_edit_distance():
    rng = np.random.default_rng(9)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row)

    a, b = rng.integers(1, 4, (300, 6)).astype(np.uint64), rng.integers(0, 4, (300, 9)).astype(np.uint64)
    assert leakage.edit_distances(a, b, 9).tolist() == [plain(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_edits_are_found_with_the_target_recall(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"palavra{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(60)]
    docs = []
    for i, text in items:
        w = text.split()
        w[int(rng.integers(1, 11))] = "outra"
        docs.append((i, " ".join([*rng.choice(vocabulary, 30), *w, *rng.choice(vocabulary, 30)]), 0))
    got = _leaks(spark, docs, items, window=12, max_edits=1, recall=0.95)
    assert sum(got.get((i, i)) == 1 for i in range(60)) == 60
    assert set(got.values()) == {1}


def test_words_put_in_or_left_out_are_edits(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"palavra{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(66)]
    docs = []
    for i, text in items:
        w, p = text.split(), 1 + i % 11
        w = [*w[:p], "outra", *w[p:]] if i % 2 else [*w[: min(p, 10)], *w[min(p, 10) + 1 :]]
        around = [*rng.choice(vocabulary, 30)]
        docs.append((i, " ".join([*around, *w, *around]), 0))
        docs.append((1000 + i, " ".join([*around, *w[:5], "mais", "duas", *w[6:], *around]), 0))  # too many edits
    docs.append((999, " ".join(items[0][1].split()[:5] + items[0][1].split()[6:]), 0))  # eleven words are the whole document
    got = _leaks(spark, docs, items, window=12, max_edits=1)
    assert got == {**{(i, i): 1 for i in range(66)}, (999, 0): 1}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, f"{ITEM} numero {i}") for i in range(6)]
    docs = [(i, items[i][1], 0) for i in range(6)]
    whole = _leaks(spark, docs, items)
    monkeypatch.setattr(leakage, "BLOCK_WINDOWS", 20)
    assert _leaks(spark, docs, items) == whole and len(whole) == 36


# --- mixing ------------------------------------------------------------------------------------------------------

pytestmark = pytest.mark.skipif(not os.path.exists(f"{mixing.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"), reason="no tokenizer files")


def test_shares_caps_and_sources_without_documents(spark):
    docs = [(i, ["a", "b", "c"][i % 3 if i % 10 else 2], ["pt", "en", None, "PT-BR"][i % 4], ["x", "y", None][i % 3], f"texto numero {i} " * (1 + i % 7), 1) for i in range(900)]
    docs += [(1000, "d", "pt", "x", None, 1), (1001, "d", "pt", "x", "", 1), (1002, None, "pt", "x", "sem fonte", 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, prompt_family string, text string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.2, 1), ("c", 0.1, 1), ("none", 0.1, 5), ("d", 0.1, 5)], "source string, target_share double, max_repeats int")
    picked, report = mixing.mix(df, targets)
    rows = {r.source: r for r in report.collect()}
    assert rows["none"].share == rows["d"].share == 0 and not rows["d"].reachable
    for s, t in (("a", 0.5), ("b", 0.2), ("c", 0.1)):
        assert rows[s].share == pytest.approx(t / 0.8, abs=0.01)
    got = picked.collect()
    assert max(r.copies for r in got if r.source == "a") <= 2 and max(r.copies for r in got if r.source != "a") == 1 and len({r.doc_id for r in got}) == len(got)
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[0].count() == 0
    small, _ = mixing.mix(df, targets, total_tokens=500)
    assert sum(r.tokens * r.copies for r in small.collect()) == pytest.approx(400, rel=0.2)


def test_labels_without_end_stay_few_classes(spark):
    docs = [(i, "ab"[i % 2], f"lingua{i}" if i % 3 else "pt", f"tema {i}", "texto de teste " * (1 + i % 3)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, prompt_family string, text string")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    picked, report = mixing.mix(df, targets, max_classes=4)
    rows = {r.source: r for r in report.collect()}
    assert rows["a"].share == pytest.approx(0.7, abs=0.02) and rows["b"].share == pytest.approx(0.3, abs=0.02) and picked.count() > 100


def test_rake_meets_marginals_within_caps():
    rng = np.random.default_rng(1)
    mass = rng.uniform(1, 5, 12)
    cells = [np.repeat(np.arange(3), 4), np.tile(np.arange(4), 3)]
    goals = [np.array([6.0, 9.0, 3.0]), np.array([4.0, 5.0, 4.0, 5.0])]
    w = mixing.rake(mass, cells, goals, np.full(12, 50.0))
    for c, g in zip(cells, goals):
        assert np.allclose(np.bincount(c, weights=w * mass), g, atol=1e-3)
    capped = mixing.rake(mass, cells, [g * 10 for g in goals], np.full(12, 2.0))
    assert capped.max() <= 2.0


# --- toxicity ----------------------------------------------------------------------------------------------------


def test_disguises_are_one_form():
    m = toxicity.Crf(np.zeros((1, 4)), np.zeros((4, 4)), {7: ["covarde", "canalha"]})
    forms = {m.form(t) for t in ("covarde", "covvvarde", "c0v4rd3", "cov*rde", "c*****e")}
    assert forms == {"covarde"}
    assert "covarde" in [t for _, _, t in toxicity.tokens("seu c-o-v-a-r-d-e mesmo")]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    e, moves = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    marg = toxicity._forward_backward(e, np.array([4]), moves)[2][:, 0]
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(e[t, 0, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        for t, s in enumerate(path):
            want[t, s] += w
    assert np.allclose(marg, want / want.sum(axis=1, keepdims=True))


def _reviewed():
    """Reviewed documents of our own: one harmful sentence among harmless ones; a tenth of the verdicts is wrong."""
    rng = np.random.default_rng(5)
    who, things = ["o porteiro", "a gerente", "o motorista", "a vizinha", "o síndico"], ["a horta", "o elevador", "o telhado", "a garagem", "o muro"]
    harmless = [f"{w} arrumou {t} ontem" for w in who for t in things] + [f"hoje {w} falou sobre {t}" for w in who for t in things] + ["a turma discutiu o assédio em sala", "os estrangeiros trouxeram doces"]
    bad = {"abuse": [f"{w} não passa de um traste mentiroso" for w in who] + [f"tomara que {w} se machuque feio" for w in who],
           "hate": [f"essa corja de {g} devia sumir daqui" for g in ("forasteiros", "ciganos", "nordestinos", "crentes", "turcos")],
           "sexual": [f"deita comigo e {t} fica por minha conta" for t in things]}
    out = []
    for i in range(600):
        text = [harmless[int(k)] for k in rng.integers(len(harmless), size=4)]
        kind = ["none", "none", "none", "abuse", "hate", "sexual"][i % 6]
        if kind != "none":
            text.insert(int(rng.integers(5)), bad[kind][int(rng.integers(len(bad[kind])))])
        verdict = "none" if kind != "none" and rng.random() < 0.1 else kind
        out.append((". ".join(text) + ".", verdict))
    return out


@pytest.fixture(scope="module")
def crf():
    return toxicity.fit_reviewed(_reviewed(), epochs=8)


def test_scores_spans_and_rates(spark, crf):
    docs = [(1, "O relatório saiu.\nO zelador não passa de um traste mentiroso.\nObrigado.", "s", 1), (2, "o porteiro arrumou o muro ontem. a turma discutiu o assédio em sala", "s", 1),
            (3, "Essa corja de ciganos devia sumir daqui!", None, 1), (4, "d.e.i.t.a comigo e o muro fica por minha conta", "t", 1), (5, None, "t", 1), (6, "", "t", 1),
            (7, LONG + "o síndico não passa de um tr4ste mentirooooso", "t", 1), (7, LONG + "o síndico não passa de um tr4ste mentirooooso", "t", 1), (8, "os estrangeiros trouxeram doces", "t", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score int")
    out = toxicity.score(df, "doc_id", "text", "source", crf)
    rows = out.collect()
    hits = {(r.doc_id, r.category) for r in rows if r.score >= 0.6 and r.spans}
    assert hits == {(1, "abuse"), (3, "hate"), (4, "sexual"), (7, "abuse")}
    one = next(r for r in rows if r.doc_id == 1 and r.category == "abuse")
    assert "traste" in docs[0][1][one.spans[0].start : one.spans[0].stop]
    assert len(rows) == 27
    rates = {(r.source, r.category): r.rate for r in toxicity.source_rates(out).collect()}
    assert rates[(None, "hate")] == 1.0 and rates[("s", "abuse")] == 0.5
    assert toxicity.score(df.limit(0), "doc_id", "text", "source", crf).count() == 0


def test_a_sentence_of_any_length_is_one_chain(spark, crf):
    far = "o porteiro arrumou o muro ontem " * 300 + "e essa corja de ciganos devia sumir daqui " + "hoje a gerente falou sobre o muro " * 300
    df = spark.createDataFrame([(1, far, "s")], "doc_id long, text string, source string")
    hate = next(r for r in toxicity.score(df, "doc_id", "text", "source", crf).collect() if r.category == "hate")
    assert hate.score >= 0.6 and any("corja" in far[x.start : x.stop] for x in hate.spans)


def test_general_phrases_alone_and_empty_reviews(spark):
    model = toxicity.fit_reviewed([], epochs=4)
    words = lambda t: [w for *_, w in toxicity.tokens(toxicity.plain(t)[0])]
    marg = toxicity._scores(model, [words("you are nothing but a jerk"), words("we hired foreigners")])
    assert marg[0][:, 1].mean() > 0.6 and marg[1][:, 0].mean() > 0.5
    docs = spark.createDataFrame([(1, "olá", "s")], "doc_id long, text string, source string")
    reviews = spark.createDataFrame([(1, "r", None)], "doc_id long, reviewer string, category string")
    assert toxicity.fit(docs, "doc_id", "text", reviews, epochs=2).weights.shape == (toxicity.BUCKETS, 4)


def test_verdicts_go_by_majority(spark):
    rows = [(1, "a", "hate"), (1, "b", "hate"), (1, "c", "none"), (1, "c", "none"), (2, "a", "hate"), (2, "b", "none"), (3, "a", None), (None, "a", "hate"), (4, "a", "abuse"), (4, "a", "abuse")]
    got = toxicity._verdicts(spark.createDataFrame(rows, "doc_id long, reviewer string, category string")).collect()
    assert {(r._d, r.category) for r in got} == {(1, "hate"), (4, "abuse")}
