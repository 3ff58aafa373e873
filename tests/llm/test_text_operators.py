import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairscope.llm import format_copies, language, lookalike, models, personal

LONG = "Boa noite a todos. " * 6000


# --- look-alikes -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, clean", [
    ("Sеrіа justо раgаr", "Seria justo pagar"), ("ｍａｉｓ pausa\xads", "mais pausas"), ("Na\xa0minha　casa", "Na minha casa"), ("informação", "informação"),
    ("ﬁm do ﬂuxo", "fim do fluxo"), ("𝗱𝗼𝘀", "dos"), ("n‌othin‌‌g", "nothing"), ("ａ́", "á"), ("a​́", "á"), ("１２－３", "12-3"), ("Α сasa", "A casa"), ("", ""),
])
def test_lookalikes_come_out_plain(raw, clean):
    assert lookalike.normalize(raw) == clean
    out, places = lookalike.normalize(raw, offsets=True)
    assert out == clean and len(places) == len(out) and all(0 <= p < max(len(raw), 1) for p in places) and places == sorted(places)


@pytest.mark.parametrize("text", ["São João, ação!", "“aspas” – traço — ‘x’ «y»", "1º e 2ª", "👩‍💻 🙂 ❤️ 👍🏽 1️⃣", "привет мир", "καλημέρα φίλε", "tab\te\r\nlinha", "m² … ™", None])
def test_plain_text_stays(text):
    assert lookalike.normalize(text) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aбеοι ﬁｅ́̃​‍\xa0🙂👩💻ç1２."), max_size=30))
def test_one_pass_is_enough(text):
    once = lookalike.normalize(text)
    twice = lookalike.normalize(once)
    assert twice == lookalike.normalize(twice)
    out, places = lookalike.normalize(text, offsets=True)
    assert out == once and len(places) == len(out)


@pytest.mark.parametrize("text", ["漢" * 500_000 + "\u3000" + "字" * 500_000, "a" * 500_000 + "о" + "b" * 500_000, "a\u0301" * 300_000, "漢\u200b" * 300_000, "\u0301" * 500_000])
def test_time_is_linear_in_runs_without_blanks(text):
    began = time.time()
    lookalike.normalize(text)
    assert time.time() - began < 3  # a quadratic scanner takes hours


@pytest.mark.parametrize("raw, clean", [("xа\u0301b", "xáb"), ("ｏ\u0301о", "óo"), ("e\u200b\u0301", "é"), ("ab\u200bcd", "abcd"), ("ж\u0301а", "ж\u0301а"), ("漢\u3000字", "漢 字")])
def test_the_longest_cluster_is_taken(raw, clean):
    assert lookalike.normalize(raw) == clean


def test_lookalike_columns(spark):
    rows = [("a", "раgаr", None, "x"), ("b", "", LONG, "x"), ("b", "", LONG, "x"), (None, "ok", "ｏｋ", "x")]
    df = spark.createDataFrame(rows, "pair_id string, source_pt string, translation_en string, text string")
    got = {(r.pair_id, r.field) for r in lookalike.changed_values(df, "pair_id", ["source_pt", "translation_en"]).collect()}
    assert got == {("a", "source_pt"), (None, "translation_en")}
    every = lookalike.consistent_text(df, "pair_id", ["source_pt", "translation_en"]).collect()
    assert len(every) == 8 and sum(r.changed for r in every) == 2 and {r.consistent for r in every} == {"pagar", None, "", LONG, "ok"}
    assert lookalike.changed_values(df.limit(0), "pair_id", ["source_pt"]).count() == 0


def test_jvm_and_python_agree_on_suspects(spark):
    chars = [chr(c) for c in [*range(0x20, 0x600), *range(0x2000, 0x2100), *range(0xFB00, 0xFB10), 0xFEFF, 0x1D5D4, 0x3000, 0xFF21, *range(0x1F600, 0x1F610)]]
    got = spark.createDataFrame([(c,) for c in chars], "c string").select("c", lookalike.suspect_column(F.col("c")).alias("s")).collect()
    assert all(r.s == lookalike.suspect(r.c) for r in got)
    assert all(lookalike.suspect(c) for c in chars if lookalike.normalize(c) != c)


# --- personal details --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, redacted", [
    ("Escrevam para <mailto:airton+rh7@example.com>, por favor", "Escrevam para <mailto:[EMAIL]>, por favor"),
    ("mandei tudo de ivete.x(at)rh(dot)invalid e nada", "mandei tudo de [EMAIL] e nada"),
    ("contato: ana_lima arroba rh ponto invalid.", "contato: [EMAIL]."),
    ("Liguem no +55 72 98713-4220 depois das 18h", "Liguem no [PHONE] depois das 18h"),
    ("Zap 56 9 2272-8370 ramal 17; obrigado", "Zap [PHONE]; obrigado"),
    ("Cadastro no CPF 013.682.446-62.", "Cadastro no CPF [ID_NUMBER]."),
    ("Segue 184 199 687 77 (CPF) para conferir", "Segue [ID_NUMBER] (CPF) para conferir"),
    ("Moro na Rua das Quaresmeiras Rasos, 254 até aqui", "Moro na [ADDRESS] até aqui"),
    ("I live at 2451 Monte do Sul Street now", "I live at [ADDRESS] now"),
    ("Ontem vi Rosana Kovacsik na rua", "Ontem vi [NAME] na rua"),
    ("Ontem KOVACSIK, IOLANDA faltou", "Ontem KOVACSIK, [NAME] faltou"),
    ("nome: Kovacsik, Iolanda; e só", "nome: [NAME]; e só"),
    ("quem fechou foi ester e mais ninguém", "quem fechou foi [NAME] e mais ninguém"),
    ("chegou um recado de T. Kovacsik ontem", "chegou um recado de [NAME] ontem"),
    ("Vi ROSANA KOVACSIK no corredor", "Vi [NAME] no corredor"),
    ("O canal [E-MAIL] foi removido. Lote 20231107-3344 chegou.", None), ("O protocolo 2021.004.118-07 segue aberto; R$ 12.345,67", None), ("A sala 1204-B fica na rua de trás (ver chamado 0000043682)", None),
    ("O Projeto Lumiar ajudou o Espaço Ipê. Das 08:00 às 17:48, 220 horas", None), ("Usem a hashtag @equipe_norte no mural", None), ("basta cumprir o que foi prometido", None), ("", None), (None, None),
])
def test_redaction(text, redacted):
    assert personal.redact(text) == (text if redacted is None else redacted)


@pytest.mark.parametrize("text, redacted", [
    ("Meu nome é Kleber", "Meu nome é [NAME]"), ("my name is Kleber.", "my name is [NAME]."), ("Sra. Oliveira", "Sra. [NAME]"), ("falar com a sra. oliveira amanhã", "falar com a sra. [NAME] amanhã"),
    ("Falem com Kleber Aguiar no meu lugar", "Falem com [NAME] no meu lugar"), ("o colega Kleber de Aguiar ajudou bastante", "o colega [NAME] ajudou bastante"),
    ("we met Thaddeus Thompson there", "we met [NAME] there"), ("conversei com Zenobia Bezerra ontem", "conversei com [NAME] ontem"), ("my SSN 123-45-6789 leaked", "my SSN [ID_NUMBER] leaked"),
    ("at 221B Baker Street, London", "at [ADDRESS], London"), ("he went to 1600 Pennsylvania Ave NW yesterday", "he went to [ADDRESS] yesterday"), ("card 4111 1111 1111 1111 ok", "card [ID_NUMBER] ok"),
    ("bare 52998224725 number", "bare [ID_NUMBER] number"), ("bare 41722598311 number", None), ("card 4111 1111 1111 1112 no", None), ("20 people down the road", None), ("company 12.345.678/0001-95", None),
    ("Plan B. Depois vem", None), ("Na cidade de São Paulo e em Santa Rita", None), ("o Hospital Santa Rosa e o Banco Pereira", None), ("Thank You All For Coming", None), ("graça de graça", None),
    ("Falem com o RH", None), ("falem com Recursos Humanos hoje", None), ("foi Sexta", None), ("a dona da oliveira", None), ("Eu Gosto De Abrir O Que Foi Prometido Na Reunião", None),
])
def test_cued_names_that_no_list_knows(text, redacted):
    assert personal.redact(text) == (text if redacted is None else redacted)


#: Lines whose names, streets and hosts are in no list of the module, with the kinds they hold.
HELD_OUT = [
    ("Spoke with Bartholomew Quigley about the rota", "name"), ("My name is Ngozi Adeyemi and I like it here", "name"), ("Meu nome é Euclides Przybylski", "name"), ("Sra. Wojciechowska foi gentil", "name"),
    ("falei com Tarcila Venancourt na sexta", "name"), ("ask for Mr. Oyelaran at the desk", "name"), ("recebi ajuda de E. Przybylski ontem", "name"), ("ass.: Ludmila Venancourt", "name"), ("the nurse Zuri helped", ""),
    ("write to zuri_99@clinic.example.org today", "email"), ("meu e-mail: tarcila (arroba) posto (ponto) example", "email"), ("ngozi at mail dot example dot net", "email"), ("@zuri respondeu", ""), ("meet at noon at the gate", ""),
    ("call +44 20 7946-0958 now", "phone"), ("ligue (11) 93456-7890", "phone"), ("tel 3456-7890 ramal 12", "phone"), ("whatsapp 11 93456-7890", "phone"), ("lote 34567890 chegou", ""), ("em 2023 vendemos 3456789 peças", ""),
    ("CPF 390.533.447-05 na ficha", "id_number"), ("RG 45.678.912-3", "id_number"), ("passport 123456789", "id_number"), ("protocolo 390533447-05", ""), ("ssn 987-65-4329", "id_number"), ("pedido nº 123-45-678", ""),
    ("moro na Alameda Jacarandá Mimoso, 88", "address"), ("12 Tottenham Lane is my place", "address"), ("rodovia BR-101, km 33", "address"), ("na rua ao lado, 20 horas", ""), ("quadra 12 lote 4", "address"), ("três ruas e 40 casas", ""),
]


def test_held_out_lines():
    found = [(want, {k for _, _, k in personal.detect(text)}) for text, want in HELD_OUT]
    hit = sum(want in got for want, got in found if want)
    assert hit >= 0.85 * sum(bool(w) for w, _ in found)
    assert sum(bool(got - {want}) for want, got in found) <= 0.1 * len(found)


def test_surnames_are_learned_from_the_corpus(spark):
    rows = [("a", "Signed: Marcos Venancourt", None), ("b", "hoje Ivete Venancourt veio aqui", ""), ("c", "a ivete venancourt chegou", None), ("d", "Renata Gosta de sair", None), ("e", "Bruno Gosta de sair", "ela gosta"), ("f", None, None)]
    df = spark.createDataFrame(rows, "pair_id string, s string, t string")
    learned = personal.learn_surnames(df, ["s", "t"])
    assert {r.word for r in learned.collect()} == {"venancourt"}
    want = {"a": "Signed: [NAME]", "b": "hoje [NAME] veio aqui", "c": "a [NAME] chegou", "f": None}
    for limit in (200_000, 0):  # words with the task, words joined
        got = {r.pair_id: r.redacted for r in personal.redact_fields(df, "pair_id", ["s"], learned=learned, max_broadcast=limit).collect()}
        assert {k: got[k] for k in want} == want and len(got) == 6
    assert personal.learn_surnames(df.limit(0), ["s"]).count() == 0


def test_name_lists_are_arguments(spark):
    names = personal.Names(given=frozenset({"kleberson"}))
    assert personal.redact("hoje Kleberson e Marina saem", names) == "hoje [NAME] e Marina saem"
    df = spark.createDataFrame([("a", "hoje Kleberson saiu cedo")], "pair_id string, s string")
    assert personal.found_kinds(df, "pair_id", ["s"]).count() == 0 and personal.found_kinds(df, "pair_id", ["s"], names).count() == 1
    assert personal.redact_fields(df, "pair_id", ["s"], names).first().redacted == "hoje [NAME] saiu cedo"


def test_names_inside_mails_and_streets_are_none():
    kinds = {k for _, _, k in personal.detect("Write to marina.silva@example.org; Rua Benedita Lopes, 12")}
    assert kinds == {"email", "address"}


def test_disguised_details_keep_their_places():
    text = "Zap ６０.４６８４.３７９⁠８ e Αirton fim"
    spans = personal.detect(text)
    assert [text[a:b] for a, b, k in spans if k == "phone"] == ["６０.４６８４.３７９⁠８"]


def test_personal_columns(spark):
    rows = [("a", "falem com Marina Kovacsik", "x", "y"), ("a", "falem com Marina Kovacsik", "x", "y"), ("b", None, "", "y"), ("c", LONG + "cpf: 44112335957", "ok", "y")]
    df = spark.createDataFrame(rows, "pair_id string, source_pt string, translation_en string, kind string")
    assert {tuple(r) for r in personal.found_kinds(df, "pair_id", ["source_pt", "translation_en"]).collect()} == {("a", "source_pt", "name"), ("c", "source_pt", "id_number")}
    out = personal.redact_fields(df, "pair_id", ["source_pt", "translation_en"]).collect()
    assert len(out) == 8 and {r.redacted for r in out if r.pair_id == "b"} == {None, ""}
    assert next(r for r in out if r.pair_id == "c" and r.field == "source_pt").redacted == LONG + "cpf: [ID_NUMBER]"
    assert personal.found_kinds(df.limit(0), "pair_id", ["source_pt"]).count() == 0


# --- formatting copies -------------------------------------------------------------------------------------------


def test_canonical_forms():
    c = format_copies.canonical_text
    assert c("“Boa  NOITE, a todos!”") == c("boa noite\ta todos")
    assert c("Tema: a; Pedido = b | Quem: c") == c("QUEM=c\nTema: a // pedido: b")
    assert c("Tema: a; b: c") != c("Tema: b; a: c") and c("12 casos") != c("13 casos") and c("ação") != c("acao")
    assert c("!!!") == "!!!" and c("") == ""


@pytest.mark.parametrize("a, b", [("-5 graus", "5 graus"), ("50%", "50"), ("custa 3.5", "custa 3 5"), ("C++", "C#"), ("bom 👍", "bom 👎"), ("R$ 5", "5"), ("1,5", "15")])
def test_what_changes_a_meaning_stays_apart(a, b):
    assert format_copies.canonical_text(a) != format_copies.canonical_text(b)


@pytest.mark.parametrize("a, b", [("- 5 graus", "5 graus"), ("# Aviso: sala fechada", "aviso sala fechada"), ("■ fim | de turno", "Fim... de (turno)!"), ("a — b", "a-b"), ("«a»", "“A”"), ("fim.", "fim"), ("nota,5 dias", "NOTA 5 dias")])
def test_formatting_is_none(a, b):
    assert format_copies.canonical_text(a) == format_copies.canonical_text(b)


def test_copies_of_a_hot_record_and_small_ones(spark):
    rows = [(f"p{i:04d}", ["Nada a dizer hoje.", "NADA  a dizer, hoje!"][i % 2], "z") for i in range(1500)] + [(f"q{i:04d}", f"texto {i // 2}" + "!" * (i % 2), "z") for i in range(2000)]
    rows += [("r1", None, "z"), (None, "texto 1", "z"), ("s1", "", "z"), ("s2", " ", "z"), ("p0000", "Nada a dizer hoje.", "z")]
    df = spark.createDataFrame(rows, "id string, text string, _h string")
    got = {(r.kept_id, r.id) for r in format_copies.copies(df, "id", "text").collect()}
    assert {("p0000", f"p{i:04d}") for i in range(1, 1500)} <= got and {(f"q{i:04d}", f"q{i + 1:04d}") for i in range(0, 2000, 2)} <= got and ("s1", "s2") in got
    assert len(got) == 1499 + 1000 + 1
    groups = format_copies.copy_groups(df, "id", "text").collect()
    assert max(r.n_copies for r in groups) == 1501 and sum(r.n_copies for r in groups) == 3504 and not any(r.collides for r in groups)
    assert format_copies.copies(df.limit(0), "id", "text").count() == 0


# --- language ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def net():
    return language.train(language.builtin_clauses(), steps=260, batch=80, length=64)


def test_gradient_equals_difference_quotient():
    rng = np.random.default_rng(0)
    r = lambda *s: rng.normal(0, 0.4, s)
    n = language.ByteGru([r(256, 9) for _ in "ab"], [r(3, 9) for _ in "ab"], [r(3) for _ in "ab"], r(6, 4), r(4))
    x = rng.integers(97, 101, (6, 3)).astype(np.uint8)
    x[4:, 1] = 0
    y = rng.integers(0, 4, (6, 3))
    _, grads = language._gradients(n, x, y)
    for p, g in zip(n.params(), grads):
        flat = p.reshape(-1)
        for k in np.flatnonzero(g.reshape(-1))[:6]:
            old = flat[k]
            flat[k] = old + 1e-3
            up = language._gradients(n, x, y)[0]
            flat[k] = old - 1e-3
            down = language._gradients(n, x, y)[0]
            flat[k] = old
            assert (up - down) / 2e-3 == pytest.approx(g.reshape(-1)[k], abs=2e-3)


#: Sentences of our own that are no training text.
SENTENCES = {
    "pt": ["a minha filha começou a estudar música", "o mercado fecha cedo aos domingos", "perdi o ônibus e cheguei atrasado", "eles moram longe mas visitam os pais", "a sopa precisa de um pouco mais de sal", "vou levar o cachorro ao veterinário",
           "não consegui dormir por causa do calor", "o professor explicou tudo outra vez"],
    "en": ["my daughter has started to study music", "the market closes early on sundays", "i missed the bus and arrived late", "they live far away but visit their parents", "the soup needs a little more salt", "i will take the dog to the vet",
           "i could not sleep because of the heat", "the teacher explained everything again"],
    "es": ["mi hija empezó a estudiar música", "el mercado cierra temprano los domingos", "perdí el autobús y llegué tarde", "ellos viven lejos pero visitan a sus padres", "la sopa necesita un poco más de sal", "voy a llevar el perro al veterinario",
           "no pude dormir por culpa del calor", "el profesor explicó todo otra vez"],
    "fr": ["ma fille a commencé à étudier la musique", "le marché ferme tôt le dimanche", "j'ai raté le bus et je suis arrivé en retard", "ils habitent loin mais rendent visite à leurs parents", "la soupe a besoin d'un peu plus de sel",
           "je vais emmener le chien chez le vétérinaire", "je n'ai pas pu dormir à cause de la chaleur", "le professeur a tout expliqué encore une fois"],
}


def test_held_out_sentences(net):
    right = total = 0
    for i, name in enumerate(language.LANGS):
        text, _, _, lang, _ = language.label_texts(net, SENTENCES[name])
        right += sum(lang[text == k][0] == i for k in range(len(SENTENCES[name])) if (text == k).any())
        total += len(SENTENCES[name])
    assert right / total >= 0.9


def test_verdicts_vote_on_clauses_without_function_words():
    clause = "pausas curtas ajudam bastante"
    assert language.weak_label(clause) is None
    assert clause in language.training_clauses([(clause.capitalize() + ".", "pt")] * 5)[0]
    assert not any(clause in c for c in language.training_clauses([(clause, None)] * 5))


def test_names_of_projects_are_of_no_language():
    assert "aurora" not in language.prepare("Projeto Aurora helped us") and "helped" in language.prepare("Projeto Aurora helped us")
    assert "projeto ajudou" in language.prepare("o projeto ajudou")


def test_mixed_text_has_both_languages_in_order(net):
    t = language.prepare("A minha filha não quis comer nada ontem. The neighbours have gone away because of the rain.")
    _, start, stop, lang, sure = language.label_texts(net, [t])
    assert [language.LANGS[x] for x in lang] == ["pt", "en"] and stop[0] <= start[1] and (sure > 0.5).all()


def test_any_number_of_changes_without_punctuation(net):
    pt = "ela mora perto da estação com os filhos e não tem tempo para cozinhar porque sai de casa muito cedo "
    for times in (1, 4, 16):
        t = language.prepare(pt * times + "the children have been playing in the garden with their friends " + pt * times + "i think that she would like to know the price")
        _, start, _, lang, _ = language.label_texts(net, [t])
        assert [language.LANGS[x] for x in lang] == ["pt", "en", "pt", "en"]
        assert abs(start[1] - t.index("the children")) <= 12
    assert language._changes(np.log(np.full((8, 4), 0.25))) == []


def test_apostrophes_and_ligatures_break_no_clause(net):
    t = "l’usine n’a pas d’œuvre à l’équipe et l’ambiance d’ici n’est pas bonne"
    raw = language._encode(t)
    assert len(raw) == len(t) and not language._BREAKS[raw].any() and not (raw == ord("?")).any()
    assert bytes(language._encode("“não” – ок ł")) == "?não? ? \x1a\x1a \x1a".encode("latin-1")
    _, start, stop, lang, _ = language.label_texts(net, [t, t.replace("’", "'")])
    assert [language.LANGS[x] for x in lang] == ["fr", "fr"] and start[0] == start[1] == 0 and stop[0] == stop[1]


def test_language_columns(spark, net):
    rows = [("a", "ela não sabe onde deixou as chaves", None, 9, None), ("b", "", "...", 9, 9), ("b", "", "...", 9, 9), ("c", LONG, "je ne sais pas où sont les enfants", 9, 9)]
    df = spark.createDataFrame(rows, "pair_id string, s string, t string, n int, lang int")
    seg = language.segments(df, "pair_id", {"s": "pt", "t": "en"}, net).collect()
    assert {r.id for r in seg} == {"a", "c"} and next(r for r in seg if r.field == "t").lang == "fr"
    assert max(r.stop for r in seg) > 100_000 and all(0 <= r.start < r.stop and 0 <= r.confidence <= 1 for r in seg)
    whole = {(r.id, r.field): (r.lang, r.n_langs) for r in language.documents(df, "pair_id", {"s": "pt", "t": "en"}, net).collect()}
    assert whole[("a", "s")] == ("pt", 1) and whole[("c", "t")] == ("fr", 1) and ("b", "s") not in whole
    assert language.segments(df.limit(0), "pair_id", {"s": "pt"}, net).count() == 0


def test_models_are_fitted_once(spark, tmp_path, net):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    calls = []
    make = lambda: calls.append(1) or net.arrays()
    first = models.stored("test", [df], {"x": 1}, [language], make)
    again = models.stored("test", [df], {"x": 1}, [language], make)
    assert len(calls) == 1 and all((first[k] == again[k]).all() for k in first)
    assert (language.ByteGru.of(again).out == net.out).all()
    models.stored("test", [df], {"x": 2}, [language], make)
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "a"))
    models.stored("test", [spark.read.parquet(str(tmp_path / "a"))], {"x": 1}, [language], make)
    assert len(calls) == 3
