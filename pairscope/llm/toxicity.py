"""Abusive, hateful and sexual content: document scores, offending offsets, rates for each source.

Method: a linear-chain conditional random field over words with the tags none, abuse, hate, sexual, fitted in numpy.
Forward-backward marginals give each word its tag probabilities; runs of words above one half are the offending spans, and a
document's score for a category is the best mean marginal of such a run.

Labelled words come from reviewed documents, started by a small set of general phrases in three languages. A review says only what a
document holds, so the sentences of documents judged harmless are labelled none, and in documents judged harmful those sentences are
labelled that the field fitted so far finds most likely. In the first round, when it knows the general phrases alone, a sentence also
counts for what it holds that no harmless document does. A sentence of harmless documents that the later field is sure about,
and that is of one harmless document alone or of far more harmful ones, is taken as a mistake of the reviewer and leaves the sample. Reviews are put together by majority; ties, null verdicts and repeated rows say nothing.

Bounds of the sample fitted on: ``max_reviewed`` reviewed documents and ``max_harmless`` different harmless sentences, chosen by hash.
Every document is scored, whole, in chains of a sentence of any length.

Spelling disguises are undone before tagging: look-alikes, spaced or dotted letters, digits and signs for letters, stretched letters,
and masked letters where one known word fits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.llm.lookalike import normalize, suspect
from pairscope.llm.personal import FOLD

TAGS = ("none", "abuse", "hate", "sexual")
BUCKETS = 1 << 17
FEATURES = 5
TRAIN_WORDS = 192  # a longer sentence is learned from in pieces of this many words; scoring cuts nothing
CELLS = 300_000  # words, padding included, that are scored at once

# General insults, groups of people and phrases to start from; {x} and {g} are filled from the lists of the language.
INSULTS = {
    "pt": "idiota imbecil burro estúpido canalha covarde palhaço inútil nojento otário babaca cretino vagabundo desgraçado verme lixo porco safado",
    "en": "idiot moron stupid bastard coward clown useless loser scumbag jerk cretin bum wretch worm trash pig fool",
    "es": "idiota imbécil burro estúpido canalla cobarde payaso inútil asqueroso tonto cretino vago desgraciado gusano basura cerdo",
}
GROUPS = {
    "pt": "os estrangeiros|as mulheres|os negros|os gays|os imigrantes|os judeus|os muçulmanos|os pobres|os deficientes|os velhos|os índios|os crentes",
    "en": "foreigners|women|black people|gays|immigrants|jews|muslims|the poor|the disabled|old people|indians|believers",
    "es": "los extranjeros|las mujeres|los negros|los gays|los inmigrantes|los judíos|los musulmanes|los pobres|los discapacitados|los viejos|los indios|los creyentes",
}
PHRASES = {
    "pt": {
        "abuse": "{x}|que {x}|você não passa de um {x}|ela é muito {x}|são todos {x}|cale-se {x}|odeio você|eu te mato|vou te matar|vou bater em você|vou te dar uma surra|você vai apanhar|você vai se arrepender|espero que você morra|vá se danar",
        "hate": "odeio {g}|{g} são inferiores|{g} são animais|{g} não prestam|expulsem {g}|{g} deviam ser expulsos daqui|{g} não deviam trabalhar|ninguém quer {g} por perto|{g} roubam tudo|voltem para a sua terra",
        "sexual": "sexo comigo|durma comigo|tire a roupa|quero ver você nua|mande fotos nua|quero beijar o seu corpo|que gostosa|você me excita|fique pelada para mim|vamos transar",
        "none": "respeito {g}|trabalho com {g}|{g} da equipe são competentes|apoio para {g}|{g} almoçam aqui|gosto de conversar com {g}|é proibido dizer {x}|alguém escreveu {x} no mural|{g} são bem-vindos|contratamos {g}|palestra sobre violência|curso sobre racismo|exame de saúde da mulher|educação sexual|denúncia de assédio|matar a fome|joguei o lixo|um porco assado",
    },
    "en": {
        "abuse": "{x}|what a {x}|you are nothing but a {x}|she is so {x}|they are all {x}|be quiet {x}|i hate you|i will kill you|i am going to kill you|i will hit you|i will beat you up|you will get hurt|you will be sorry|i hope you die|damn you",
        "hate": "i hate {g}|{g} are inferior|{g} are animals|{g} are no good|expel {g}|{g} should be expelled from here|{g} should not work|nobody wants {g} around|{g} steal everything|go back to your country",
        "sexual": "sex with me|sleep with me|take your clothes off|i want to see you naked|send nude photos|i want to kiss your body|so sexy|you turn me on|get naked for me|let us have sex",
        "none": "i respect {g}|i work with {g}|{g} in the team are skilled|support for {g}|{g} have lunch here|i like talking with {g}|saying {x} is forbidden|someone wrote {x} on the board|{g} are welcome|we hired {g}|a talk about violence|a course on racism|a health check for women|sex education|a harassment complaint|kill time|take out the trash|a roast pig",
    },
    "es": {
        "abuse": "{x}|qué {x}|no eres más que un {x}|ella es muy {x}|son todos {x}|silencio {x}|te odio|te mato|te voy a matar|te voy a pegar|te voy a dar una paliza|vas a sufrir|te vas a arrepentir|espero que te mueras|maldito seas",
        "hate": "odio a {g}|{g} son inferiores|{g} son animales|{g} no sirven|expulsen a {g}|{g} deberían ser expulsados de aquí|{g} no deberían trabajar|nadie quiere a {g} cerca|{g} roban todo|vuelvan a su tierra",
        "sexual": "sexo conmigo|duerme conmigo|quítate la ropa|quiero verte desnuda|manda fotos desnuda|quiero besar tu cuerpo|qué sexy|me excitas|desnúdate para mí|vamos a tener sexo",
        "none": "respeto a {g}|trabajo con {g}|{g} del equipo son competentes|apoyo para {g}|{g} almuerzan aquí|me gusta hablar con {g}|está prohibido decir {x}|alguien escribió {x} en el mural|{g} son bienvenidos|contratamos a {g}|charla sobre violencia|curso sobre racismo|examen de salud de la mujer|educación sexual|denuncia de acoso|matar el tiempo|tiré la basura|un cerdo asado",
    },
}

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_·]){3,}[^\W_](?![^\W_])")
_JOINTS = re.compile(r"[ .\-_·]")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[*#$@!](?=[^\W_*#$@]))*[*]*")
_BREAK = re.compile(r"[.!?;:\n\r]+(?=\s|$|[\"“”»'])|[\n\r]+")
_LEET = str.maketrans("0134578@$!#", "oieastbasi*")
_RUN = re.compile(r"(.)\1+")


_FOLD_BYTES = bytes(FOLD.get(i, i) for i in range(256))


def plain(text: str) -> tuple[str, list[int] | None]:
    """Look-alikes undone, folded; with the place of each character in the text (None: unchanged)."""
    if suspect(text):
        text, places = normalize(text, offsets=True)
    else:
        places = None
    try:  # by bytes where Latin-1 has every character
        return text.encode("latin-1").translate(_FOLD_BYTES).decode("latin-1"), places
    except UnicodeEncodeError:
        return text.translate(FOLD), places


def tokens(text: str) -> list[tuple[int, int, str]]:
    """Words (start, end, raw form) of a folded text, spaced letters joined."""
    out: list[tuple[int, int, str]] = []
    last = 0
    for m in _SPACED.finditer(text) if _SPACED.search(text) else ():
        out += [(last + t.start(), last + t.end(), t.group()) for t in _TOKEN.finditer(text[last : m.start()])]
        out.append((m.start(), m.end(), _JOINTS.sub("", m.group())))
        last = m.end()
    out += [(last + t.start(), last + t.end(), t.group()) for t in _TOKEN.finditer(text[last:])]
    return out


def words_of(text: str) -> list[str]:
    """Raw forms of the words alone."""
    return [t for _, _, t in tokens(text)] if _SPACED.search(text) else _TOKEN.findall(text)


@dataclass
class Crf:
    """Feature weights (BUCKETS, tags), transitions (tags, tags), and the words known from harmful sentences, by length."""

    weights: np.ndarray
    moves: np.ndarray
    known: dict[int, list[str]] = field(default_factory=dict)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"weights": self.weights, "moves": self.moves, "known": np.array([w for k in sorted(self.known) for w in self.known[k]], dtype=np.str_)}

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> Crf:
        known: dict[int, list[str]] = {}
        for w in arrays["known"].tolist():
            known.setdefault(len(w), []).append(w)
        return Crf(arrays["weights"], arrays["moves"], known)

    def form(self, raw: str) -> str:
        """Undisguised form of one word: letters for digits and signs, no doubled letters, masks filled."""
        if raw.isdigit():
            return "0"
        if not raw.isalpha():
            letters = sum(c.isalpha() for c in raw)
            word = raw.translate(_LEET) if letters else raw
            if "*" in word:
                shape = re.compile(word.replace("*", "."))
                fits = [w for w in self.known.get(len(word), ()) if shape.fullmatch(w)]
                word = fits[0] if len(fits) == 1 or fits and letters >= 2 else word.replace("*", "")
            raw = word
        return _RUN.sub(r"\1", raw)


def _sentences(text: str) -> list[tuple[int, str]]:
    """(place, sentence) of a folded text; breaks are ends of sentences and lines."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > at:
            out.append((at, text[at : m.start()]))
        at = m.end()
    if at < len(text):
        out.append((at, text[at:]))
    return out


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _features(word: np.ndarray, stem: np.ndarray) -> np.ndarray:
    """Hashed features of padded word hashes (T, B): word, stem, word with each neighbour, both neighbours."""
    pad = np.zeros((1, word.shape[1]), dtype=np.uint64)
    before, after = np.concatenate([pad, word[:-1]]), np.concatenate([word[1:], pad])
    with np.errstate(over="ignore"):
        parts = [word * _MIX[0], stem * _MIX[1], before * _MIX[2] ^ word * _MIX[3], word * _MIX[4] ^ after * _MIX[1], before * _MIX[3] ^ after * _MIX[0] ^ _MIX[2]]
        return np.stack([(p ^ (p >> np.uint64(31))) * _MIX[0] >> np.uint64(64 - 17) for p in parts], axis=2).astype(np.int64)


def _hashes(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([xxhash.xxh64_intdigest(f) for f in forms], dtype=np.uint64), np.array([xxhash.xxh64_intdigest(f[:4], 1) for f in forms], dtype=np.uint64)


def _pad(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(c) for c in chains])
    out = np.zeros((size.max(), len(chains)), dtype=np.int64)
    for j, c in enumerate(chains):
        out[: len(c), j] = c
    return out, size


def _forward_backward(e: np.ndarray, size: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled messages: (alpha, beta) up to a factor for each place, and marginals (T, B, S). exp-domain, places past the end are neutral."""
    steps, batch, n = e.shape
    potential = np.exp(e - e.max(axis=2, keepdims=True))
    m = np.exp(moves)
    alpha, beta = np.empty_like(potential), np.ones_like(potential)
    a = potential[0]
    for t in range(steps):
        if t:
            a = (a @ m) * potential[t]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[t] = a
    b = np.ones((batch, n), dtype=e.dtype)
    for t in range(steps - 2, -1, -1):
        nxt = (b * potential[t + 1]) @ m.T
        b = np.where((t + 1 < size)[:, None], nxt / nxt.sum(axis=1, keepdims=True), 1.0).astype(e.dtype)
        beta[t] = b
    marg = alpha * beta
    marg /= marg.sum(axis=2, keepdims=True)
    return alpha, beta, marg


def _train(chains: list[np.ndarray], tags: list[np.ndarray], words: np.ndarray, stems: np.ndarray, epochs: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Adagrad on the negative log likelihood of tag chains; chains hold word numbers (0 is padding)."""
    rng = np.random.default_rng(seed)
    n = len(TAGS)
    w, moves = np.zeros((BUCKETS, n), np.float32), np.full((n, n), -1.5, np.float32)
    np.fill_diagonal(moves, 0.5)
    gw, gm = np.full((BUCKETS, n), 1e-3, np.float32), np.full((n, n), 1e-1, np.float32)
    order = np.arange(len(chains))
    eye = np.eye(n, dtype=np.float32)
    sizes = np.array([len(c) for c in chains])
    for _ in range(epochs):
        rng.shuffle(order)
        batches = []
        for at in range(0, len(order), 4096):  # chains of like length together, so that little is padding
            near = order[at : at + 4096][np.argsort(sizes[order[at : at + 4096]], kind="stable")]
            batches += [near[i : i + 256] for i in range(0, len(near), 256)]
        for i in rng.permutation(len(batches)):
            pick = batches[i]
            x, size = _pad([chains[i] for i in pick])
            y, _ = _pad([tags[i] for i in pick])
            fid = _features(words[x], stems[x])
            on = np.arange(len(x))[:, None] < size
            e = w[fid].sum(axis=2) * on[..., None]
            alpha, beta, marg = _forward_backward(e, size, moves)
            d = (marg - eye[y]) * on[..., None] / len(pick)
            # expected and observed transitions
            pot = np.exp(e - e.max(axis=2, keepdims=True))
            pair = alpha[:-1, :, :, None] * np.exp(moves) * (pot[1:] * beta[1:])[:, :, None, :]
            pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-12)
            both = on[1:]
            dm = (pair * both[..., None, None]).sum(axis=(0, 1))
            np.subtract.at(dm, (y[:-1][both], y[1:][both]), 1)
            dm = dm / len(pick)
            live = on.ravel()
            flat = fid.reshape(-1, FEATURES)[live]
            g = np.repeat(d.reshape(-1, n)[live], FEATURES, axis=0)
            ids, back = np.unique(flat.ravel(), return_inverse=True)
            total = np.stack([np.bincount(back, weights=g[:, k], minlength=len(ids)) for k in range(n)], axis=1).astype(np.float32)
            total += 2e-5 * w[ids]
            gw[ids] += total**2
            w[ids] -= 0.25 * total / np.sqrt(gw[ids])
            gm += dm**2
            moves -= (0.1 * dm / np.sqrt(gm)).astype(np.float32)
    return w, moves


def _builtin() -> list[tuple[list[str], int]]:
    out = []
    for lang, kinds in PHRASES.items():
        insults, groups = INSULTS[lang].split(), GROUPS[lang].split("|")
        for kind, phrases in kinds.items():
            for phrase in phrases.split("|"):
                fills = [phrase.replace("{x}", x) for x in insults] if "{x}" in phrase else [phrase.replace("{g}", g) for g in groups] if "{g}" in phrase else [phrase] * 4
                out += [([t for _, _, t in tokens(f.translate(FOLD))], TAGS.index(kind)) for f in fills]
    return out


def _verdicts(reviews: DataFrame) -> DataFrame:
    """``_d``, ``category``: what most reviewers of a document say; ties and null verdicts say nothing, repeated rows count once."""
    verdict = reviews.select(F.col("doc_id").cast("long").alias("_d"), "reviewer", "category").dropna(subset=["_d", "category"]).distinct()
    votes = verdict.groupBy("_d", "category").agg(F.count(F.lit(1)).alias("n"))
    ranked = votes.groupBy("_d").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))).alias("v"))  # four categories at most
    return ranked.filter((F.size("v") == 1) | (F.col("v")[0]["n"] < F.try_element_at("v", F.lit(2))["n"])).select("_d", F.col("v")[0]["category"].alias("category"))


def fit(documents: DataFrame, id_column: str, text_column: str, reviews: DataFrame, max_reviewed: int = 8_000, max_harmless: int = 12_000, epochs: int = 12) -> Crf:
    """Fit on the general phrases, at most ``max_reviewed`` reviewed documents and ``max_harmless`` different sentences of the harmless among them."""
    bounded = _verdicts(reviews).orderBy(F.xxhash64("_d"), "_d").limit(max_reviewed)
    rows = documents.select(F.col(id_column).cast("long").alias("_d"), F.col(text_column).cast("string").alias("t")).dropna().join(F.broadcast(bounded), "_d").toPandas()  # at most max_reviewed ids
    return fit_reviewed(list(zip(rows["t"], rows["category"])), max_harmless, epochs)


def _key(words: list[str]) -> tuple[str, ...]:
    """A sentence whatever letters it stretches or doubles."""
    return tuple(_RUN.sub(r"\1", w) for w in words)


def fit_reviewed(reviewed: list[tuple[str, str]], max_harmless: int = 12_000, epochs: int = 12) -> Crf:
    """Fit on (text, category) of reviewed documents."""
    rng = np.random.default_rng(7)
    number = lambda w: "0" if w.isdigit() else w
    clean: Counter[tuple[str, ...]] = Counter()  # harmless and harmful documents that hold a sentence
    harmful: Counter[tuple[str, ...]] = Counter()
    verdicts: dict[tuple[str, ...], np.ndarray] = {}  # verdicts on the harmful documents that hold a sentence
    doubtful: list[tuple[int, list[list[str]]]] = []
    in_clean: Counter = Counter()
    in_harmful: Counter = Counter()
    n_clean = 0
    for text, category in sorted(set(reviewed)):
        sents = [words for _, s in _sentences(plain(text)[0]) if (words := [number(t) for t in words_of(s)])]
        held = {p for s in sents for p in (*zip(("", *s), (*s, "")), *s)}  # pairs of neighbours, and words
        if category == "none":
            clean.update(set(map(tuple, sents)))
            in_clean.update(held)
            n_clean += 1
        elif category in TAGS:
            doubtful.append((TAGS.index(category), sents))
            harmful.update(set(map(tuple, sents)))
            in_harmful.update(held)
            for key in {_key(s) for s in sents}:
                verdicts.setdefault(key, np.zeros(len(TAGS)))[TAGS.index(category)] += 1
    share = np.bincount([t for t, _ in doubtful], minlength=len(TAGS)) + 1.0
    harmless = [list(s) for s in sorted(clean, key=lambda s: xxhash.xxh64_intdigest(" ".join(s), 5))[:max_harmless]]
    built = _builtin()

    def odds(part: str | tuple[str, str]) -> float:
        """How much more often harmful documents hold a word or a pair than harmless ones: 0 (no more) to 1 (twenty times)."""
        ratio = (in_harmful[part] + 0.5) / (len(doubtful) + 1) / ((in_clean[part] + 0.5) / (n_clean + 1))
        return float(np.clip(np.log(ratio) / np.log(20), 0, 1))

    novelty = lambda s: float(np.mean([odds(p) for p in zip(["", *s], [*s, ""])]))
    labelled: list[tuple[list[str], int]] = []
    model = Crf(np.zeros((1, 4)), np.zeros((4, 4)))
    for round_ in range(4):
        data = [*built, *[(s, 0) for s in harmless], *labelled]
        known: dict[int, set[str]] = {}
        for s, tag in data:
            if tag:
                for wd in s:
                    if wd.isalpha() and len(wd) > 3 and odds(wd) > 0.4:
                        known.setdefault(len(wd), set()).add(wd)
        model.known = {k: sorted(v) for k, v in known.items()}
        vocab: dict[str, int] = {"": 0}
        code_of: dict[str, int] = {}  # of raw forms; never 0, which is padding
        codes = lambda s: np.array([code_of.get(t) or code_of.setdefault(t, vocab.setdefault(model.form(t), len(vocab))) for t in s])
        chains, tags = [], []
        order = rng.permutation(len(data))
        k = 0
        while k < len(order):  # sentences are joined at random, as texts without punctuation do
            take = 1 if rng.random() < 0.7 else 2
            part = [data[i] for i in order[k : k + take] if data[i][0]]
            k += take
            if part:
                chain, tag = np.concatenate([codes(s) for s, _ in part]), np.concatenate([np.full(len(s), g) for s, g in part])
                chains += np.split(chain, range(TRAIN_WORDS, len(chain), TRAIN_WORDS))
                tags += np.split(tag, range(TRAIN_WORDS, len(tag), TRAIN_WORDS))
        words, stems = _hashes(list(vocab))
        words[0] = stems[0] = 0
        model.weights, model.moves = _train(chains, tags, words, stems, epochs if round_ == 3 or not doubtful else max(4, epochs // 2))
        if round_ == 3 or not doubtful:
            break
        labelled = []
        scores = iter(_scores(model, [s for _, sents in doubtful for s in sents]))
        for tag, sents in doubtful:
            marg = [next(scores) for _ in sents]
            own = [float(m[:, tag].mean()) for m in marg]
            if round_ == 0:
                own = [x + 0.5 * novelty(s) for x, s in zip(own, sents)]
            # a sentence of several documents is of the category that its documents share more than others do
            fits = [v.sum() < 3 or v[tag] / share[tag] >= 0.9 * (v / share).max() for v in (verdicts[_key(s)] for s in sents)]
            own = [x if f else 0.0 for x, f in zip(own, fits)]
            own = [0.0 if clean[tuple(s)] > harmful[tuple(s)] else x for x, s in zip(own, sents)]
            best = max(own, default=0.0)
            for s, x, m, f in zip(sents, own, marg, fits):
                other = int(m.mean(axis=0).argmax())
                if x == best and x > 0.35 or x >= max(0.5, 0.8 * best):
                    labelled.append((s, tag))  # the likeliest sentence of a harmful document is harmful, and others that are about as likely
                elif clean[tuple(s)] > harmful[tuple(s)] or f and x < 0.05 and other in (0, tag):
                    labelled.append((s, 0))
                elif round_ and other not in (0, tag) and float(m[:, other].mean()) > 0.8:
                    labelled.append((s, other))  # a second category, which a single verdict cannot say
        if round_:
            # how sure the field must be: less where far more harmful documents hold the sentence, never where several harmless ones do
            need = lambda s: 0.2 if harmful[s] >= 3 * clean[s] else 0.03 if clean[s] == 1 and not harmful[s] else 0.0
            harmless = [s for s, m in zip(harmless, _scores(model, harmless)) if m[:, 0].mean() >= need(tuple(s))]
    return model


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of chains, of like length together, at most ``CELLS`` words with padding (or a single chain)."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        take = 1
        while at + take < len(order) and (take + 1) * sizes[order[at + take]] <= CELLS and take < 4096:
            take += 1
        yield order[at : at + take]
        at += take


def _marginals(model: Crf, sentences: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of sentences, their lengths, marginals (longest, sentences, tags)) for groups of like length."""
    vocab: dict[str, int] = {"": 0}
    raw = {t: vocab.setdefault(model.form(t), len(vocab)) for t in dict.fromkeys(t for s in sentences for t in s)}
    words, stems = _hashes(list(vocab))
    words[0] = stems[0] = 0
    sizes = np.array([len(s) for s in sentences], dtype=np.int64)
    flat = np.array([raw[t] for s in sentences for t in s], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    for pick in _groups(sizes):
        size = sizes[pick]
        longest = int(size.max(initial=0))
        if not longest:
            yield pick, size, np.zeros((0, len(pick), len(TAGS)), np.float32)
            continue
        place = np.arange(longest)[:, None]
        on = place < size
        x = np.where(on, flat[np.where(on, first[pick] + place, 0)], 0)
        yield pick, size, _forward_backward(_potentials(model.weights, words[x], stems[x]), size, model.moves)[2]


def _scores(model: Crf, sentences: list[list[str]]) -> list[np.ndarray]:
    """Marginals (words, tags) of each sentence."""
    out: list = [None] * len(sentences)
    for pick, size, marg in _marginals(model, sentences):
        for j, i in enumerate(pick):
            out[i] = marg[: size[j], j]
    return out


def _tag(model: Crf, texts: list[str]) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """Score of each tag in each folded sentence (at most one half without a span), and the spans of those that have some."""
    best = np.zeros((len(texts), len(TAGS)))
    hits: dict[int, list[tuple[int, int, int]]] = {}
    for pick, size, marg in _marginals(model, [words_of(t) for t in texts]):
        if not len(marg):
            continue
        on = (np.arange(len(marg))[:, None] < size)[..., None]
        marg = np.where(on, marg, 0)
        best[pick] = np.minimum(marg.sum(axis=0) / np.maximum(size, 1)[:, None], 0.5)
        for j in np.flatnonzero(marg[:, :, 1:].max(axis=(0, 2)) > 0.5):
            i = int(pick[j])
            for a, b, tag, mean in _spans(tokens(texts[i]), marg[: size[j], j]):
                best[i, tag] = max(best[i, tag], mean)
                hits.setdefault(i, []).append((a, b, tag))
    return best, hits


def _potentials(weights: np.ndarray, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
    fid = _features(word, stem)
    e = weights[fid[..., 0]]
    for k in range(1, FEATURES):
        e += weights[fid[..., k]]
    return e


def _spans(sentence: list[tuple[int, int, str]], marg: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Runs of words whose tag is more likely than not: (start, end, tag, mean marginal). A single word needs to be certain."""
    out = []
    for tag in range(1, len(TAGS)):
        on = marg[:, tag] > 0.5
        if not on.any():
            continue
        edges = np.flatnonzero(np.diff(np.r_[0, on.astype(np.int8), 0]))
        for a, b in edges.reshape(-1, 2):
            mean = float(marg[a:b, tag].mean())
            if b - a > 1 or mean > 0.9:
                out.append((sentence[a][0], sentence[b - 1][1], tag, mean))
    return out


def score(documents: DataFrame, id_column: str, text_column: str, source_column: str, model: Crf) -> DataFrame:
    """One row for each document and category: ``doc_id``, ``source``, ``category``, ``score`` (0 to 1), ``spans`` (offsets in the text).

    Null texts score 0, empty texts too; repeated rows repeat; texts of any length are tagged whole, a sentence a chain.
    Where the rows are, no shuffle. Other columns are not read.
    """
    schema = "doc_id long, source string, category string, score double, spans array<struct<start:int,stop:int>>"
    out_schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("category", pa.string()), ("score", pa.float64()),
                            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts, places = [], []
            for t in texts:
                low, place = plain(t) if t else ("", None)
                parts.append(_sentences(low))
                places.append((place, len(t or "")))
            once = {s: i for i, s in enumerate(dict.fromkeys(s for p in parts for _, s in p))}  # equal sentences of a batch are tagged once
            top, hits = _tag(model, list(once))
            ids, cats, scores, spans = [], [], [], []
            for d, p in enumerate(parts):
                best, found = np.zeros(len(TAGS)), {g: [] for g in range(1, len(TAGS))}
                place, size = places[d]
                own = [once[s] for _, s in p]
                if own:
                    best = top[own].max(axis=0)
                for (begin, _), i in zip(p, own):
                    for a, b, tag in hits.get(i, ()):
                        a, b = a + begin, b + begin
                        found[tag].append({"start": place[a] if place else a, "stop": (place[b] if b < len(place) else size) if place else b})
                for tag in range(1, len(TAGS)):
                    ids.append(d)
                    cats.append(TAGS[tag])
                    scores.append(round(float(best[tag]), 6))
                    spans.append(found[tag])
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("source").take(at), pa.array(cats, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, out_schema.field("spans").type)], schema=out_schema
            )

    return rows.mapInArrow(run, schema)


def source_rates(scored: DataFrame, threshold: float = 0.6) -> DataFrame:
    """For each source and category: documents, flagged documents, rate. A null source is a group of its own."""
    flag = (F.col("score") >= threshold) & (F.size("spans") > 0)
    agg = scored.groupBy("source", "category").agg(F.count(F.lit(1)).alias("documents"), F.count_if(flag).alias("flagged"))
    return agg.withColumn("rate", F.col("flagged") / F.col("documents"))
