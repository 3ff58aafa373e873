"""Language of documents and of their segments, with confidence.

Method: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time. It labels
every position; clauses pool the positions of their words, the document pools its clauses.

Training text: clauses of a bounded hash sample of the rows (``sample_rows``), labelled by counts of function words where these
are clear whatever the column says, and a small public text and everyday sentences in all four languages, so that a language that is rare
or absent in the sample is still known. A clause without clear function words takes the language of its company: that of the labelled
clauses of the values it occurs in (or, where there are none, that of another detector's verdict on the value), if it occurs
``MIN_COMPANY`` times and nearly all agree. Clauses are joined at random, so the
network sees changes of language inside a text, and loan words are sown into clauses of the other languages, where they change nothing.
The fitted weights (about 100 KB) travel with the task; all rows are labelled, whole, where they are, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.llm.lookalike import normalize, suspect
from pairscope.llm.personal import detect, proper_names

LANGS = ("pt", "en", "es", "fr")

# Frequent function words of each language; those that two lists share say nothing and are dropped below.
WORDS = {
    "pt": "o os a as uma um não nao do da dos das de em na nas no nos ao com é são sao mais muito minha meu pelo pela quem que ter já isso foi tem está nós você gente à às seu sua "
    "num numa mas até ou só sem se quando nem também seria desde para por e me la le",
    "en": "the of and to is are in for with on it that this be not we they have has was my our from an by at a as do no me would should more every when who nobody whoever their because i there so or if",
    "es": "el los las una un del y con es muy pero lo al mi hay más mas nadie nuestra nuestro ya quien que sin desde hasta cuando gente está según sus su esto bueno sería podrían en la no de por para "
    "se día año a me le o",
    "fr": "le les des du une un est et dans avec pour mon nous vous je ils elle qui que pas ne sur au aux ce cette sont plus très mais chaque quand depuis en la notre nos leur personne de se il sa son car il y a",
}
WORDS = {k: set(v.split()) for k, v in WORDS.items()}
_SHARED = {w for a in LANGS for w in WORDS[a] if len(w) == 1 and w not in "éà" or sum(w in WORDS[b] for b in LANGS) > 1}
WORDS = {k: w - _SHARED for k, w in WORDS.items()}

# The opening articles of the Universal Declaration of Human Rights, public text of the United Nations in every language.
DECLARATION = {
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. "
    "Todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente Declaração, sem distinção alguma, nomeadamente de raça, de cor, de sexo, de língua, de religião, de opinião política ou outra, de origem nacional ou social, de fortuna, de nascimento ou de qualquer outra situação. "
    "Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura ou em servidão; a escravatura e o trato dos escravos, sob todas as formas, são proibidos. "
    "Ninguém será submetido a tortura nem a penas ou tratamentos cruéis, desumanos ou degradantes. Todos os indivíduos têm direito ao reconhecimento, em todos os lugares, da sua personalidade jurídica. "
    "Todos são iguais perante a lei e, sem distinção, têm direito a igual proteção da lei. Ninguém pode ser arbitrariamente preso, detido ou exilado. "
    "Toda a pessoa tem o direito de livremente circular e escolher a sua residência no interior de um Estado. Toda a pessoa tem o direito de abandonar o país em que se encontra, incluindo o seu, e o direito de regressar ao seu país. "
    "Toda a pessoa tem direito ao trabalho, à livre escolha do trabalho, a condições equitativas e satisfatórias de trabalho e à proteção contra o desemprego. "
    "Todos têm direito, sem discriminação alguma, a salário igual por trabalho igual. Toda a pessoa tem direito ao repouso e aos lazeres, e a férias periódicas pagas. "
    "Toda a pessoa tem direito à educação. A educação deve ser gratuita, pelo menos a correspondente ao ensino elementar fundamental.",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. "
    "Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion, national or social origin, property, birth or other status. "
    "Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms. "
    "No one shall be subjected to torture or to cruel, inhuman or degrading treatment or punishment. Everyone has the right to recognition everywhere as a person before the law. "
    "All are equal before the law and are entitled without any discrimination to equal protection of the law. No one shall be subjected to arbitrary arrest, detention or exile. "
    "Everyone has the right to freedom of movement and residence within the borders of each state. Everyone has the right to leave any country, including his own, and to return to his country. "
    "Everyone has the right to work, to free choice of employment, to just and favourable conditions of work and to protection against unemployment. "
    "Everyone, without any discrimination, has the right to equal pay for equal work. Everyone has the right to rest and leisure, and to periodic holidays with pay. "
    "Everyone has the right to education. Education shall be free, at least in the elementary and fundamental stages.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. "
    "Toda persona tiene los derechos y libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición. "
    "Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la trata de esclavos están prohibidas en todas sus formas. "
    "Nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o degradantes. Todo ser humano tiene derecho, en todas partes, al reconocimiento de su personalidad jurídica. "
    "Todos son iguales ante la ley y tienen, sin distinción, derecho a igual protección de la ley. Nadie podrá ser arbitrariamente detenido, preso ni desterrado. "
    "Toda persona tiene derecho a circular libremente y a elegir su residencia en el territorio de un Estado. Toda persona tiene derecho a salir de cualquier país, incluso del propio, y a regresar a su país. "
    "Toda persona tiene derecho al trabajo, a la libre elección de su trabajo, a condiciones equitativas y satisfactorias de trabajo y a la protección contra el desempleo. "
    "Toda persona tiene derecho, sin discriminación alguna, a igual salario por trabajo igual. Toda persona tiene derecho al descanso, al disfrute del tiempo libre y a vacaciones periódicas pagadas. "
    "Toda persona tiene derecho a la educación. La educación debe ser gratuita, al menos en lo concerniente a la instrucción elemental y fundamental.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. "
    "Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation. "
    "Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude; l'esclavage et la traite des esclaves sont interdits sous toutes leurs formes. "
    "Nul ne sera soumis à la torture, ni à des peines ou traitements cruels, inhumains ou dégradants. Chacun a le droit à la reconnaissance en tous lieux de sa personnalité juridique. "
    "Tous sont égaux devant la loi et ont droit sans distinction à une égale protection de la loi. Nul ne peut être arbitrairement arrêté, détenu ou exilé. "
    "Toute personne a le droit de circuler librement et de choisir sa résidence à l'intérieur d'un État. Toute personne a le droit de quitter tout pays, y compris le sien, et de revenir dans son pays. "
    "Toute personne a droit au travail, au libre choix de son travail, à des conditions équitables et satisfaisantes de travail et à la protection contre le chômage. "
    "Tous ont droit, sans aucune discrimination, à un salaire égal pour un travail égal. Toute personne a droit au repos et aux loisirs, et à des congés payés périodiques. "
    "Toute personne a droit à l'éducation. L'éducation doit être gratuite, au moins en ce qui concerne l'enseignement élémentaire et fondamental.",
}
# Everyday sentences of our own, the same in each language.
EVERYDAY = {
    "pt": "vou para casa porque já é tarde|ela mora perto da estação com os filhos|ontem choveu muito e ficamos em casa|você pode me ajudar a levar estas caixas|não sei onde deixei as minhas chaves|o meu irmão trabalha numa padaria|gosto de café sem açúcar|quando chegar o verão vamos à praia|eles compraram um carro novo no ano passado|hoje não tenho tempo para cozinhar|a porta está aberta mas não há ninguém|precisamos de pão, leite e ovos|o médico disse que eu devia descansar|as crianças brincam no jardim|este livro é mais interessante do que aquele|nunca estive nesse país|estou muito cansado depois da viagem|fale mais devagar por favor|o trem sai às oito da manhã|acho que ele tem razão|nós gostaríamos de saber o preço|faz frio e venta bastante|ela sempre chega cedo e nunca reclama|a comida estava ótima e o serviço também|se puder, ligo para você à noite|o vizinho de cima faz muito barulho",
    "en": "i am going home because it is late|she lives near the station with her children|yesterday it rained a lot and we stayed at home|can you help me carry these boxes|i don't know where i left my keys|my brother works in a bakery|i like coffee without sugar|when summer comes we will go to the beach|they bought a new car last year|today i have no time to cook|the door is open but there is nobody there|we need bread, milk and eggs|the doctor said that i should rest|the children are playing in the garden|this book is more interesting than that one|i have never been to that country|i am very tired after the trip|please speak more slowly|the train leaves at eight in the morning|i think that he is right|we would like to know the price|it's cold and quite windy|she always arrives early and never complains|the food was great and so was the service|if i can, i'll call you tonight|the neighbour's dog doesn't stop barking",
    "es": "me voy a casa porque ya es tarde|ella vive cerca de la estación con sus hijos|ayer llovió mucho y nos quedamos en casa|puedes ayudarme a llevar estas cajas|no sé dónde dejé mis llaves|mi hermano trabaja en una panadería|me gusta el café sin azúcar|cuando llegue el verano iremos a la playa|ellos compraron un coche nuevo el año pasado|hoy no tengo tiempo para cocinar|la puerta está abierta pero no hay nadie|necesitamos pan, leche y huevos|el médico dijo que yo debía descansar|los niños juegan en el jardín|este libro es más interesante que aquel|nunca he estado en ese país|estoy muy cansado después del viaje|hable más despacio por favor|el tren sale a las ocho de la mañana|creo que él tiene razón|nos gustaría saber el precio|hace frío y bastante viento|ella siempre llega temprano y nunca se queja|la comida estaba muy buena y el servicio también|si puedo, te llamo por la noche|el vecino de arriba hace mucho ruido",
    "fr": "je rentre à la maison parce qu'il est tard|elle habite près de la gare avec ses enfants|hier il a beaucoup plu et nous sommes restés chez nous|peux-tu m'aider à porter ces cartons|je ne sais pas où j'ai laissé mes clés|mon frère travaille dans une boulangerie|j'aime le café sans sucre|quand l'été viendra nous irons à la plage|ils ont acheté une voiture neuve l'année dernière|aujourd'hui je n'ai pas le temps de cuisiner|la porte est ouverte mais il n'y a personne|nous avons besoin de pain, de lait et d'œufs|le médecin a dit que je devais me reposer|les enfants jouent dans le jardin|ce livre est plus intéressant que celui-là|je n'ai jamais été dans ce pays|je suis très fatigué après le voyage|parlez plus lentement s'il vous plaît|le train part à huit heures du matin|je crois qu'il a raison|nous voudrions connaître le prix|il fait froid et il y a beaucoup de vent|elle arrive toujours tôt et ne se plaint jamais|le repas était excellent et le service aussi|si je peux, je t'appelle ce soir|le voisin du dessus fait beaucoup de bruit",
}

# English words that other languages use as their own.
LOANS = "feedback|home office|burnout|software|marketing|coaching|online|site|happy hour|layout|deadline|call center|networking|mindset|turnover|compliance|workshop|briefing|upgrade|startup|delivery|design|team building|smartphone|streaming|outdoor|shopping|notebook|stress|link".split("|")
MIN_COMPANY = 4

#: A clause below this confidence is no segment of its own; it follows its neighbours.
FIRM = 0.92

#: A change of language inside a clause needs this much log-probability, whatever the clause's length, and this many words on each side.
CHANGE = 12.0
LEAST_WORDS = 3

_LATIN = {"’": "'", "‘": "'", "ʼ": "'", "′": "'", "œ": "æ", "Œ": "Æ"}
_CLAUSE = re.compile(r"[^.!?;:,\n\r/|()\[\]{}\"“”«»•–—=]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


# Words that every language uses alike, and link schemes.
_NEUTRAL = re.compile(r"\b(?:e-?mails?|mailto|https?|www|whats(?:app)?|cpf|rg|pis|cep|ok|tel)\b", re.IGNORECASE)


def prepare(text: str) -> str:
    """Look-alikes undone, personal details, names of projects and places and words of no language blanked in place, lower case; as long as the consistent form."""
    if suspect(text):
        text = normalize(text)
    chars = None
    blanks = [(a, b) for a, b, _ in detect(text)]
    if not text.islower():
        blanks += proper_names(text)
    blanks += [m.span() for m in _NEUTRAL.finditer(text)]
    for a, b in blanks:
        chars = chars or list(text)
        chars[a:b] = " " * (b - a)
    low = "".join(chars or text)
    folded = low.lower()
    return folded if len(folded) == len(low) else low


@lru_cache(maxsize=4096)
def _latin(char: str) -> str:
    """One Latin-1 character for any other: apostrophes and letters break no clause, signs do."""
    if char <= "\xff" or char in _LATIN:
        return _LATIN.get(char, char)
    if unicodedata.category(char)[0] not in "LM":
        return "?"
    base = unicodedata.normalize("NFKD", char)[0]
    return base if base <= "\xff" else "\x1a"


def _encode(text: str) -> np.ndarray:
    """A byte a character."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = "".join(map(_latin, text)).encode("latin-1")
    return np.frombuffer(raw, dtype=np.uint8)


def weak_label(clause: str) -> int | None:
    """Language of a clause by its function words, if they are clear."""
    words = _WORD.findall(clause)
    if len(words) < 3:
        return None
    votes = np.array([sum(w in WORDS[a] for w in words) for a in LANGS])
    top = votes.argmax()
    rest = np.delete(votes, top).max()
    return int(top) if votes[top] >= 2 and votes[top] >= 3 * rest or votes[top] >= 1 and not rest and len(words) <= 5 else None


@dataclass
class ByteGru:
    """Weights of both directions: input tables (256, 3H), recurrent (H, 3H), candidate bias; output (2H, L), bias."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.out, self.bias]

    def arrays(self) -> dict[str, np.ndarray]:
        return {f"p{i}": p for i, p in enumerate(self.params())}

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> ByteGru:
        p = [arrays[f"p{i}"] for i in range(8)]
        return ByteGru(p[0:2], p[2:4], p[4:6], p[6], p[7])

    def run(self, x: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of bytes (T, B); the second direction reads backwards. Padding is byte 0 and does not change the state."""
        steps, batch = x.shape
        u, b, h_size = self.u[side], self.b[side], self.u[side].shape[0]
        h = np.zeros((batch, h_size), dtype=np.float32)
        hs = np.empty((steps, batch, h_size), dtype=np.float32)
        table = self.w[side]
        if keep is None:
            return self._infer(x, side, hs)
        filled = x > 0
        live = [None if a else filled[i] for i, a in enumerate(filled.all(axis=1))]
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            g = h @ u
            gx = table.take(x[t], axis=0)
            zr = g[:, : 2 * h_size]
            zr += gx[:, : 2 * h_size]
            np.multiply(zr, 0.5, out=zr)
            np.tanh(zr, out=zr)
            np.multiply(zr, 0.5, out=zr)
            zr += 0.5
            a = g[:, 2 * h_size :]
            a += b
            z, r = zr[:, :h_size], zr[:, h_size:]
            n = r * a
            n += gx[:, 2 * h_size :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            on = live[t]
            if on is not None:
                new = np.where(on[:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, a, n, filled[t]))
            h = new
            hs[t] = h
        return hs

    def _infer(self, x: np.ndarray, side: int, hs: np.ndarray) -> np.ndarray:
        """As ``run`` in place, without what training keeps; the halving of the gates' arguments is folded into the weights."""
        steps, batch, size = hs.shape
        u, table, b = self.u[side].copy(), self.w[side].copy(), self.b[side]
        u[:, : 2 * size] *= 0.5
        table[:, : 2 * size] *= 0.5
        filled = x > 0
        whole = filled.all(axis=1)
        h = np.zeros((batch, size), dtype=hs.dtype)
        g, gx = np.empty((batch, 3 * size), dtype=hs.dtype), np.empty((batch, 3 * size), dtype=hs.dtype)
        zr, n = np.empty((batch, 2 * size), dtype=hs.dtype), np.empty((batch, size), dtype=hs.dtype)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            np.matmul(h, u, out=g)
            table.take(x[t], axis=0, out=gx, mode="clip")
            np.add(g[:, : 2 * size], gx[:, : 2 * size], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.add(g[:, 2 * size :], b, out=n)
            n *= zr[:, size:]
            n += gx[:, 2 * size :]
            np.tanh(n, out=n)
            new = hs[t]
            np.subtract(h, n, out=new)
            new *= zr[:, :size]
            new += n
            if not whole[t]:
                np.copyto(new, h, where=~filled[t][:, None])
            h = new
        return hs

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        half = self.u[0].shape[0]
        logits = self.run(x, 0) @ self.out[:half] + self.bias
        logits += self.run(x, 1) @ self.out[half:]
        top = logits[..., 0].copy()
        for k in range(1, logits.shape[2]):
            np.maximum(top, logits[..., k], out=top)
        logits -= top[..., None]
        total = np.exp(logits)
        for k in range(1, logits.shape[2]):
            total[..., 0] += total[..., k]
        logits -= np.log(total[..., :1])
        return logits


def _gradients(net: ByteGru, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of the labelled positions and its gradients, by backpropagation through time."""
    keeps: list[list] = [[], []]
    hs = np.concatenate([net.run(x, s, keeps[s]) for s in (0, 1)], axis=2)
    steps, batch, _ = hs.shape
    logits = hs @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    on = x > 0
    count = max(on.sum(), 1)
    picked = np.take_along_axis(p, y[..., None], axis=2)[..., 0]
    loss = -np.log(np.maximum(picked[on], 1e-9)).mean()
    d = p
    np.put_along_axis(d, y[..., None], picked[..., None] - 1, axis=2)
    d *= (on / count)[..., None]
    d_out = hs.reshape(-1, hs.shape[2]).T @ d.reshape(-1, d.shape[2])
    d_bias = d.sum(axis=(0, 1))
    d_hs = d @ net.out.T
    size = net.u[0].shape[0]
    d_w, d_u, d_b = [], [], []
    flat = x.ravel()
    order = np.argsort(flat, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
    for s in (0, 1):
        u = net.u[s]
        grad_x = np.zeros((steps, batch, 3 * size), dtype=np.float32)
        grad_u = np.zeros_like(u)
        grad_b = np.zeros(size, dtype=np.float32)
        dh = np.zeros((batch, size), dtype=np.float32)
        mine = d_hs[:, :, s * size : (s + 1) * size]
        for t, h, z, r, a, n, on_t in reversed(keeps[s]):
            dh = dh + mine[t]
            out = dh * on_t[:, None]
            dz = out * (h - n) * z * (1 - z)
            dn = out * (1 - z) * (1 - n * n)
            dr = dn * a * r * (1 - r)
            da = dn * r
            g = np.concatenate([dz, dr, da], axis=1)
            grad_u += h.T @ g
            grad_b += da.sum(axis=0)
            grad_x[t, :, : 2 * size] = g[:, : 2 * size]
            grad_x[t, :, 2 * size :] = dn
            dh = dh - out + out * z + g @ u.T
        table = np.zeros((256, 3 * size), dtype=np.float32)
        table[flat[order][heads]] = np.add.reduceat(grad_x.reshape(-1, 3 * size)[order], heads, axis=0)
        d_w.append(table)
        d_u.append(grad_u)
        d_b.append(grad_b)
    return float(loss), [*d_w, *d_u, *d_b, d_out, d_bias]


# How a loan word stands in a phrase of each language.
_LOAN_PHRASES = {"pt": "sem {} e sem {}|o {} vem|falta {}|temos {} e {}|mais {}|o {} é bom", "es": "sin {} y sin {}|el {} llega|falta {}|tenemos {} y {}|más {}|el {} es bueno",
                 "fr": "sans {} et sans {}|le {} arrive|il manque du {}|nous avons {} et {}|plus de {}|le {} est bon"}


def _sow(text: str, lang: str, rng: np.random.Generator) -> str:
    """A clause with a loan word put in, or a phrase made of loan words."""
    loan = lambda: LOANS[int(rng.integers(len(LOANS)))]
    if rng.random() < 0.5:
        phrases = _LOAN_PHRASES[lang].split("|")
        phrase = phrases[int(rng.integers(len(phrases)))]
        return phrase.format(*[loan() for _ in range(phrase.count("{}"))])
    words = text.split(" ")
    words.insert(int(rng.integers(len(words) + 1)), loan())
    return " ".join(words)


def train(clauses: list[list[str]], hidden: int = 32, steps: int = 560, batch: int = 112, length: int = 72, seed: int = 5) -> ByteGru:
    """Fit the network on lists of clauses, one list for each language."""
    rng = np.random.default_rng(seed)
    rnd = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
    net = ByteGru([rnd(256, 3 * hidden) for _ in "ab"], [rnd(hidden, 3 * hidden) for _ in "ab"], [np.zeros(hidden, np.float32) for _ in "ab"], rnd(2 * hidden, len(LANGS)), np.zeros(len(LANGS), np.float32))
    params = net.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    glue = [" ", ". ", ", ", "! ", "; ", " / ", "\n", ": "]
    for step in range(1, steps + 1):
        x = np.zeros((length, batch), dtype=np.uint8)
        y = np.zeros((length, batch), dtype=np.int64)
        for j in range(batch):
            at, lang = 0, int(rng.integers(len(LANGS)))
            while at < length:
                if rng.random() < 0.35:
                    lang = int(rng.integers(len(LANGS)))
                source = clauses[lang]
                text = source[int(rng.integers(len(source)))]
                if LANGS[lang] != "en" and rng.random() < 0.08:
                    text = _sow(text, LANGS[lang], rng)
                if at == 0 and len(text) > 24 and rng.random() < 0.3:
                    text = text[int(rng.integers(len(text) // 2)) :]
                raw = _encode(text + glue[int(rng.integers(len(glue)))])[: length - at]
                x[at : at + len(raw), j] = raw
                y[at : at + len(raw), j] = lang
                at += len(raw)
        _, grads = _gradients(net, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.012 * min(1, step / 20) * (1 - 0.85 * step / steps)
        for p, g, m1, v1 in zip(params, grads, m, v):
            g *= min(1, 1 / max(norm, 1e-9))
            m1 += 0.1 * (g - m1)
            v1 += 0.01 * (g * g - v1)
            p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.99**step)) + 1e-8)
    return net


def builtin_clauses() -> list[list[str]]:
    """Clauses of the public text and the everyday sentences of each language, whole and in pieces of three words or more."""
    out = []
    for lang in LANGS:
        whole = [c for text in (DECLARATION[lang], *EVERYDAY[lang].split("|")) for m in _CLAUSE.finditer(text.lower()) if len(c := m.group().strip()) > 5]
        pieces = []
        for clause in whole:
            words = clause.split(" ")
            pieces += [" ".join(words[i : i + n]) for n in (3, 5, 8) for i in range(0, len(words) - n + 1, 2)]
        out.append([*whole * 4, *pieces])
    return out


def fit(df: DataFrame, id_column: str, fields: dict[str, str], sample_rows: int = 8_000, verdicts: DataFrame | None = None) -> ByteGru:
    """Train on at most ``sample_rows`` rows chosen by the hash of their id, and on the built-in sentences.

    ``verdicts`` may hold, for ids of ``df``, a column for each field with the language that another detector is sure of (null where it is
    not). It is a vote on clauses without clear function words, no more: the detector errs.
    """
    text = [F.col(f).cast("string").alias(f"t{i}") for i, f in enumerate(fields)]
    total = max(df.count(), 1)
    share = int(min(1.0, 1.3 * sample_rows / total) * 1_000_000)
    chosen = lambda d, c: d.filter(F.pmod(F.xxhash64(F.col(c).cast("string"), F.lit(11)), F.lit(1_000_000)) < share)
    rows = chosen(df, id_column).select(F.col(id_column).cast("string").alias("_id"), *text)
    if verdicts is not None:
        said = chosen(verdicts, id_column).groupBy(F.col(id_column).cast("string").alias("_id")).agg(*[F.min(f).alias(f"v{i}") for i, f in enumerate(fields)])
        rows = rows.join(said, "_id", "left")
    sample = rows.limit(sample_rows).toPandas()
    values = [(v, h) for i in range(len(fields)) for v, h in zip(sample[f"t{i}"], sample[f"v{i}"] if verdicts is not None else [None] * len(sample)) if isinstance(v, str)]
    return train(training_clauses(values))


def training_clauses(values: Iterable[tuple[str, str | None]]) -> list[list[str]]:
    """Labelled clauses of each language: built-in ones, those of clear function words, and those known by their company.

    ``values``: texts, each with the language another detector gives it, or None.
    """
    seen: list[Counter[str]] = [Counter() for _ in LANGS]
    company: dict[str, np.ndarray] = {}
    for value, hint in values:
        split = [c for m in _CLAUSE.finditer(prepare(value)) if len(c := m.group().strip()) > 5]
        labels = [weak_label(c) for c in split]
        for clause, label in zip(split, labels):
            if label is not None:
                seen[label][clause] += 1
        langs = {x for x in labels if x is not None}
        if not langs and hint in LANGS:
            langs = {LANGS.index(hint)}
        if len(langs) == 1:
            for clause, label in zip(split, labels):
                if label is None:
                    company.setdefault(clause, np.zeros(len(LANGS)))[next(iter(langs))] += 1
    for clause, votes in company.items():
        if votes.max() >= MIN_COMPANY and votes.max() >= 0.85 * votes.sum():
            seen[int(votes.argmax())][clause] += int(votes.sum())
    # frequent clauses are mostly short and hard to tell; they are drawn up to 15 times as often as one seen once
    return [[*built, *(c for c in sorted(s) for _ in range(min(s[c], 15)))] for built, s in zip(builtin_clauses(), seen)]


def label_texts(net: ByteGru, texts: list[str], batch: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of prepared texts, as arrays (text, start, stop, language, confidence) in the order of the texts."""
    raw = [_encode(t) for t in texts]
    order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
    parts: list[tuple] = []
    at = 0
    while at < len(order):
        group = order[at : at + batch]
        longest = len(raw[group[-1]])
        if longest > 2_000:  # long texts: fewer at once, whole all the same
            group = order[at : at + max(1, batch * 500 // (longest + 1))]
            longest = len(raw[group[-1]])
        at += len(group)
        if not longest:
            continue
        sizes = np.array([len(raw[i]) for i in group])
        x = np.zeros((longest, len(group)), dtype=np.uint8)
        for j, i in enumerate(group):
            x[: sizes[j], j] = raw[i]
        lp = net.log_probs(x).transpose(1, 0, 2)[np.arange(longest) < sizes[:, None]]  # the texts' positions, one after the other
        text, *rest = _segments(np.concatenate([raw[i] for i in group]), sizes, lp)
        parts.append((np.array(group)[text], *rest))
    if not parts:
        return tuple(np.zeros(0, t) for t in (int, int, int, int, float))  # type: ignore[return-value]
    columns = [np.concatenate(c) for c in zip(*parts)]
    back = np.lexsort((columns[1], columns[0]))
    return tuple(c[back] for c in columns)  # type: ignore[return-value]


_LETTERS = np.array([chr(i).isalpha() or chr(i) == "'" for i in range(256)])
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[ord(c) for c in ".!?;:,\n\r/|()[]{}\"«»=\x95\x96\x97"]] = True


def _shares(scores: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Share of each language by the mean log-probability of a letter, for rows of pooled scores."""
    mean = scores / np.maximum(letters, 1)[:, None]
    e = np.exp(mean - mean.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _changes(scores: np.ndarray) -> list[int]:
    """First words of the second and later parts of the best division of words (words, languages) into parts of one language.

    A part has ``LEAST_WORDS`` words or more, a further part costs ``CHANGE``.
    """
    n, m = scores.shape
    upto = np.r_[np.zeros((1, m)), np.cumsum(scores, axis=0, dtype=np.float64)]
    ends = np.full((n + 1, m), -np.inf)  # best of the first i words whose last part has this language
    began = np.zeros((n + 1, m), dtype=np.int64)
    before = np.full(n + 1, -np.inf)  # best of the first i words, with the cost of a further part
    before[0] = 0
    for i in range(LEAST_WORDS, n + 1):
        on = ends[i - 1] + scores[i - 1]
        new = before[i - LEAST_WORDS] + upto[i] - upto[i - LEAST_WORDS]
        ends[i] = np.maximum(on, new)
        began[i] = np.where(on >= new, began[i - 1], i - LEAST_WORDS)
        before[i] = ends[i].max() - CHANGE
    out, i = [], n
    while (i := int(began[i, ends[i].argmax()])) > 0:
        out.append(i)
    return out[::-1]


def _segments(flat: np.ndarray, sizes: np.ndarray, lp: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of the texts whose bytes lie in ``flat`` one after the other.

    Clauses pool their letters; a clause that changes language inside is cut at its best words, any number of times; clauses that are short or doubtful follow
    their neighbours. A text without any firm clause is one segment, a text without letters none.
    """
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    letter = _LETTERS[flat]
    before = np.r_[False, letter[:-1]]
    before[first[sizes > 0]] = False
    word = letter & ~before  # first letters of words
    fresh = _BREAKS[flat]
    fresh[first[sizes > 0]] = True
    lp = lp * letter[:, None]

    def pool(heads: np.ndarray) -> tuple[np.ndarray, ...]:
        where = np.arange(len(flat))
        letters = np.add.reduceat(letter.astype(np.int64), heads)
        there = letters > 0
        return (np.add.reduceat(lp, heads, axis=0)[there], letters[there], np.add.reduceat(word.astype(np.int64), heads)[there],
                np.minimum.reduceat(np.where(letter, where, len(flat)), heads)[there], np.maximum.reduceat(np.where(letter, where, -1), heads)[there] + 1, owner[heads][there])

    heads = np.flatnonzero(fresh)
    scores, letters, words, begin, end, text = pool(heads)
    cuts = []
    # the best words of all languages bound what cuts can gain
    heads_of_words = np.flatnonzero(word)
    gain = np.zeros(len(letters))
    if len(heads_of_words):
        best = np.add.reduceat(lp, heads_of_words, axis=0).max(axis=1)
        upto = np.r_[0, np.cumsum(best, dtype=np.float64)]
        gain = upto[np.searchsorted(heads_of_words, end)] - upto[np.searchsorted(heads_of_words, begin)] - scores.max(axis=1)
    for c in np.flatnonzero((gain > CHANGE) & (words >= 2 * LEAST_WORDS)):
        starts = begin[c] + np.flatnonzero(word[begin[c] : end[c]])
        cuts.extend(starts[_changes(np.add.reduceat(lp[: end[c]], starts, axis=0))])
    if cuts:
        scores, letters, words, begin, end, text = pool(np.unique(np.concatenate([heads, cuts])))
    if not len(text):
        return tuple(np.zeros(0, t) for t in (int, int, int, int, float))
    share = _shares(scores, letters)
    firm = (words >= 3) & (letters >= 10) & (share.max(axis=1) >= FIRM)
    lang = share.argmax(axis=1)
    # texts without a firm clause: all clauses together
    edge = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    loose = ~np.logical_or.reduceat(firm, edge)
    whole = np.flatnonzero(np.repeat(loose, np.diff(np.r_[edge, len(text)])))
    if len(whole):
        own = edge[loose]
        total = _shares(np.add.reduceat(scores, edge, axis=0)[loose], np.add.reduceat(letters, edge)[loose])
        lasts = (np.r_[edge[1:], len(text)] - 1)[loose]
        single = (text[own], begin[own] - first[text[own]], end[lasts] - first[text[own]], total.argmax(axis=1), total.max(axis=1))
    else:
        single = tuple(np.zeros(0, t) for t in (int, int, int, int, float))
    keep = np.flatnonzero(firm)
    if not len(keep):
        return single
    new = np.r_[True, (lang[keep][1:] != lang[keep][:-1]) | (text[keep][1:] != text[keep][:-1])]
    runs = keep[new]  # first clause of each segment
    total = _shares(np.add.reduceat(scores[keep], np.flatnonzero(new), axis=0), np.add.reduceat(letters[keep], np.flatnonzero(new)))
    head = np.r_[True, text[runs][1:] != text[runs][:-1]]
    lead = edge[np.searchsorted(edge, runs, "right") - 1]  # first clause of the text
    last_of = np.r_[edge[1:], len(text)] - 1
    tail = last_of[np.searchsorted(edge, runs, "right") - 1]
    nxt = np.r_[runs[1:] - 1, len(text) - 1]
    stop = end[np.minimum(nxt, tail)]
    start = np.where(head, begin[lead], begin[runs])
    base = first[text[runs]]
    multi = (text[runs], start - base, stop - base, lang[runs], total[np.arange(len(runs)), lang[runs]])
    return tuple(np.concatenate(z) for z in zip(multi, single))


_SCHEMA = "start int, stop int, lang string, confidence double"


def segments(df: DataFrame, id_column: str, fields: dict[str, str], net: ByteGru, min_words: dict[str, str] | None = None, unexpected_at: float | None = None) -> DataFrame:
    """``id``, ``field``, ``segment``, ``start``, ``stop`` (in the consistent form), ``lang``, ``confidence`` of every segment of every value.

    Null texts and texts without letters have no segment. Texts of any length are read whole. Repeated rows repeat their
    segments. Other columns are not read. ``min_words`` may name a word-count column for each field; values of
    eight words or fewer are then left out. With ``unexpected_at`` only segments of that confidence are given, and only of values
    that have one in another than the expected language.
    """
    values = F.array(*[
        F.struct(F.lit(f).alias("field"), F.when(F.col(min_words[f]) > 8, F.col(f)).otherwise(F.lit(None)).cast("string").alias("text") if min_words else F.col(f).cast("string").alias("text"))
        for f in fields
    ])
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.explode(values).alias("_v")).select("id", "_v.field", "_v.text").filter(F.col("text").isNotNull())
    schema = pa.schema([("id", pa.string()), ("field", pa.string()), ("segment", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [prepare(t) for t in batch.column("text").to_pylist()]
            once = {t: i for i, t in enumerate(dict.fromkeys(texts))}  # equal texts of a batch are labelled once
            text, start, stop, lang, sure = label_texts(net, list(once))
            low, high = np.searchsorted(text, np.arange(len(once))), np.searchsorted(text, np.arange(len(once)), "right")
            of = np.array([once[t] for t in texts])
            size = (high - low)[of]
            if unexpected_at is not None:
                sure_enough = sure >= unexpected_at
                right = np.array([LANGS.index(fields[f]) for f in batch.column("field").to_pylist()])
                own = np.repeat(np.arange(len(texts)), size)
                at = np.repeat(low[of] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(own))
                odd = np.bincount(own, weights=sure_enough[at] & (lang[at] != right[own]), minlength=len(texts)) > 0
                size = np.where(odd, size, 0)
            rep = np.repeat(np.arange(len(texts)), size)
            number = np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size)
            pick = low[of][rep] + number
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rep, pa.int64())), batch.column("field").take(pa.array(rep, pa.int64())), pa.array(number, pa.int32()), pa.array(start[pick], pa.int32()),
                 pa.array(stop[pick], pa.int32()), pa.array(np.array(LANGS, dtype=object)[lang[pick]], pa.string()), pa.array(np.round(sure[pick], 4))], schema=schema
            )

    return rows.mapInArrow(run, f"id string, field string, segment int, {_SCHEMA}")


def unexpected(df: DataFrame, id_column: str, fields: dict[str, str], word_counts: dict[str, str], net: ByteGru, min_confidence: float = 0.6) -> DataFrame:
    """Every language of each value that holds a clause in another than the expected language: ``id``, ``field``, ``lang``."""
    # a value's segments are made by one task, which drops values of the expected language alone before anything is shuffled
    seg = segments(df, id_column, fields, net, word_counts, min_confidence).filter(F.col("confidence") >= min_confidence)
    return seg.select("id", "field", "lang").distinct()


def documents(df: DataFrame, id_column: str, fields: dict[str, str], net: ByteGru) -> DataFrame:
    """One row for each id and field: ``lang`` and ``confidence`` of the whole (by its longest language), ``n_langs``.

    Null texts and texts without letters have no row. Rows of one id repeated add up, which changes no share.
    """
    seg = segments(df, id_column, fields, net)
    per = seg.groupBy("id", "field", "lang").agg(F.sum(F.col("stop") - F.col("start")).alias("size"), F.avg("confidence").alias("confidence"))
    return per.groupBy("id", "field").agg(
        F.max_by("lang", F.struct("size", "lang")).alias("lang"), F.max_by("confidence", F.struct("size", "lang")).alias("confidence"), F.count(F.lit(1)).alias("n_langs")
    )
