"""Personal details inside free text, found and replaced by typed placeholders.

Method: anchor expansion. One Aho-Corasick pass over the folded text (look-alikes undone, lower case, no accents; every
character keeps its place) finds anchors: at-signs and their spellings, link schemes, cues of identity numbers, phones,
addresses and names, given names. Deterministic local parsers then grow each anchor to its boundaries and validate it:

* An e-mail needs a local part (64 characters at most, as the mail standard has it) and a dotted domain.
* A number of seven digits or more needs the shape of its kind, or a cue that ends at most ``CUE_REACH`` characters before it, and no cue of a ticket,
  protocol, batch or room there. Check digits add evidence (a bare eleven-digit number with right ones is an identity number, a
  card number must pass the Luhn test) but are not demanded: mistyped numbers are personal details too.
* An address needs a street word and a number.
* A name needs a known given name; an initial or a title and a capitalised word; a capitalised word before a known surname or before a
  comma and a given name; or a name cue and capitalised words. Capitals count only where a neighbouring word has none.
  It grows over surnames: known ones, capitalised ones, and those learned from the corpus (``learn_surnames``), which also
  complete names in texts without capitals.

Overlaps are settled in the order e-mail, address, identity number, phone, name, so that names inside e-mails and streets are none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscope.llm.lookalike import normalize, suspect
from pairscope.session import cut_lineage

KINDS = ("email", "address", "id_number", "phone", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# Given names common in Portuguese, folded.
GIVEN_PT = (
    "abilio adriana airton alberto alessandra alexandre aline alvaro amanda ana anderson andre andreia angela antonia antonio aparecida arnaldo "
    "augusto barbara beatriz benedita benedito bernardo bianca bruna bruno caio camila carla carlos carolina cassio cecilia celia celina celso cesar cibele "
    "clarice claudia claudio cristiane cristina daniel daniela davi debora denise diego dulce edson eduardo elaine eliane elisa emilia erica ester eunice fabiana "
    "fabio felipe fernanda fernando filomena flavia flavio francisca francisco gabriel gabriela geraldo gilberto giovana graca guilherme gustavo heitor helena "
    "heloisa henrique hugo icaro igor ines iolanda irene isabel isabela ivete jaqueline janaina jandira joana joao joaquim jorge jose josefa juarez julia juliana "
    "julio karina larissa laura lazaro leandro leonardo leticia lorena lourdes luana lucas lucia luciana luis luiz luiza luzia marcelo marcia marcos mariana "
    "marina mario marta mateus mauricio mirela monica murilo nair natalia neusa noemia norberto osvaldo otavio patricia paula paulo pedro pericles priscila "
    "rafael raquel raimundo regina renata renato ricardo rita roberta roberto rodrigo rogerio romulo rosana rosangela rubens sandra sebastiao sergio "
    "severino silvana silvia simone solange sonia tadeu tatiana telma thiago valdir vanessa vera vicente vinicius vitor viviane wagner wanda wellington"
).split()
# Rarer given names of Brazil, folded.
GIVEN_BR = (
    "acucena adalberto ademir afonso agnaldo altair amelia anselmo ariane aroldo ayrton berenice bento celeste cleber cleide conceicao dalva damiao deise dirceu djalma edilson edna "
    "elias eliseu elza evandro ezequiel genivaldo gerson gilmar gilson gisele glauco hamilton haroldo helio hilda ilda iracema isaura ivan ivone izabel jair jefferson jonas josiane "
    "jurandir jussara kleber laercio lais leda lidia ligia lineu luisa magali marilda marlene mauro maicon mirian moacir moises nadia nelson nilton odete olga olivia orlando pamela "
    "quiteria reginaldo reinaldo rosa rosemeire rute samuel selma silas sueli suzana taina tainara tania teodoro teresa tereza tiago ubirajara ubiratan valdemar valeria valmir vilma "
    "walter washington wesley william wilson yara zelia zenaide zilda zuleica"
).split()
# Given names common in English.
GIVEN_EN = (
    "james john robert michael david richard joseph thomas charles christopher matthew anthony donald steven paul andrew joshua kenneth kevin brian george timothy ronald edward "
    "jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin gregory alexander patrick raymond jerry dennis peter harold "
    "douglas henry carl arthur roger keith jeremy terry albert mary jennifer linda elizabeth susan jessica sarah karen lisa nancy betty margaret ashley "
    "kimberly emily donna michelle carol dorothy melissa deborah stephanie rebecca sharon cynthia kathleen amy shirley anna brenda emma nicole helen samantha "
    "katherine christine rachel carolyn janet catherine maria heather diane ruth julie joyce virginia victoria kelly lauren christina joan evelyn judith megan cheryl "
    "hannah martha jacqueline frances kathryn sara janice jean madison doris abigail judy grace amber marilyn beverly danielle theresa sophia diana natalie charlotte"
).split()
GIVEN = {*GIVEN_PT, *GIVEN_BR, *GIVEN_EN}
# Given names that are also ordinary words or places; they need a capital that counts, a cue or a surname.
AMBIGUOUS = set(
    "graca caio dulce vera rita aparecida laura marta regina lourdes alice clarice rosa olivia bento celeste conceicao gloria dalva orlando washington lais wesley "
    "austin amber virginia madison grace jean carol scott charlotte victoria heather kelly brandon terry frances jordan".split()
)
# Common surnames in Portuguese and in English, folded; they extend a name that has begun, follow a title or a capitalised word.
SURNAME_PT = (
    "aguiar almeida alves amaral amorim andrade araujo barbosa barreto barros batista bezerra borges brito caldas camargo campos cardoso carneiro carvalho castro cavalcante "
    "coelho cordeiro correia costa couto cruz cunha dias domingues duarte esteves farias fernandes ferraz ferreira figueiredo fonseca franco freitas galvao garcia godoy gomes "
    "goncalves guimaraes leite lima lopes macedo machado magalhaes maia marinho marques martins matos medeiros mello melo mendes menezes mesquita miranda monteiro moraes morais "
    "moreira mota moura muniz nascimento nogueira novaes nunes oliveira pacheco paiva peixoto pereira pimentel pinto pires prado queiroz ramos reis rezende ribeiro rocha rodrigues "
    "sales sampaio santana santos silva silveira siqueira soares souza tavares teixeira toledo torres vargas vasconcelos viana vieira xavier"
).split()
SURNAME_EN = (
    "smith johnson williams brown jones miller davis wilson anderson taylor moore jackson martin lee thompson harris clark lewis robinson walker allen wright adams nelson baker "
    "campbell mitchell carter roberts evans turner parker collins edwards stewart morris murphy cook rogers morgan cooper peterson reed bailey kelly howard ward cox richardson watson "
    "brooks bennett gray hughes price myers foster sanders ross powell sullivan russell ortiz jenkins perry butler barnes fisher henderson coleman simmons patterson jordan reynolds"
).split()
SURNAMES = {*SURNAME_PT, *SURNAME_EN}
# What stands directly before a person's name, or begins a signature.
NAME_CUES = (
    "colega ", "colleague ", "problema com ", "problem with ", "conflito com ", "conflict with ", "falem com ", "fale com ", "falar com ", "falei com ", "talk to ", "talked to ", "speak to ",
    "speak with ", "spoke to ", "spoke with ", "ask for ", "procurem ", "procurar ", "obrigado a ", "obrigada a ", "agradeco a ", "thanks to ", "thank ", "assinado:", "assinado ", "ass.:",
    "signed:", "signed ", "chefe:", "boss:", "responsavel:", "nome:", "name:", "me chamo ", "meu nome e ", "my name is ", "i am called ", "eu sou ", "chama-se ",
)
# Titles; a capitalised word after one is a name, and a surname in any spelling.
TITLES = ("sr. ", "sra. ", "srta. ", "dona ", "senhor ", "senhora ", "dr. ", "dra. ", "doutor ", "doutora ", "prof. ", "profa. ", "seu ", "mr. ", "mrs. ", "ms. ", "miss ")
# Capitalised words that are no name.
NO_NAME = set(
    "segunda terca quarta quinta sexta sabado domingo monday tuesday wednesday thursday friday saturday sunday janeiro fevereiro marco abril maio junho julho agosto setembro "
    "outubro novembro dezembro january february march april may june july august september october november december natal christmas deus god jesus senhor lord brasil brazil "
    "recursos humanos human resources diretoria gerencia gestao financeiro comercial compras producao logistica juridico manutencao qualidade engenharia administracao seguranca "
    "saude management department maintenance quality finance legal security sales logistics board team equipe empresa company portugues ingles espanhol portuguese english spanish "
    "nao no not que quem the this that uma um eu ele ela you they we he she it nosso nossa meu minha our my todos all everyone whoever nobody ninguem "
    "depois antes agora hoje ontem then now today also mas but and para for com with por in on at as os se if when quando".split()
)
# Words before a proper name that is no person's.
NO_PERSON = set(
    "projeto project espaco space instituto institute escola school hospital sala room predio building praca square programa program programme campanha campaign rua avenida av travessa "
    "estrada unidade unit bairro vila parque park jardim setor edificio auditorio sistema system banco bank loja store cidade city sao santo santa porto clinica clinic fazenda igreja church".split()
)

CUE_REACH = 22
ID_CUES = ("cpf", "rg", "pis", "nis", "cnh", "ctps", "passaporte", "passport", "social security", "documento", "document", "identidade", "cadastro", "titulo de eleitor", "ssn")
PHONE_CUES = (
    "telefone", "fone", "phone", "celular", "cel", "cell", "whats", "whatsapp", "zap", "call", "liguem", "ligue", "ligar", "retornem", "retorne", "atende em", "answers",
    "plantao:", "on call:", "on-call:", "contato:", "contact:", "tel", "mobile",
)
OTHER_CUES = ("chamado", "ticket", "protocolo", "protocol", "lote", "lot", "pedido n", "processo", "nota fiscal", "invoice", "sala", "room", "versao", "version", "r$", "us$", "nr-")
STREET_CUES = (
    "rua ", "r. ", "avenida ", "av. ", "av ", "travessa ", "tv. ", "estrada ", "rodovia ", "rod. ", "alameda ", "praca ", "quadra ", "largo ",
    " street", " avenue", " road", " lane", " drive", " boulevard", " court", " terrace", " st.", " ave", " ave.", " rd.", " blvd", " ln.", " dr.",
)
# English words that no street name before " street" and the like holds.
NO_STREET = set("the a an of on in to for at by from with down up across along this that our my your their his her its every each is are was were people hours minutes days years percent times more per and or".split())
MAIL_CUES = ("@", "(at)", "[at]", "(arroba)", "[arroba]", " arroba ", " at ")

_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_BARE = "aaaaaaeeeeiiiiooooouuuucnyyaaaaaaeeeeiiiiooooouuuucny"
FOLD = {**{ord(a): ord(b) for a, b in zip(_ACCENTED, _BARE)}, **{c: c + 32 for c in range(65, 91)}, **dict.fromkeys(map(ord, "\t\r"), 32)}

_LOCAL = re.compile(r"[a-z0-9._%+-]*[a-z0-9]\s?$")
_DOMAIN = re.compile(r"\s?(?:[a-z0-9-]+)(?:(?:\.|\s?[(\[](?:dot|ponto)[)\]]\s?|\s(?:dot|ponto)\s)[a-z0-9-]+)*(?:\.|\s?[(\[](?:dot|ponto)[)\]]\s?|\s(?:dot|ponto)\s)[a-z]{2,}")
_NUMBER = re.compile(r"(?<![\w$])[+(]?\d(?:(?:\) ?| ?\(|[ .-])?\d){6,}(?!\w)")
_ID_STRONG = re.compile(r"\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2}\.\d{3}\.\d{3}-[\dx]|\d{3}\.\d{5}\.\d{2}-\d")
_ID_WEAK = re.compile(r"\d{11}|\d{9}-\d{2}|\d{3} \d{3} \d{3} \d{2}|\d{8,9}-?[\dx]|\d{3}[. ]?\d{3}[. ]?\d{3}[- ]?\d{2}")
_PHONE_STRONG = re.compile(
    r"\+\d{1,3} ?\(?\d{2}\)? ?\d? ?\d{4,5}[ -]?\d{4}|\+1 \d{3}-\d{4}|\+\d{1,3} \d{3}-\d{3}-\d{4}|\(\d{2,3}\) ?9? ?\d{4,5}[ -]?\d{4}|\d{2} 9 \d{4}-\d{4}"
    r"|0\d{2} \d{4,5} \d{4}|\d{2}\.\d{4,5}\.\d{4}|\d{2} \d{4,5}-\d{4}|[1-9]\d9\d{8}"
)
_PHONE_WEAK = re.compile(r"\d{10,11}|\d{4,5}-\d{4}|\d{3}-\d{3,4}-?\d{0,4}|\d{2,3} \d{4,5} \d{4}|\d{4} \d{4}|9\d{8}")
_RAMAL = re.compile(r",?\s(?:ramal|ext\.?|extension)\s\d{1,5}")
_STREET = re.compile(
    r"(?:(?!km\b|numero\b)[a-z][a-z'-]*\.?\s+){0,5}(?!km\b|numero\b)[a-z][a-z'-]*(?:\s*,\s*|\s+)(?:(?:numero|num\.?|no\.?|nº|n\.|km)\s*)?\d{1,5}\b(?!\s?(?:h|horas|%|minutos|pessoas)\b)"
)
_STREET_EN_REST = re.compile(r"(?:\s(?:nw|ne|sw|se|north|south|east|west)\b)?(?:,?\s(?:apt\.?|apartment|suite|unit|floor|house)\s?\d{1,5}[a-z]?)?")
_STREET_REST = re.compile(r"(?:,?\s*(?:casa|ap\.?|apto\.?|bloco|apartment|apt\.?|house)\s*\d{1,5})?(?:(?:\s-\s|,\s)(?:jardim|vila|parque|setor|nucleo|chacara|conjunto|bairro|centro)(?:\s[a-z]+){0,3}?(?=\s(?:em|in|ate|to)\b|[,.;!?/\n-]|\s[-/]|$))?(?:,?\s*cep\s*\d{5}-?\d{3})?")
_LOT = re.compile(r"\d{1,4}\s*,?\s*lote\s*\d{1,4}")
_CARD = re.compile(r"[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5}")
_HOUSE = re.compile(r"\d{1,5}[a-z]?")
_STREET_WORD = re.compile(r"[a-z][a-z'-]*\.?")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W\d_][\w'’-]*\.?")


@dataclass(frozen=True)
class Names:
    """Folded word lists of names: given names, surnames, cues, titles, and surnames learned from a corpus."""

    given: frozenset[str] = frozenset(GIVEN)
    surnames: frozenset[str] = frozenset(SURNAMES)
    cues: tuple[str, ...] = NAME_CUES
    titles: tuple[str, ...] = TITLES
    learned: frozenset[str] = frozenset()


NAMES = Names()


@lru_cache(4)
def _automaton(names: Names):
    auto = ahocorasick.Automaton()
    groups = (("mail", MAIL_CUES), ("street", STREET_CUES), ("id", ID_CUES), ("phone", PHONE_CUES), ("other", OTHER_CUES), ("cue", names.cues), ("title", names.titles), ("given", names.given))
    entries: dict[str, list] = {}
    for kind, words in groups:
        for w in words:
            entries.setdefault(w, []).append((kind, len(w)))
    for w, e in entries.items():
        auto.add_word(w, e)
    auto.make_automaton()
    return auto


_FOLD_BYTES = bytes(FOLD.get(i, i) if FOLD.get(i, i) < 256 else i for i in range(256))


def fold(text: str) -> str:
    """Lower case without accents, character for character; what Latin-1 lacks becomes a question mark."""
    return text.encode("latin-1", "replace").translate(_FOLD_BYTES).decode("latin-1")


def _letter(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isalnum()


def detect(text: str | None, names: Names = NAMES, also: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the text's details, in order, without overlap. None and empty text have none.

    ``also``: learned surnames that hold for this text alone.
    """
    if not text:
        return []
    raw, places = normalize(text, offsets=True) if suspect(text) else (text, None)
    low = fold(raw)
    found: dict[str, list[int]] = {}
    ends: dict[str, list[int]] = {}
    for end, entry in _automaton(names).iter(low):
        for kind, size in entry:
            start = end - size + 1
            first, last = low[start], low[end]
            if (first.isalnum() and _letter(low, start - 1)) or (last.isalnum() and kind not in ("mail",) and _letter(low, end + 1)):
                continue
            found.setdefault(kind, []).append(start)
            ends.setdefault(kind, []).append(end + 1)
    digits = len(_DIGIT.findall(low))
    spans: list[tuple[int, int, str]] = []
    if "mail" in found:
        spans += _emails(low, found["mail"], ends["mail"])
    if "street" in found and digits:
        spans += _addresses(low, found["street"], ends["street"], spans)
    if digits >= 7:
        spans += _numbers(low, found, ends, spans)
    if not found.keys().isdisjoint(("given", "cue", "title")) or _INITIAL.search(raw) or _PAIR.search(raw):
        spans += _names(raw, low, found, ends, spans, names, also)
    spans.sort()
    if places is not None:
        spans = [(places[a], places[b] if b < len(places) else len(text), k) for a, b, k in spans]
    return spans


def _free(spans, a: int, b: int) -> bool:
    return all(b <= x or a >= y for x, y, _ in spans)


def _emails(low, starts, ends):
    out: list[tuple[int, int, str]] = []
    for a, b in zip(starts, ends):
        left = _LOCAL.search(low, max(0, a - 64), a)
        right = _DOMAIN.match(low, b)
        if not left or not right:
            continue
        if low[a:b] == " at " and not re.search(r"\s(?:dot|ponto)\s|[(\[](?:dot|ponto)", right.group()):
            continue
        if low[a:b] == "@" and left.group()[-1:] == " " and right.group()[:1] != " ":
            continue  # a handle
        start, end = left.start(), right.end()
        while low[start] in ".+-":
            start += 1
        if _free(out, start, end):
            out.append((start, end, "email"))
    return out


def _before_street(low: str, end: int) -> int | None:
    """Where the house number begins that, with one to six words of a name, stands before a street word at ``end``."""
    right = end
    for n in range(7):
        left = low.rfind(" ", 0, right) + 1
        word = low[left:right]
        if n and _HOUSE.fullmatch(word):
            return left
        if not _STREET_WORD.fullmatch(word) or word in NO_STREET or not left:
            return None
        right = left - 1
    return None


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _cpf(digits: str) -> bool:
    """Right check digits of an eleven-digit number, not all digits equal."""
    check = lambda k: sum(int(d) * (k - i) for i, d in enumerate(digits[: k - 1])) * 10 % 11 % 10
    return len(digits) == 11 and len(set(digits)) > 1 and check(10) == int(digits[9]) and check(11) == int(digits[10])


def _addresses(low, starts, ends, taken):
    out: list[tuple[int, int, str]] = []
    for a, b in zip(starts, ends):
        cue = low[a:b]
        if cue[0] == " ":
            start = _before_street(low, a)
            span = (start, _STREET_EN_REST.match(low, b).end()) if start is not None else None
        else:
            m = _LOT.match(low, b) if cue == "quadra " else _STREET.match(low, b)
            span = (a, _STREET_REST.match(low, m.end()).end()) if m else None
        if span and _free(out, *span) and _free(taken, *span):
            out.append((*span, "address"))
    return out


def _numbers(low, found, ends, taken):
    out: list[tuple[int, int, str]] = []
    cues = sorted((e, k) for k in ("id", "phone", "other") for e in ends.get(k, ()))
    for m in _NUMBER.finditer(low):
        a, b = m.span()
        if low[a] == "(" and ")" not in m.group():
            a += 1
        body = low[a:b].strip()
        if not _free(taken, a, b):
            continue
        last = bisect_right(cues, (a, "~")) - 1
        near = cues[last][1] if last >= 0 and cues[last][0] >= a - CUE_REACH else ""
        if re.match(r"\s?\((?:cpf|rg|pis)\)", low[b : b + 7]):
            near = "id"
        kind = ""
        if near == "other":
            continue
        if _ID_STRONG.fullmatch(body):
            kind = "id_number"
        elif near == "id" and _ID_WEAK.fullmatch(body):
            kind = "id_number"
        elif _CARD.fullmatch(body) and _luhn(re.sub(r"\D", "", body)):
            kind = "id_number"
        elif near != "phone" and body.isdigit() and _cpf(body):
            kind = "id_number"
        elif _PHONE_STRONG.fullmatch(body):
            kind = "phone"
        elif near == "phone" and (_PHONE_WEAK.fullmatch(body) or 8 <= sum(c.isdigit() for c in body) <= 13):
            kind = "phone"
        if kind:
            end = b
            if kind == "phone" and (r := _RAMAL.match(low, b)):
                end = r.end()
            out.append((a, end, kind))
    return out


_INITIAL = re.compile(r"(?<![\w.])[^\W\d_]\.\s?(?:[^\W\d_]\.\s?)*(?:d[aeo]s?\s)?[^\W\d_]{3}")
_PAIR = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ'’-]+\s+[A-ZÀ-Þ][a-zà-ÿ]")
_PARTICLES = ("de", "da", "do", "dos", "das", "del", "van", "von")


class _Words:
    """The words of one text and what their spelling says."""

    def __init__(self, raw: str, low: str, lists: Names, also: frozenset[str]):
        self.raw, self.low, self.lists, self.also = raw, low, lists, also
        self.spans = [m.span() for m in _TOKEN.finditer(low)]
        self.words = [low[a:b].rstrip(".") for a, b in self.spans]

    def capital(self, i: int) -> bool:
        """A capital first and small letters after it."""
        a, b = self.spans[i]
        return self.raw[a].isupper() and not self.raw[a:b].isupper()

    def loud(self, i: int) -> bool:
        a, b = self.spans[i]
        return self.raw[a:b].isupper()

    def counts(self, i: int, j: int) -> bool:
        """Whether capitals of words i to j say anything: a word of three letters or more within three words begins small."""
        near = [*range(max(0, i - 3), i), *range(j + 1, min(len(self.words), j + 4))]
        return any(len(self.words[k]) > 2 and self.raw[self.spans[k][0]].islower() for k in near)

    def proper(self, i: int) -> bool:
        return self.capital(i) and len(self.words[i]) >= 3 and self.words[i] not in NO_PERSON and self.words[i] not in NO_NAME

    def surname(self, i: int) -> bool:
        w = self.words[i]
        return w in self.lists.surnames or w in self.lists.learned or w in self.also

    def gap(self, i: int) -> str:
        """What stands between word i and the next; a line end if there is none."""
        return self.low[self.spans[i][1] : self.spans[i + 1][0]] if i + 1 < len(self.words) else "\n"

    def initial(self, i: int) -> bool:
        a, b = self.spans[i]
        return b - a == 2 and self.low[b - 1] == "." and (a < 1 or not self.low[a - 1].isalnum())

    def begins_sentence(self, i: int) -> bool:
        before = self.low[: self.spans[i][0]].rstrip(" \"'“”«»([") if i else ""
        return not before or before[-1] in ".!?\n:;-•*"

    def grow(self, i: int, more: Callable[[int], bool]) -> int:
        """Last word of the name that begins at word i."""
        while self.gap(i) in (" ", "  ") and self.low[self.spans[i][1] - 1] != ".":
            if more(i + 1):
                i += 1
            elif self.words[i + 1] in _PARTICLES and self.gap(i + 1) == " " and more(i + 2):
                i += 2
            else:
                break
        return i


def _surname_after(w: _Words, i: int, cued: bool) -> Callable[[int], bool]:
    """Test of the words after a name at word i: a surname, or a word spelled as the name is (with a capital, in capitals) where that counts or a cue stands before."""
    styled = cued or w.counts(i, i)
    if w.loud(i):
        return lambda k: w.surname(k) or styled and w.loud(k) and len(w.words[k]) >= 3 and w.words[k] not in NO_NAME
    return lambda k: w.surname(k) or styled and w.capital(i) and w.proper(k)


def _names(raw, low, found, ends, taken, lists, also):
    out: list[tuple[int, int, str]] = []
    w = _Words(raw, low, lists, also)
    at = {a: i for i, (a, _) in enumerate(w.spans)}
    title_ends = set(ends.get("title", ()))
    cue_ends = title_ends | set(ends.get("cue", ()))

    def add(i: int, j: int) -> None:
        a, b = w.spans[i][0], w.spans[j][1]
        while low[b - 1] in ".'’-":
            b -= 1
        if i and w.gap(i - 1) == " " and low[w.spans[i - 1][1] - 1] != "." and (w.words[i - 1] in NO_PERSON or i > 1 and w.words[i - 2] in NO_PERSON and w.words[i - 1] in _PARTICLES):
            return
        if _free(taken, a, b) and _free(out, a, b):
            out.append((a, b, "name"))

    def first_of(i: int) -> int:
        """First word of a name whose given name or surname is word i: initials before it belong to it."""
        k = i
        while k and (w.initial(k - 1) and w.gap(k - 1) in ("", " ") or w.words[k - 1] in _PARTICLES and k > 1 and w.initial(k - 2)):
            k -= 1
        return k

    # an initial (or several, with or without a particle) and a word spelled like a name
    for i in range(len(w.words) - 1):
        if not w.initial(i) or not _free(out, *w.spans[i]):
            continue
        j = i + 1
        while j < len(w.words) and (w.initial(j) or w.words[j] in _PARTICLES) and w.gap(j - 1) in ("", " "):
            j += 1
        if j == len(w.words) or w.gap(j - 1) not in ("", " ") or len(w.words[j]) < 3 or w.words[j] in NO_NAME or w.words[j] in NO_PERSON:
            continue
        a, b = w.spans[j]
        style = raw[w.spans[i][0]].isupper() and raw[a].isupper()
        cued = any(w.spans[i][0] in (e, e + 1) for e in cue_ends)
        if w.surname(j) or style and (w.capital(j) or w.loud(j)) or cued:
            add(i, w.grow(j, _surname_after(w, j, cued)))
    for s in sorted(set(found.get("given", ()))):
        i = at.get(s)
        if i is None or not _free(out, s, s + 1):
            continue
        cued = s in cue_ends or s - 1 in cue_ends
        j = w.grow(i, _surname_after(w, i, cued))
        first = i
        if i and low[w.spans[i - 1][1] : s] in (", ", ",") and (w.surname(i - 1) or w.proper(i - 1)) and len(w.words[i - 1]) > 3 and not (i > 1 and w.gap(i - 2) == " " and w.capital(i - 2) and not w.begins_sentence(i - 2)):
            if w.surname(i - 1) or w.begins_sentence(i - 1) and j == i or w.counts(i - 1, j):
                first, j = i - 1, i  # surname, given name
        elif i and w.gap(i - 1) in (" ", "") and w.initial(i - 1):
            first = first_of(i)
        if first == i and j == i and w.words[i] in AMBIGUOUS:
            if not cued and not (w.capital(i) and w.counts(i, i) and not w.begins_sentence(i)):
                continue
        add(first, j)
    # a cue or a title and capitalised words: names that no list knows
    for e in sorted(cue_ends):
        i = at.get(e + (low[e : e + 1] == " "))
        if i is None or not _free(out, *w.spans[i]):
            continue
        more = lambda k: w.surname(k) or w.proper(k)
        title = e in title_ends
        if w.proper(i) and (title and raw[e - 2].islower() or w.counts(i, w.grow(i, more)) or low[e - 1] == ":"):
            add(i, w.grow(i, more))
        elif title and w.surname(i):
            add(i, w.grow(i, w.surname))
    # a capitalised word before a known surname, inside a sentence
    for i in range(len(w.words) - 1):
        if w.words[i + 1] in lists.surnames and w.gap(i) == " " and w.proper(i) and w.capital(i + 1) and w.counts(i, i + 1) and not w.begins_sentence(i) and not w.surname(i):
            add(i, w.grow(i + 1, _surname_after(w, i + 1, False)))
    return out


_PLACE = re.compile(rf"\b(?:{'|'.join(sorted(NO_PERSON))})(?:\s+(?:{'|'.join(_PARTICLES)}))?\s+(?=[a-z])")
_CAPITALS = re.compile(r"[A-ZÀ-Þ][\w'’-]*(?:\s+[A-ZÀ-Þ][\w'’-]*)*")


def proper_names(text: str) -> list[tuple[int, int]]:
    """Spans of names of projects and places: a word such as project or square and the capitalised words after it, itself capitalised."""
    out = []
    for m in _PLACE.finditer(fold(text)):
        if text[m.start()].isupper() and not text[m.start() : m.end()].isupper() and (rest := _CAPITALS.match(text, m.end())):
            out.append((m.start(), rest.end()))
    return out


def redact(text: str | None, names: Names = NAMES) -> str | None:
    """The text with every detail replaced by ``[KIND]``; everything else unchanged."""
    if text is None:
        return None
    out, last = [], 0
    for a, b, kind in detect(text, names):
        out += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join([*out, text[last:]])


_REDACTED = T.StructType([T.StructField("redacted", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def _redacted(texts: pd.Series, known: pd.Series | None, names: Names) -> pd.DataFrame:
    done = []
    for k, t in enumerate(texts):
        if not isinstance(t, str):
            done.append((None, []))
            continue
        more = None if known is None else known.iloc[k]
        out, last, spans = [], 0, detect(t, names, frozenset(more) if more is not None else frozenset())
        for a, b, kind in spans:
            out += [t[last:a], PLACEHOLDER[kind]]
            last = b
        done.append(("".join([*out, t[last:]]) if spans else t, sorted(k for _, _, k in spans)))
    return pd.DataFrame(done, columns=["redacted", "kinds"])


def _redact_udf(names: Names, with_known: bool):
    def joined(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
        return _redacted(texts, known, names)

    def alone(texts: pd.Series) -> pd.DataFrame:
        return _redacted(texts, None, names)

    return F.pandas_udf(joined, _REDACTED) if with_known else F.pandas_udf(alone, _REDACTED)


#: JVM test of what every detail needs: a digit, an at-sign or its spellings, or letters enough for a name. Texts without any letter or digit are none.
_ANCHOR = r"[\p{L}\p{N}@]"


def _values(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    return df.select(F.col(id_column), F.explode(pairs).alias("_v")).select(id_column, "_v.field", "_v.text")


def _name_words(text: str, names: Names) -> tuple[set[str], set[str]]:
    """(words that stand like a surname here, words that stand in small letters elsewhere)."""
    if suspect(text):
        text = normalize(text)
    w = _Words(text, fold(text), names, frozenset())
    surnames, plain = set(), set()
    for i, word in enumerate(w.words):
        back = i - 1 if i and w.words[i - 1] not in _PARTICLES else i - 2
        after_name = back >= 0 and w.gap(i - 1) in (" ", "") and (w.words[back] in names.given or w.initial(back))
        before_name = i + 1 < len(w.words) and w.gap(i) == ", " and w.words[i + 1] in names.given
        if after_name or before_name:
            if w.proper(i) and len(word) > 3:
                surnames.add(word)
        elif text[w.spans[i][0]].islower():
            plain.add(word)
    return surnames, plain


def learn_surnames(df: DataFrame, fields: list[str], names: Names = NAMES, min_values: int = 2) -> DataFrame:
    """``word``, ``n_values`` of every surname that the corpus itself shows, over all values.

    A surname stands capitalised after a given name or an initial, or before a comma and a given name, in ``min_values`` values or more, and
    in small letters elsewhere in none (of texts of which it is no such part). One Arrow pass emits each batch's distinct words with
    their counts, so the shuffle is of the size of the vocabulary; null and empty texts show nothing.
    """
    rows = df.select(F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("text")).filter(F.col("text").isNotNull())
    schema = pa.schema([("word", pa.string()), ("n_values", pa.int64()), ("n_plain", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes: Counter[str] = Counter()
            no: Counter[str] = Counter()
            for text, times in Counter(batch.column("text").to_pylist()).items():
                a, b = _name_words(text, names)
                for w in a:
                    yes[w] += times
                for w in b:
                    no[w] += times
            words = list({**yes, **no})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([yes[x] for x in words], pa.int64()), pa.array([no[x] for x in words], pa.int64())], schema=schema)

    counted = rows.mapInArrow(run, "word string, n_values long, n_plain long").groupBy("word").agg(F.sum("n_values").alias("n_values"), F.sum("n_plain").alias("n_plain"))
    return counted.filter((F.col("n_values") >= min_values) & (F.col("n_plain") == 0)).select("word", "n_values")


def _with_details(values: DataFrame, names: Names, learned: DataFrame | None, max_broadcast: int) -> DataFrame:
    """``values`` with a struct ``_r`` of redacted text and kinds."""
    if learned is not None:
        learned = cut_lineage(learned.select("word"))
        if learned.count() <= max_broadcast:
            names = replace(names, learned=frozenset(r.word for r in learned.collect()))
        else:
            numbered = cut_lineage(values.withColumn("_n", F.monotonically_increasing_id()))  # the numbers must not change between the two uses
            words = numbered.select("_n", F.explode(F.array_distinct(F.split(_folded(F.col("text")), r"[^a-z0-9'-]+"))).alias("word"))
            known = words.join(learned, "word", "left_semi").groupBy("_n").agg(F.collect_set("word").alias("_known"))  # words of one value
            return numbered.join(known, "_n", "left").withColumn("_r", _redact_udf(names, True)("text", "_known"))
    return values.withColumn("_r", _redact_udf(names, False)("text"))


def redact_fields(df: DataFrame, id_column: str, fields: list[str], names: Names = NAMES, learned: DataFrame | None = None, max_broadcast: int = 200_000) -> DataFrame:
    """``id``, ``field``, ``redacted`` and ``kinds`` (one entry a detail) of every value.

    One Arrow pass where the rows are, no shuffle, whole texts. Null texts stay null with no kinds, empty texts stay empty,
    repeated rows stay repeated; other columns are not read, so their names cannot clash.

    ``learned`` (from ``learn_surnames``) completes names. Up to ``max_broadcast`` words it travels with the task; beyond that the words of
    each value are joined to it, and every value brings its own.
    """
    return _with_details(_values(df, id_column, fields), names, learned, max_broadcast).select(id_column, "field", "_r.redacted", "_r.kinds")


def _folded(text: Column) -> Column:
    return F.translate(F.lower(text), _ACCENTED[: len(_ACCENTED) // 2], _BARE[: len(_BARE) // 2])


def found_kinds(df: DataFrame, id_column: str, fields: list[str], names: Names = NAMES, learned: DataFrame | None = None, max_broadcast: int = 200_000) -> DataFrame:
    """Distinct (id, field, kind) for every kind of detail that a value holds. Values without letter or digit never leave the JVM."""
    rows = _values(df, id_column, fields).filter(F.col("text").rlike(_ANCHOR))
    return _with_details(rows, names, learned, max_broadcast).select(id_column, "field", F.explode("_r.kinds").alias("kind")).distinct()
