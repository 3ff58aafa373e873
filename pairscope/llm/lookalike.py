"""One consistent form for text that looks the same but differs in its characters.

Method: a compiled longest-match transducer over grapheme clusters. ``compile_rules`` builds the
mapping from rules (Unicode compatibility forms for widths, styles and joined letters, canonical
composition for detached accents, two fixed tables for look-alike scripts), checks that it has no
conflict and that its outputs are stable, and compiles it to one scanner that takes the longest
cluster at each place: a whole word with a look-alike letter, a letter with its marks, joiners, a single character.
``normalize`` then rewrites a text in one pass, in time linear in its length.

What is left alone: ordinary letters with their usual accents, tabs and line ends, quote and dash
styles, ordinal signs, emoji with their joiners and selectors, and words truly written in another
script (they hold a letter of that script that resembles no Latin one).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters of Cyrillic and Greek and the Latin letters they resemble.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k",
    "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ϲ": "c", "ϳ": "j",
}
# Signs whose compatibility form is not the sign meant, or which are only another style of quote or dash.
KEPT = "ªº…‥′″‴´¨¸¯˜‘’‚‛“”„‟‹›«»‐‑‒–—―−﹘﹣·•™℠©®²³¹½¼¾№‼⁇⁈⁉₨‗‾"

#: Any of these characters makes a text a candidate; the class is written for Java.
#: Latin-1 letters, common quotes and dashes and emoji alone do not. The class is a superset of what the rules change.
SUSPECT = (
    r"[\x{00A0}\x{00AD}\x{0132}\x{0133}\x{013F}\x{0140}\x{0149}\x{017F}\x{01C4}-\x{01CC}\x{01F1}-\x{01F3}\x{0250}-\x{02FF}\x{0300}-\x{036F}\x{0370}-\x{052F}"
    r"\x{0600}-\x{0605}\x{061C}\x{115F}\x{1160}\x{1680}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{1AB0}-\x{1AFF}\x{1D00}-\x{1DFF}\x{2000}-\x{200F}\x{2024}"
    r"\x{2028}-\x{202F}\x{205F}-\x{2070}\x{2071}-\x{209C}\x{20D0}-\x{20DC}\x{2100}-\x{218B}\x{2460}-\x{24FF}\x{2C60}-\x{2C7F}\x{3000}\x{3164}"
    r"\x{3200}-\x{33FF}\x{A720}-\x{A7FF}\x{FB00}-\x{FB06}\x{FE00}-\x{FE0F}\x{FE20}-\x{FE2F}\x{FEFF}\x{FF00}-\x{FFEF}\x{FFF9}-\x{FFFB}"
    r"\x{10780}-\x{107BA}\x{1D400}-\x{1D7FF}\x{1F100}-\x{1F189}\x{E0000}-\x{E0FFF}]"
)

_MARKS = "\u0300-\u034e\u0350-\u036f"
JOINERS = "\u200d\ufe0e\ufe0f"
_EMOJI = re.compile(r"[\u00a9\u00ae\u203c-\u3299\ufe0f\u20e3\U0001f000-\U0001faff\U000e0020-\U000e007f]")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")


def _keep(ch: str) -> bool:
    return ch in KEPT or unicodedata.category(ch) == "Pd" and ch not in "\ufe63\uff0d"


def _width_and_style(ch: str) -> str | None:
    """Compatibility form of one character if it is another width or style of letters, digits, signs or a space."""
    if _keep(ch) or ord(ch) < 0xA0:
        return None
    if unicodedata.category(ch) == "Zs":
        return " "
    form = unicodedata.normalize("NFKC", ch)
    if form == ch or form[:1] == " " or ord(form[0]) > 0x2FF and form[0] not in GREEK:
        return None
    return "".join(GREEK.get(c, c) for c in form)


def _invisible(ch: str) -> bool:
    if 0x600 <= ord(ch) <= 0x8FF and ch != "\u061c":  # number signs of Arabic script, which are seen
        return False
    return unicodedata.category(ch) == "Cf" or ch in "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0" or 0xFE00 <= ord(ch) <= 0xFE0E or 0xE0100 <= ord(ch) <= 0xE01EF


@lru_cache(1)
def compile_rules() -> dict[str, str]:
    """Character -> replacement, checked: no character is in two rule sets with different results,
    and no replacement holds a character that some rule would change again."""
    ranges = [(0xA0, 0x2FF), (0x1680, 0x1681), (0x1D00, 0x1DFF), (0x2000, 0x24FF), (0x2C60, 0x2C7F), (0x3000, 0x3001), (0x3200, 0x33FF), (0xA720, 0xA7FF),
              (0xFB00, 0xFB07), (0xFF00, 0xFFF0), (0x1D400, 0x1D800), (0x1F100, 0x1F18A)]
    table: dict[str, str] = {}
    for low, high in ranges:
        for code in range(low, high):
            if (to := _width_and_style(chr(code))) is not None:
                table[chr(code)] = to
    for code in [*range(0xA0, 0x3200), *range(0xFE00, 0xFE10), 0xFEFF, 0x3164, 0xFFA0, *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE0200)]:
        if _invisible(chr(code)):
            if table.get(chr(code)):
                raise ValueError(f"U+{code:04X} has two rules")
            table[chr(code)] = ""
    for letters in (CYRILLIC, GREEK):
        for a, b in letters.items():
            if table.get(a, b) != b:
                raise ValueError(f"{a!r} has two rules")
    everything = {**table, **CYRILLIC, **GREEK}
    for a, b in everything.items():
        if any(c in everything for c in b):
            raise ValueError(f"the result of {a!r} would change again")
    return table


def _ranges(chars) -> str:
    """A character class body of ranges."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in out)


@dataclass(frozen=True)
class _Machine:
    """Compiled scanner: where a rule may apply, and how far a run of letters, a glued accent and joiners reach from there."""

    hot: re.Pattern  # any character some rule takes
    run: re.Pattern  # letters and what sticks to them
    alike: re.Pattern
    tail: re.Pattern  # marks on a letter, with whatever invisible stands between
    glue: frozenset[str]


@lru_cache(1)
def _machine() -> _Machine:
    table = compile_rules()
    silent = _ranges(c for c, to in table.items() if to == "" and c not in JOINERS)
    alike = _ranges([*CYRILLIC, *GREEK])
    letter = r"[^\W\d_]"
    glue = rf"[{_MARKS}{silent}\u200d]"
    marks = [chr(c) for c in range(0x300, 0x370) if c != 0x34F]
    return _Machine(
        re.compile(rf"[{_ranges(table)}{_MARKS}{alike}\u200d\ufe0e\ufe0f]"), re.compile(rf"(?:{letter}|{glue})+"), re.compile(f"[{alike}]"), re.compile(rf"{glue}*[{_MARKS}]"),
        frozenset([*marks, *(c for c, to in table.items() if to == "" and c not in JOINERS), "\u200d"]),
    )


_MARK_RUN = re.compile(f"[{_MARKS}]+")
_JOINER_RUN = re.compile(f"[{JOINERS}]+")


def _is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _clusters(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of every cluster that a rule takes, left to right, the longest that begins there.

    Kinds: ``word`` (a whole run of letters with a look-alike among them), ``cluster`` (a letter with its marks), ``mark`` (marks on
    nothing), ``joiner``, ``one``. Each run of letters is measured once, so the time is linear in the text whatever it holds.
    """
    m = _machine()
    at, run_end, run_alike = 0, -1, False
    while hit := m.hot.search(text, at):
        i = hit.start()
        c = text[i]
        if i >= run_end and (c in m.glue or _is_letter(c)):
            run_end = m.run.match(text, i).end()
            run_alike = m.alike.search(text, i, run_end) is not None
            if run_alike:
                start = i
                while start > at and (_is_letter(text[start - 1]) or text[start - 1] in m.glue):
                    start -= 1
                at = run_end
                yield start, run_end, "word"
                continue
        start = i
        while start > at and text[start] in m.glue:
            start -= 1
        tail = m.tail.match(text, start + 1) if _is_letter(text[start]) else None
        if tail and tail.end() > i:
            at = tail.end()
            yield start, at, "cluster"
        elif group := _MARK_RUN.match(text, i):
            at = group.end()
            yield i, at, "mark"
        elif group := _JOINER_RUN.match(text, i):
            at = group.end()
            yield i, at, "joiner"
        else:
            at = i + 1
            yield i, at, "one"


def _word(text: str, table: dict[str, str]) -> str:
    """A run of letters with at least one look-alike letter."""
    plain = "".join(table.get(c, c) for c in text if c != "\u200d")
    own = unicodedata.normalize("NFC", "".join(CYRILLIC.get(c, GREEK.get(c, c)) for c in plain))
    # a letter of another script that resembles none of ours, and no letter of ours: a word truly written in that script
    if any(_FOREIGN.match(c) for c in own) and not any(_LATIN.match(c) for c in plain):
        return unicodedata.normalize("NFC", plain)
    return own


def normalize(text: str | None, offsets: bool = False):
    """The consistent form of a text; with ``offsets`` also, for each character of it, the place in ``text`` it came from.

    None gives None, the empty text itself. A text without a suspect character comes back unchanged.
    """
    if text is None:
        return (None, None) if offsets else None
    table = compile_rules()
    parts: list[str] = []
    places: list[int] = []
    last = 0

    def put(piece: str, at: int, size: int) -> None:
        parts.append(piece)
        if offsets:  # a rewritten cluster spreads its characters over the places it took
            step = size / max(len(piece), 1)
            places.extend(range(at, at + size) if size == len(piece) else (at + min(int(i * step), size - 1) for i in range(len(piece))))

    for at, stop, kind in _clusters(text):
        hit = text[at:stop]
        if kind == "one":
            new = table.get(hit, hit)
        elif kind == "word":
            new = _word(hit, table)
        elif kind == "cluster":
            new = unicodedata.normalize("NFC", "".join(table.get(c, c) for c in hit if c != "\u200d"))
        elif kind == "mark":
            new = ""  # an accent on nothing
        else:
            before, after = _EMOJI.match(text[max(at - 1, 0) : at]), _EMOJI.match(text[stop : stop + 1])
            new = hit if before and (after or "\u200d" not in hit) or after and text[stop] == "\u20e3" else ""
        if new == hit:
            continue
        if last < at:
            put(text[last:at], last, at - last)
        put(new, at, len(hit))
        last = stop
    if last < len(text):
        put(text[last:], last, len(text) - last)
    out = "".join(parts)
    return (out, places) if offsets else out


_suspect_py = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), SUSPECT))


def suspect(text: str) -> bool:
    """Whether a text has any character that a rule may change."""
    return not text.isascii() and _suspect_py.search(text) is not None


@F.pandas_udf(T.StringType())
def _normalize_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: normalize(t) if isinstance(t, str) else None)


def suspect_column(text: Column) -> Column:
    """JVM test for a suspect character."""
    return text.rlike(SUSPECT)


def consistent_text(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """Consistent form of every value: ``id_column``, ``field``, ``text``, ``consistent``, ``changed``.

    A text without a suspect character never leaves the JVM; the others pass the transducer once, in Arrow batches,
    where they are, without a shuffle. Null texts give null with ``changed`` false, empty texts stay empty,
    texts of any length are treated whole, repeated rows stay repeated. Other columns are not read.
    """
    spark_rows = df.select(
        F.col(id_column).alias(id_column),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("_v"),
    ).select(id_column, "_v.field", "_v.text")
    marked = spark_rows.withColumn("_s", F.coalesce(suspect_column(F.col("text")), F.lit(False)))
    fixed = _split_apply(marked)
    return fixed.withColumn("changed", F.coalesce(F.col("text") != F.col("consistent"), F.lit(False)))


def _split_apply(marked: DataFrame) -> DataFrame:
    # one Arrow pass in which clean values travel as nulls, so that the scan is read once
    out = marked.withColumn("_f", _normalize_udf(F.when(F.col("_s"), F.col("text"))))
    return out.withColumn("consistent", F.when(F.col("_s"), F.col("_f")).otherwise(F.col("text"))).drop("_f", "_s")


def changed_values(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """Distinct (id, field) whose value the transducer changes. Only suspect values reach Python."""
    rows = df.select(
        F.col(id_column), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("_v")
    ).select(id_column, "_v.field", "_v.text")
    suspects = rows.filter(suspect_column(F.col("text")))
    hits = suspects.filter(F.col("text") != _normalize_udf(F.col("text")))
    return hits.select(id_column, "field").distinct()
