"""Records that differ in nothing but formatting, collapsed into one record each with a count of copies.

Method: canonicalise characters, case, white space, punctuation and field order; hash to 128 bits;
count with map-side combining; check for collisions with a second hash.

* Characters: texts with look-alike or invisible characters pass the transducer of ``lookalike`` first.
* Case, white space, punctuation: every run of white space, controls and formatting signs becomes one blank. Formatting signs are Unicode's punctuation and
  the separators, bullets and rules of ``SEPARATORS``. What changes a meaning stays: letters, marks, digits, emoji, currency and
  mathematical signs, ``SIGNS`` (%, #, &, @ ...), a minus directly before a number, and the point or comma inside one.
* Field order: a text whose parts (split at ``;``, ``|``, slashes, bullets, line ends) all read ``label: value`` or
  ``label = value`` is a set of fields; its parts are sorted.

Canonical form and hashes are made in one Arrow pass over the scan (in the JVM the same rules cost seven times
as much, as Catalyst repeats the expression for each use). Only a 128-bit hash, a 64-bit check and the id are
shuffled, never a text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairscope.llm.lookalike import normalize, suspect
from pairscope.session import cut_lineage

_SEPARATORS = re.compile(r"\s*(?:;|\||//|\s/\s|[\r\n]+|•|·)\s*")
_FIELD = re.compile(r"^[\W_]*[^\W\d_][\w \t]{0,28}?[ \t]*[:=]\s*\S")
# Punctuation that is part of what is said, and symbols that only set text apart.
SIGNS = "%‰#&@"
SEPARATORS = "|=^`~<>¦¨¯´¸˜˝←→⇒➔➜➤►▶◄■□▪▫●○◦◆◇★☆✓✔✗✘─━│┃"


class _Blanks(dict):
    """Formatting signs to blanks, everything else as it is, filled as characters come; what depends on its neighbours is left to ``_EDGES``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kept = unicodedata.category(c)[0] not in "PZC" or c in SIGNS + ".,-\u200d" or 0xD800 <= code < 0xE000
        self[code] = got = c if kept and c not in SEPARATORS + "\ufe0f" else " "
        return got


_BLANKS = _Blanks()
_BLANK_BYTES = bytes(ord(_BLANKS[i]) for i in range(256))
# headings, points and commas outside numbers, dashes that are no sign of a number
_EDGES = re.compile(r"(?<!\S)#+(?=\s)|[.,](?!\d)|(?<!\d)[.,]|-(?!\d)|(?<=\S)-")


def _words(text: str) -> str:
    text = text.lower()
    try:  # by bytes where Latin-1 has every character
        text = text.encode("latin-1").translate(_BLANK_BYTES).decode("latin-1")
    except UnicodeEncodeError:
        text = text.translate(_BLANKS)
    return " ".join(_EDGES.sub(" ", text).split())


def canonical_text(text: str) -> str:
    """Canonical form. A text of nothing but formatting keeps its own characters."""
    if suspect(text):
        text = unicodedata.normalize("NFC", normalize(text))
    if ":" in text or "=" in text:  # only texts with a label sign are split at all
        parts = [x for x in _SEPARATORS.split(text) if x.strip()]
        if len(parts) > 1 and all(map(_FIELD.match, parts)):
            return "\x1f".join(sorted(map(_words, parts)))
    return _words(text) or text.strip()


@F.pandas_udf(T.StructType([T.StructField("h", T.BinaryType()), T.StructField("x", T.LongType())]))
def _hashes(texts: pd.Series) -> pd.DataFrame:
    forms = [canonical_text(t).encode("utf-8", "surrogatepass") for t in texts]
    return pd.DataFrame({"h": [xxhash.xxh3_128_digest(f) for f in forms], "x": [xxhash.xxh64_intdigest(f, 7) - (1 << 63) for f in forms]})


def _hashed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, 128-bit hash and 64-bit check of every non-null text, in one pass."""
    rows = df.select(F.col(id_column).cast("string").alias("_id"), F.col(text_column).cast("string").alias("_t")).filter(F.col("_t").isNotNull())
    return rows.select("_id", _hashes("_t").alias("_k")).select("_id", F.col("_k.h").alias("_h"), F.col("_k.x").alias("_x"))


def copy_groups(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row for each distinct record: ``kept_id`` (smallest id), ``n_copies``, ``collides``.

    Rows with null text are no record. A null id counts as a copy but is kept only if no other id is there.
    Repeated rows count as copies. Texts whose 128-bit hashes agree but whose checks differ stay apart;
    ``collides`` tells of such a hash. Counting combines on the map side, so a record that fills a third of the rows
    sends one row per input split. An empty table gives an empty result.
    """
    per = _hashed(df, id_column, text_column).groupBy("_h", "_x").agg(F.min("_id").alias("kept_id"), F.count(F.lit(1)).alias("n_copies"))
    by_hash = per.groupBy("_h").agg(F.collect_list(F.struct("_x", "kept_id", "n_copies")).alias("_g"))  # one entry but for a collision
    out = by_hash.select("_h", F.explode("_g").alias("_r"), (F.size("_g") > 1).alias("collides"))
    return out.select("_h", "_r._x", "_r.kept_id", "_r.n_copies", "collides")


def copies(df: DataFrame, id_column: str, text_column: str, hot_share: float = 0.0005) -> DataFrame:
    """``kept_id`` and ``id`` of every row that is not the kept one of its record.

    Records holding at least ``hot_share`` of all rows are at most ``1 / hot_share`` many, whatever the input;
    their hashes are broadcast, so that their members are never gathered. All other records are joined on the hash,
    where no key holds more than that share.
    """
    total = max(df.count(), 1)
    rows = cut_lineage(_hashed(df, id_column, text_column))  # texts are read and hashed once; what is kept is an id and 24 bytes
    groups = rows.groupBy("_h", "_x").agg(F.min("_id").alias("kept_id"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    hot_rows = max(int(total * hot_share), 1000)
    keys = ["_h", "_x"]
    hot = rows.join(F.broadcast(groups.filter(F.col("n_copies") >= hot_rows)), keys)
    rest = rows.join(groups.filter(F.col("n_copies") < hot_rows).hint("shuffle_hash"), keys)
    both = hot.unionByName(rest).filter(F.col("_id").isNotNull() & (F.col("_id") != F.col("kept_id")))
    return both.select("kept_id", F.col("_id").alias("id"))
