"""Text normalisation and scalar text features (JVM expressions where Spark has them, one Arrow UDF where it has not)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_text(text: str | None) -> str | None:
    """NFKC, then runs of Unicode white space become one blank; case is kept. None stays None."""
    if text is None:
        return None
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


@F.pandas_udf(T.StringType())
def normalize_for_qc(texts: pd.Series) -> pd.Series:
    """Arrow form of ``normalize_text``; Spark has no built-in NFKC, and Java's white space misses U+001C to U+001F."""
    return texts.map(normalize_text, na_action="ignore")


def token_count(normalized: Column) -> Column:
    """Blanks-separated tokens; an empty text counts one, null gives null."""
    return F.when(normalized.isNotNull(), F.size(F.split(normalized, " ", -1))).cast("int")


def not_blank(text: Column) -> Column:
    """True if anything but Unicode white space is there; null is blank."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")) > 0, F.lit(False))


#: (name, first, last) of the answer-length bands.
BANDS = (("1-2", None, 2), ("3-5", 3, 5), ("6-20", 6, 20), ("21+", 21, None))


def length_band(words: Column) -> Column:
    """Band of a word count; null gives null."""
    out = F.when(words.isNull(), F.lit(None).cast("string"))
    for name, _, last in BANDS[:-1]:
        out = out.when(words <= last, name)
    return out.otherwise(BANDS[-1][0])


def strict_map(column: Column, mapping: dict[str, object], what: str = "value") -> Column:
    """Value of a dictionary; an unmapped key raises, null stays null."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    known = column.isin(list(mapping))
    return F.when(column.isNull(), F.lit(None)).when(known, table[column]).otherwise(F.raise_error(F.concat(F.lit(f"unmapped {what}: "), column.cast("string"))))


def conjunctive_filter(df: DataFrame, isin: dict[str, list], equal: dict[str, object], not_blank_columns: list[str]) -> DataFrame:
    """Rows whose keys are listed, whose fields equal and whose texts are not blank; nulls fail. Pushed to the scan where Spark can."""
    for c, values in isin.items():
        df = df.filter(F.col(c).isin(values))
    for c, value in equal.items():
        df = df.filter(F.col(c) == value)
    for c in not_blank_columns:
        df = df.filter(not_blank(F.col(c)))
    return df
