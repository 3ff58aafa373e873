"""Language verification: detector protocol, built-in stop-word detector, flags."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETECTION = T.StructType([T.StructField("predicted", T.StringType()), T.StructField("expected_confidence", T.DoubleType())])

# Stop words of the built-in detector.
STOP_WORDS = {
    "pt": "a o os as um uma de do da dos das em no na que e para com por mais muito me se como mas foi meu minha".split(),
    "en": "the a an of to in is are and that for with on it this be my our more not as was at by from".split(),
    "es": "el la los las un una de del en que y para con por más muy me se como pero fue mi lo al".split(),
}


class LanguageDetector(Protocol):
    """``detect(text, expected)`` gives the predicted language, None if undecided, and the confidence in the expected one."""

    def detect(self, text: str, expected: str) -> tuple[str | None, float]: ...


def detector_udf(make: Callable[[], LanguageDetector]) -> Callable[[Column, Column], Column]:
    """A detector plug-in as an Arrow UDF; null text is undecided with confidence 0."""
    holder: list[LanguageDetector] = []

    @F.pandas_udf(DETECTION)
    def detect(texts: pd.Series, expected: pd.Series) -> pd.DataFrame:
        if not holder:
            holder.append(make())
        rows = [holder[0].detect(t, e) if isinstance(t, str) else (None, 0.0) for t, e in zip(texts, expected)]
        return pd.DataFrame(rows, columns=["predicted", "expected_confidence"])

    return detect


def stop_word_scores(text: Column) -> dict[str, Column]:
    """Share of each language's stop words among the tokens, as JVM expressions."""
    words = F.split(F.lower(text), r"[^a-zà-ÿ]+")
    among = lambda stops: lambda w: w.isin(stops)
    return {lang: F.size(F.filter(words, among(stops))).cast("double") for lang, stops in STOP_WORDS.items()}


def stop_word_predicted(text: Column, min_distance: float = 0.05) -> Column:
    """Best language, or null if the best two are closer than ``min_distance`` of their sum."""
    scores = stop_word_scores(text)
    ranked = F.sort_array(F.array(*[F.struct(s.alias("s"), F.lit(lang).alias("l")) for lang, s in scores.items()]), asc=False)
    best, second = ranked[0], ranked[1]
    clear = (best["s"] > 0) & ((best["s"] - second["s"]) > min_distance * (best["s"] + second["s"]))
    return F.when(clear, best["l"])


def verification_flags(df: DataFrame, predicted: str, expected: Column | str, prefix: str) -> DataFrame:
    """``{prefix}_matches_expected`` and ``{prefix}_ambiguous``, never null: no prediction is no match and ambiguous."""
    p = F.col(predicted)
    e = F.lit(expected) if isinstance(expected, str) else expected
    return df.withColumn(f"{prefix}_matches_expected", F.coalesce(p == e, F.lit(False))).withColumn(f"{prefix}_ambiguous", p.isNull())
