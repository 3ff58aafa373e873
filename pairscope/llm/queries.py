"""Queries of the training-data operators and their SQL equivalents, gathered from the operator modules."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm import format_copies, language, leakage, lookalike, mixing, models, neighbors, personal, toxicity
from pairscope.session import table

EXPECTED = {"source_pt": "pt", "translation_en": "en"}
WORD_COUNTS = {"source_pt": "pt_word_count", "translation_en": "en_word_count"}
FIELDS = ["source_pt", "translation_en"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of personal detail in each answer and translation; surnames are learned from the whole table first."""
    df = table(spark, d, "paired_responses")
    return personal.found_kinds(df, "pair_id", FIELDS, learned=personal.learn_surnames(df, FIELDS))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every value with typed placeholders instead of its details."""
    df = table(spark, d, "paired_responses")
    return personal.redact_fields(df, "pair_id", FIELDS, learned=personal.learn_surnames(df, FIELDS))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Answers of more than eight words that are copies but for formatting, each with the copy that is kept."""
    df = table(spark, d, "paired_responses").filter(F.col("pt_word_count") > 8)
    out = format_copies.copies(df, "pair_id", "source_pt")
    return out.select(F.col("kept_id").alias("kept_pair_id"), F.col("id").alias("pair_id")).distinct()


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each answer of any length, with its true number of copies."""
    out = format_copies.copy_groups(table(spark, d, "paired_responses"), "pair_id", "source_pt")
    return out.select(F.col("kept_id").alias("kept_pair_id"), "n_copies", "collides")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest documents of each query of the same direction, of cosine 0.9 or more."""
    out = neighbors.top_neighbors(table(spark, d, "pair_vectors"), "pair_id", "direction", "query_embedding", "document_embedding", 5, 0.9)
    return out.select(F.col("partition").alias("direction"), F.col("query_id").alias("query_pair_id"), F.col("document_id").alias("document_pair_id"))


def p4_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same without any loss: every cell is visited that can hold a neighbour."""
    out = neighbors.top_neighbors(table(spark, d, "pair_vectors"), "pair_id", "direction", "query_embedding", "document_embedding", 5, 0.9, spread=neighbors.EXACT)
    return out.select(F.col("partition").alias("direction"), F.col("query_id").alias("query_pair_id"), F.col("document_id").alias("document_pair_id"), "place")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Language that the given detector is sure of, by field; null where it is ambiguous or undecided."""
    sure = lambda side: F.when(~F.coalesce(F.col(f"{side}_ambiguous"), F.lit(True)), F.col(f"{side}_predicted"))
    return table(spark, d, "language_verification").select("pair_id", sure("pt").alias("source_pt"), sure("en").alias("translation_en")).filter(F.col("pair_id").isNotNull())


def _language_net(spark: SparkSession, d: str) -> language.ByteGru:
    """The network fitted for this directory's answers: loaded if it was fitted before."""
    df, said = table(spark, d, "paired_responses"), _verdicts(spark, d)
    tables = [df, table(spark, d, "language_verification")]
    made = models.stored("language", tables, {"fields": str(EXPECTED)}, [language, lookalike, personal], lambda: language.fit(df, "pair_id", EXPECTED, verdicts=said).arrays())
    return language.ByteGru.of(made)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of each value of more than eight words that has a clause in another than the expected language."""
    out = language.unexpected(table(spark, d, "paired_responses"), "pair_id", EXPECTED, WORD_COUNTS, _language_net(spark, d))
    return out.select(F.col("id").alias("pair_id"), "field", "lang").distinct()


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every segment of every answer and translation."""
    return language.segments(table(spark, d, "paired_responses"), "pair_id", EXPECTED, _language_net(spark, d)).withColumnRenamed("id", "pair_id")


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and number of languages of every value, and whether the given verdict on it agrees (null: none, or undecided)."""
    out = language.documents(table(spark, d, "paired_responses"), "pair_id", EXPECTED, _language_net(spark, d)).withColumnRenamed("id", "pair_id")
    given = table(spark, d, "language_verification").filter(F.col("pair_id").isNotNull())
    flags = given.groupBy("pair_id").agg(F.max("pt_matches_expected").alias("source_pt"), F.max("en_matches_expected").alias("translation_en"), F.max("pt_ambiguous").alias("_a0"), F.max("en_ambiguous").alias("_a1"))
    long = flags.select("pair_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(~F.coalesce(F.col(f"_a{i}"), F.lit(True)), F.col(f)).alias("said")) for i, f in enumerate(FIELDS)])).alias("_v"))
    expected = F.when(F.col("field") == "source_pt", EXPECTED["source_pt"]).otherwise(EXPECTED["translation_en"])
    joined = out.join(long.select("pair_id", "_v.field", "_v.said"), ["pair_id", "field"], "left")
    return joined.withColumn("verdict_agrees", (F.col("lang") == expected) == F.col("said")).drop("said")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with a character that only looks like, or invisibly adds to, plain text."""
    return lookalike.changed_values(table(spark, d, "paired_responses"), "pair_id", FIELDS)


def p6_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every value in its consistent form."""
    return lookalike.consistent_text(table(spark, d, "paired_responses"), "pair_id", FIELDS).select("pair_id", "field", "consistent", "changed")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with ten words of an item, as they are or with one word put in, left out or replaced."""
    return leakage.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", 10, 1, 0.95)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with ten consecutive words of an evaluation item: the part of the search that is verified to be without an edit."""
    return _leaks(spark, d).filter("edits = 0").select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """The whole search: fewest edits and number of the item's windows that each document holds."""
    return _leaks(spark, d)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken for the mix, with their number of copies."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


TOXIC_AT = 0.6


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    reviews = table(spark, d, "content_labels")
    made = models.stored("toxicity", [docs, reviews], {}, [toxicity, lookalike], lambda: toxicity.fit(docs, "doc_id", "text", reviews).arrays())
    return toxicity.score(docs, "doc_id", "text", "source", toxicity.Crf.of(made))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories of abusive, hateful or sexual content in each document."""
    return _scored(spark, d).filter((F.col("score") >= TOXIC_AT) & (F.size("spans") > 0)).select("doc_id", "category").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and offending offsets of every document and category."""
    return _scored(spark, d).select("doc_id", "category", "score", "spans")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each source."""
    return toxicity.source_rates(_scored(spark, d), TOXIC_AT)


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_records": p2_records, "p4_found": p4_found, "p4_exact": p4_exact, "p5_found": p5_found, "p5_segments": p5_segments, "p5_documents": p5_documents, "p6_found": p6_found, "p7_found": p7_found, "p7_near": p7_near, "p8_selection": p8_selection, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p6_consistent": p6_consistent}
# Windows of ten folded words, joined as strings.
_WORDS = "string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' ')"
_WINDOWS = "SELECT DISTINCT {id}, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT {id}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {id}, " + _WORDS + " AS w FROM {t}) WHERE len(w) >= 10)"
# Canonical form by its definition: numbers keep their sign, point and comma (as letters that no text has), formatting becomes blanks.
_BLANK = rf"[^\p{{L}}\p{{M}}\p{{N}}\p{{S}}{format_copies.SIGNS}.,\-\x{{200D}}]|[{format_copies.SEPARATORS}\x{{FE0F}}]"
_MARKED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(x), '(\p{Nd})\.(\p{Nd})', '\1ꙮ\2', 'g'), '(\p{Nd})\.(\p{Nd})', '\1ꙮ\2', 'g'), '(\p{Nd}),(\p{Nd})', '\1ꙭ\2', 'g'), '(\p{Nd}),(\p{Nd})', '\1ꙭ\2', 'g'), '(^|" + _BLANK + r")-(\p{Nd})', '\1ꙫ\2', 'g')"
_CANON = rf"trim(regexp_replace(regexp_replace({_MARKED}, '(^|\s)#+(\s)', '\1 \2', 'g'), '(?:[^\p{{L}}\p{{M}}\p{{N}}\p{{S}}{format_copies.SIGNS}\x{{200D}}]|[{format_copies.SEPARATORS}\x{{FE0F}}])+', ' ', 'g'))"
# Consistent form: invisible characters out (emoji keep their joiners), spaces plain, other widths and styles and look-alikes by the standard's tables, accents composed.
_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"
_STYLED = "".join(chr(c) for c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)] if len(unicodedata.normalize("NFKC", chr(c))) == 1 and unicodedata.normalize("NFKC", chr(c)).isascii())
_ALIKE = {**lookalike.CYRILLIC, **lookalike.GREEK, **{c: unicodedata.normalize("NFKC", c) for c in _STYLED}}
_QUOTED = lambda x: x.replace("'", "''")
_PLAIN = (
    rf"regexp_replace(replace(regexp_replace(regexp_replace(t, '({_EMOJI})\x{{200D}}({_EMOJI})', '\1ꙮ\2', 'g'), '[\x{{AD}}\x{{34F}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g'), 'ꙮ', chr(8205)), "
    r"'[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g')"
)
for _joined, _apart in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
    _PLAIN = f"replace({_PLAIN}, '{_joined}', '{_apart}')"
_PLAIN = f"nfc_normalize(translate({_PLAIN}, '{''.join(_ALIKE)}', '{_QUOTED(''.join(_ALIKE.values()))}'))"
_RECORDS = rf"""WITH t AS (SELECT pair_id, source_pt, pt_word_count, list_filter(string_split_regex(source_pt, '\s*(?:;|\||//|\s/\s|[\r\n]+|•|·)\s*'), lambda x: trim(x) <> '') AS parts
               FROM (SELECT pair_id, pt_word_count, {_PLAIN} AS source_pt FROM (SELECT *, source_pt AS t FROM paired_responses WHERE source_pt IS NOT NULL))),
        c AS (SELECT pair_id, pt_word_count, CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '^[^\p{{L}}\p{{N}}]*\p{{L}}[\p{{L}}\p{{M}}\p{{N}} \t]{{0,28}}?[ \t]*[:=]\s*\S'))) = 0
               THEN array_to_string(list_sort(list_transform(parts, lambda x: {_CANON})), '|') ELSE coalesce(nullif(list_transform([source_pt], lambda x: {_CANON})[1], ''), trim(source_pt)) END AS c FROM t)"""

ORACLES: dict[str, str] = {
    "p2_found": f"""{_RECORDS}, k AS (SELECT * FROM c WHERE pt_word_count > 8), g AS (SELECT c, min(pair_id) AS kept_pair_id FROM k GROUP BY 1 HAVING count(*) > 1)
        SELECT DISTINCT kept_pair_id, pair_id FROM k JOIN g USING (c) WHERE pair_id <> kept_pair_id""",
    "p2_records": f"{_RECORDS} SELECT min(pair_id) AS kept_pair_id, count(*) AS n_copies, false AS collides FROM c GROUP BY c",
    "p6_consistent": f"""WITH v AS (SELECT pair_id, 'source_pt' AS field, source_pt AS t FROM paired_responses UNION ALL SELECT pair_id, 'translation_en', translation_en FROM paired_responses),
        n AS (SELECT pair_id, field, t, {_PLAIN} AS consistent FROM v) SELECT pair_id, field, consistent, coalesce(t <> consistent, false) AS changed FROM n""",
    "p4_exact": """WITH q AS (SELECT DISTINCT direction, pair_id, query_embedding::DOUBLE[] AS v FROM pair_vectors WHERE query_embedding IS NOT NULL AND list_inner_product(query_embedding::DOUBLE[], query_embedding::DOUBLE[]) > 0),
        d AS (SELECT DISTINCT direction, pair_id, document_embedding::DOUBLE[] AS v FROM pair_vectors WHERE document_embedding IS NOT NULL AND list_inner_product(document_embedding::DOUBLE[], document_embedding::DOUBLE[]) > 0),
        s AS (SELECT q.direction, q.pair_id AS query_pair_id, d.pair_id AS document_pair_id, max(list_cosine_similarity(q.v, d.v)) AS c FROM q JOIN d USING (direction) GROUP BY 1, 2, 3 HAVING c >= 0.9)
        SELECT direction, query_pair_id, document_pair_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY direction, query_pair_id ORDER BY c DESC, document_pair_id) AS place FROM s) WHERE place <= 5""",
    "p6_found": r"""WITH v AS (SELECT pair_id, 'source_pt' AS field, source_pt AS t FROM paired_responses UNION ALL SELECT pair_id, 'translation_en', translation_en FROM paired_responses),
        e AS (SELECT pair_id, field, regexp_replace(t, '[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]\x{200D}[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]', '', 'g') AS t FROM v)
        SELECT DISTINCT pair_id, field FROM e WHERE regexp_matches(t, '[\x{A0}\x{AD}\x{300}-\x{36F}\x{370}-\x{52F}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FB00}-\x{FB06}\x{FEFF}\x{FF01}-\x{FF5E}\x{1D400}-\x{1D7FF}]')""",
    "p7_near": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM eval_items)), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        iw AS (SELECT item_id, k, w[k:k + 9] AS v FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) >= 10)),
        dw AS (SELECT DISTINCT doc_id, w[k:k + n - 1] AS v, n FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, range(9, 12) r(n) WHERE len(w) >= n)),
        hole AS (SELECT p FROM range(1, 12) r(p)),
        i_less AS (SELECT item_id, k, p, array_to_string(v[1:p - 1] || v[p + 1:], ' ') AS s FROM iw, hole WHERE p <= 10),
        d_less AS (SELECT doc_id, n, p, array_to_string(v[1:p - 1] || v[p + 1:], ' ') AS s FROM dw, hole WHERE p <= n AND n > 9),
        m AS (SELECT doc_id, item_id, k, 0 AS e FROM iw JOIN dw ON n = 10 AND iw.v = dw.v
              UNION ALL SELECT doc_id, item_id, k, 1 FROM i_less JOIN d_less ON n = 10 AND i_less.p = d_less.p AND i_less.s = d_less.s
              UNION ALL SELECT doc_id, item_id, k, 1 FROM i_less JOIN dw ON n = 9 AND i_less.s = array_to_string(dw.v, ' ')
              UNION ALL SELECT doc_id, item_id, k, 1 FROM iw JOIN d_less ON n = 11 AND array_to_string(iw.v, ' ') = d_less.s)
        SELECT doc_id, item_id, count(DISTINCT k) AS n_windows, min(e)::INTEGER AS edits FROM m GROUP BY 1, 2""",
    "p7_found": "WITH d AS (" + _WINDOWS.format(id="doc_id", t="documents") + "), i AS (" + _WINDOWS.format(id="item_id", t="eval_items") + ") SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (k)",
}
