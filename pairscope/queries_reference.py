"""Queries of the engine's own operators, each with an independent DuckDB statement where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope import contracts
from pairscope.functions import embeddings, ids, language, quality, text, vectors
from pairscope.operators import affect, analysis, curation, resampling, retrieval, ridge, sensitivity, strata
from pairscope.session import cut_lineage, release, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paired_responses")


# --- text, ids, scalar expressions -------------------------------------------------------------------------------


@query("""SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normalized_md5,
          len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))::INTEGER AS word_count FROM documents""")
def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    """Normalised text (as its digest) and token count of every document."""
    docs = table(spark, d, "documents").select("doc_id", text.normalize_for_qc("text").alias("t"))
    return docs.select("doc_id", F.md5("t").alias("normalized_md5"), text.token_count(F.col("t")).alias("word_count"))


@query("SELECT pair_id, pt_word_count, en_word_count, exact_normalized_copy FROM paired_responses")
def word_counts_and_copies(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of normalised text and the exact-copy flag, computed anew."""
    n = _pairs(spark, d).select("pair_id", text.normalize_for_qc("source_pt").alias("p"), text.normalize_for_qc("translation_en").alias("e"))
    return n.select("pair_id", text.token_count(F.col("p")).alias("pt_word_count"), text.token_count(F.col("e")).alias("en_word_count"), (F.col("p") == F.col("e")).alias("exact_normalized_copy"))


@query("SELECT pair_id, sha256('v1' || chr(31) || 'pair' || chr(31) || participant_id || chr(31) || question_index) AS stable_id FROM paired_responses")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Namespaced SHA-256 surrogate ids."""
    return _pairs(spark, d).select("pair_id", ids.stable_id("pair", F.col("participant_id"), F.col("question_index")).alias("stable_id"))


@query("""SELECT CASE WHEN pt_word_count <= 2 THEN '1-2' WHEN pt_word_count <= 5 THEN '3-5' WHEN pt_word_count <= 20 THEN '6-20' WHEN pt_word_count > 20 THEN '21+' END AS band,
          count(*) AS n, round(sum(ln(1 + pt_word_count)), 6) AS sum_log_words FROM paired_responses GROUP BY 1""")
def length_bands(spark: SparkSession, d: str) -> DataFrame:
    """Rows and summed log length of each band."""
    return _pairs(spark, d).groupBy(text.length_band(F.col("pt_word_count")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.log1p("pt_word_count")), 6).alias("sum_log_words"))


@query("""SELECT pair_id, question_index FROM paired_responses WHERE cohort_id IN ('cohort_2021_n', 'cohort_2024_s') AND question_index IN (1, 2, 3) AND prompt_family = 'changes'
          AND length(regexp_replace(translation_en, '\\s', '', 'g')) > 0""")
def conjunctive_filter(spark: SparkSession, d: str) -> DataFrame:
    """Keys listed, fields equal, text not blank."""
    out = text.conjunctive_filter(_pairs(spark, d), {"cohort_id": ["cohort_2021_n", "cohort_2024_s"], "question_index": [1, 2, 3]}, {"prompt_family": "changes"}, ["translation_en"])
    return out.select("pair_id", "question_index")


@query("SELECT pair_id, CASE prompt_family WHEN 'strengths' THEN 1 WHEN 'changes' THEN 2 WHEN 'wellbeing' THEN 3 END AS family_code FROM paired_responses")
def strict_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary mapping in which an unmapped key raises."""
    return _pairs(spark, d).select("pair_id", text.strict_map(F.col("prompt_family"), {"strengths": 1, "changes": 2, "wellbeing": 3}, "family").alias("family_code"))


# --- curation -----------------------------------------------------------------------------------------------------


@query("""SELECT survey_key_sha256, respondent_key_sha256, pair_id, min(source_record_id) AS source_record_id FROM lineage GROUP BY 1, 2, 3""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The record of smallest id of each key."""
    keys = ["survey_key_sha256", "respondent_key_sha256", "pair_id"]
    return curation.keep_first(table(spark, d, "lineage").select(*keys, "source_record_id"), keys, ["source_record_id"])


@query("""SELECT pair_id, CASE WHEN pt_duplicate_group_id IS NOT NULL THEN count(*) OVER (PARTITION BY pt_duplicate_group_id) END AS pt_size,
          CASE WHEN en_duplicate_group_id IS NOT NULL THEN count(*) OVER (PARTITION BY en_duplicate_group_id) END AS en_size FROM paired_responses""")
def duplicate_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """True sizes of both duplicate groups of every row, over the whole table; null for no group."""
    df = _pairs(spark, d).select("pair_id", "pt_duplicate_group_id", "en_duplicate_group_id")
    df = curation.with_group_size(curation.with_group_size(df, ["pt_duplicate_group_id"], "pt_size"), ["en_duplicate_group_id"], "en_size")
    return df.select("pair_id", "pt_size", "en_size")


_HASHED = "sha256('v1' || chr(31) || {})"


@query("SELECT DISTINCT l.source_record_id, " + _HASHED.format("'participant' || chr(31) || coalesce(cohort_id, '') || chr(31) || coalesce(respondent_key_sha256, '')") + " AS participant, " + _HASHED.format(
    "'pair' || chr(31) || coalesce(cohort_id, '') || chr(31) || coalesce(respondent_key_sha256, '') || chr(31) || coalesce(question_index::VARCHAR, '') || chr(31) || coalesce(pt_duplicate_group_id, '') || chr(31) || coalesce(en_duplicate_group_id, '')") + """ AS pair
    FROM lineage l LEFT JOIN paired_responses p USING (pair_id)""")  # fmt: skip
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Hashed participant and pair id of every ingested record, from its own keys."""
    rows = _raw(spark, d)
    return rows.select("source_record_id", ids.stable_id("participant", F.col("cohort_id"), F.col("respondent_key_sha256")).alias("participant"),
                       ids.stable_id("pair", *[F.col(k) for k in _RECORD_KEYS]).alias("pair")).distinct()


_RECORD_KEYS = ["cohort_id", "respondent_key_sha256", "question_index", "pt_duplicate_group_id", "en_duplicate_group_id"]


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Ingested records with their pair's keys; groups stand for the normalised texts they are hashes of."""
    pairs = _pairs(spark, d).select("pair_id", "cohort_id", "question_index", "pt_duplicate_group_id", "en_duplicate_group_id")
    return curation.attach_lineage(table(spark, d, "lineage").select("source_record_id", "pair_id", "respondent_key_sha256", "batch_no"), pairs)


@query("""WITH r AS (SELECT l.source_record_id, l.batch_no, l.respondent_key_sha256, p.cohort_id, p.question_index, p.pt_duplicate_group_id, p.en_duplicate_group_id FROM lineage l LEFT JOIN paired_responses p USING (pair_id)),
          v AS (SELECT cohort_id, respondent_key_sha256, question_index, pt_duplicate_group_id, count(DISTINCT en_duplicate_group_id) AS n FROM r GROUP BY 1, 2, 3, 4)
          SELECT r.source_record_id, r.batch_no, count(*) OVER (PARTITION BY r.cohort_id, r.respondent_key_sha256, r.question_index, r.pt_duplicate_group_id, r.en_duplicate_group_id) AS ingestion_record_count, v.n AS translation_variant_count
          FROM r JOIN v ON r.cohort_id IS NOT DISTINCT FROM v.cohort_id AND r.respondent_key_sha256 IS NOT DISTINCT FROM v.respondent_key_sha256 AND r.question_index IS NOT DISTINCT FROM v.question_index
          AND r.pt_duplicate_group_id IS NOT DISTINCT FROM v.pt_duplicate_group_id""")
def ingestion_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records of the same five keys and translations of the same four, attached to every ingested record."""
    out = curation.attach_counts(_raw(spark, d), _RECORD_KEYS[:4], _RECORD_KEYS, "en_duplicate_group_id")
    return out.select("source_record_id", "batch_no", "ingestion_record_count", "translation_variant_count")


@query("SELECT count(*) AS n_rows, count(DISTINCT pt_duplicate_group_id) AS n_groups FROM paired_responses")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate groups recomputed from hashed normalised text agree in number with the given ones."""
    h = _pairs(spark, d).select(ids.stable_id("pt_group", text.normalize_for_qc("source_pt")).alias("g"))
    return h.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("g").alias("n_groups"))


@query("SELECT pt_duplicate_group_id, count(DISTINCT translation_en) AS n_variants, count(*) AS n_records FROM paired_responses GROUP BY 1")
def translation_variants(spark: SparkSession, d: str) -> DataFrame:
    """Distinct translations of each source text."""
    return curation.translation_variants(_pairs(spark, d), ["pt_duplicate_group_id"], "translation_en")


@query("""SELECT pair_id FROM paired_responses WHERE participant_id IN (SELECT participant_id FROM paired_responses GROUP BY 1 HAVING count(DISTINCT question_index) = 3)""")
def complete_triads(spark: SparkSession, d: str) -> DataFrame:
    """Answers of participants who answered all three questions."""
    return curation.complete_groups(_pairs(spark, d), ["participant_id"], "question_index", 3).select("pair_id")


@query("SELECT DISTINCT participant_id, cohort_id, year FROM paired_responses")
def cohort_participants(spark: SparkSession, d: str) -> DataFrame:
    """Participants of the answers."""
    return curation.participants(_pairs(spark, d))


@query("SELECT DISTINCT cohort_id || '_q' || question_index AS prompt_id, cohort_id, year, question_index, prompt_family FROM paired_responses")
def cohort_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of the answers."""
    return curation.prompts(_pairs(spark, d))


@query("SELECT cohort_id, count(DISTINCT participant_id) AS n_participants, count(*) AS n_pairs FROM paired_responses GROUP BY 1")
def cohort_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Participants and answers of each cohort."""
    return _pairs(spark, d).groupBy("cohort_id").agg(F.count_distinct("participant_id").alias("n_participants"), F.count(F.lit(1)).alias("n_pairs"))


@query("""SELECT p.participant_id, f.cohort_id AS fold_id, CASE WHEN p.cohort_id = f.cohort_id THEN 'held_out' ELSE 'train' END AS role
          FROM participants p, (SELECT DISTINCT cohort_id FROM prompts) f""")
def splits_loco(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-cohort-out roles of every participant; the folds are the four cohorts of the prompts table."""
    folds = [r.cohort_id for r in table(spark, d, "prompts").select("cohort_id").distinct().collect()]
    return curation.splits_leave_one_out(table(spark, d, "participants"), folds)


@query("SELECT l.source_record_id, l.pair_id, l.batch_no, p.cohort_id, p.question_index FROM lineage l LEFT JOIN paired_responses p USING (pair_id)")
def lineage_join(spark: SparkSession, d: str) -> DataFrame:
    """Every ingested record with its pair."""
    pairs = _pairs(spark, d).select("pair_id", "cohort_id", "question_index")
    return curation.attach_lineage(table(spark, d, "lineage").select("source_record_id", "pair_id", "batch_no"), pairs)


@query("""SELECT count(*) AS n_rows, count(DISTINCT participant_id) AS n_participant_id, count(DISTINCT prompt_id) AS n_prompt_id, count_if(exact_normalized_copy) AS n_exact_normalized_copy,
          count_if(pt_word_count <= 2) AS n_up_to_2_words, count_if(pt_word_count <= 5) AS n_up_to_5_words, median(pt_word_count)::DOUBLE AS median_words, max(pt_word_count)::BIGINT AS max_words FROM paired_responses""")
def qc_summary(spark: SparkSession, d: str) -> DataFrame:
    """Quality counts in one aggregate."""
    return curation.qc_summary(_pairs(spark, d), "pt_word_count", "exact_normalized_copy", ["participant_id", "prompt_id"])


@query("SELECT pt_duplicate_group_id, min(pair_id) AS pair_id FROM paired_responses WHERE pt_duplicate_group_id IS NOT NULL GROUP BY 1")
def one_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The smallest pair of each Portuguese duplicate group."""
    return curation.one_per_group(_pairs(spark, d).select("pt_duplicate_group_id", "pair_id"), "pt_duplicate_group_id", "pair_id")


@query("SELECT pair_id, row_number() OVER (ORDER BY cohort_id, participant_id, question_index, pair_id) - 1 AS source_row FROM paired_responses")
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stable row numbers in the curated order."""
    df = _pairs(spark, d).select("cohort_id", "participant_id", "question_index", "pair_id")
    return curation.source_rows(df, ["cohort_id", "participant_id", "question_index", "pair_id"]).select("pair_id", F.col("source_row").cast("long").alias("source_row"))


@query("SELECT (source_row // 500)::BIGINT AS shard_index, min(source_row) AS row_start, max(source_row) + 1 AS row_stop, count(*) AS input_rows FROM pair_vectors GROUP BY 1")
def shard_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of shards of 500 rows."""
    return curation.shard_bounds(table(spark, d, "pair_vectors").select("source_row"), "source_row", 500)


# --- audits -------------------------------------------------------------------------------------------------------


@query("""SELECT count_if(pair_id IS NULL) AS pair_id, count_if(survey_id IS NULL) AS survey_id, count_if(legacy_survey_id IS NULL) AS legacy_survey_id, count_if(sector IS NULL) AS sector,
          count_if(pair_id IS NULL) + count_if(survey_id IS NULL) + count_if(legacy_survey_id IS NULL) + count_if(sector IS NULL) AS total FROM lineage""")
def null_audit(spark: SparkSession, d: str) -> DataFrame:
    """Nulls of each column in one aggregate."""
    return contracts.null_audit(table(spark, d, "lineage"), ["pair_id", "survey_id", "legacy_survey_id", "sector"])


@query("SELECT count(*) AS n_rows, count(DISTINCT pair_id) AS n_pairs, count(DISTINCT source_record_id) AS n_records FROM lineage")
def unique_audit(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts behind the uniqueness contracts."""
    return table(spark, d, "lineage").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pair_id").alias("n_pairs"), F.count_distinct("source_record_id").alias("n_records"))


@query("""(SELECT 'left' AS side, participant_id, cohort_id FROM (SELECT participant_id, cohort_id FROM participants EXCEPT ALL SELECT participant_id, cohort_id FROM paired_responses))
          UNION ALL (SELECT 'right', participant_id, cohort_id FROM (SELECT participant_id, cohort_id FROM paired_responses EXCEPT ALL SELECT participant_id, cohort_id FROM participants))""")
def frame_equality(spark: SparkSession, d: str) -> DataFrame:
    """Differences, repeats counted, between the participants and the participants named by the answers (who are named several times)."""
    return contracts.frames_differ(table(spark, d, "participants"), _pairs(spark, d), ["participant_id", "cohort_id"])


@query("""WITH a AS (SELECT participant_id, count(*) AS n_answers FROM paired_responses GROUP BY 1) SELECT p.participant_id, p.cohort_id, a.n_answers FROM participants p JOIN a USING (participant_id)""")
def one_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    """Join of participants and their answers' counts, whose keys are checked to match one to one."""
    counts = _pairs(spark, d).groupBy("participant_id").agg(F.count(F.lit(1)).alias("n_answers"))
    people = table(spark, d, "participants").join(counts.select("participant_id"), "participant_id", "left_semi")
    return contracts.one_to_one(people.select("participant_id", "cohort_id"), counts, ["participant_id"])


@query("SELECT event_type, round(quantile_cont(value, 0.025), 8) AS q025, round(quantile_cont(value, 0.5), 8) AS q500, round(quantile_cont(value, 0.975), 8) AS q975 FROM events GROUP BY 1")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Linearly interpolated quantiles."""
    qs = [F.round(F.expr(f"percentile(value, {q})"), 8).alias(n) for q, n in ((0.025, "q025"), (0.5, "q500"), (0.975, "q975"))]
    return table(spark, d, "events").groupBy("event_type").agg(*qs)


# --- language, quality, embeddings --------------------------------------------------------------------------------


@query("""SELECT pair_id, coalesce(pt_predicted = 'pt', false) AS pt_matches_expected, pt_predicted IS NULL AS pt_ambiguous,
          coalesce(en_predicted = 'en', false) AS en_matches_expected, en_predicted IS NULL AS en_ambiguous FROM language_verification""")
def language_flags(spark: SparkSession, d: str) -> DataFrame:
    """Null-safe match and ambiguity flags from predictions."""
    df = table(spark, d, "language_verification").select("pair_id", "pt_predicted", "en_predicted")
    df = language.verification_flags(language.verification_flags(df, "pt_predicted", "pt", "pt"), "en_predicted", "en", "en")
    return df.select("pair_id", "pt_matches_expected", "pt_ambiguous", "en_matches_expected", "en_ambiguous")


_STOPS = {k: ", ".join(f"'{w}'" for w in v) for k, v in language.STOP_WORDS.items()}


@query(f"""WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^a-zà-ÿ]+') AS w FROM documents),
          s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({_STOPS["pt"]})))::DOUBLE AS pt, len(list_filter(w, lambda x: x IN ({_STOPS["en"]})))::DOUBLE AS en,
                len(list_filter(w, lambda x: x IN ({_STOPS["es"]})))::DOUBLE AS es FROM w)
          SELECT doc_id, CASE WHEN greatest(pt, en, es) > 0 AND greatest(pt, en, es) - (pt + en + es - greatest(pt, en, es) - least(pt, en, es)) >
              0.05 * (greatest(pt, en, es) + (pt + en + es - greatest(pt, en, es) - least(pt, en, es)))
              THEN CASE WHEN pt > en AND pt > es THEN 'pt' WHEN en > es THEN 'en' ELSE 'es' END END AS predicted FROM s""")
def stop_word_languages(spark: SparkSession, d: str) -> DataFrame:
    """Built-in detector over the documents; undecided is null."""
    return table(spark, d, "documents").select("doc_id", language.stop_word_predicted(F.col("text")).alias("predicted"))


@query("""SELECT count(*) AS n_rows, count_if(pt_matches_expected) AS n_pt_matches_expected, count_if(en_matches_expected) AS n_en_matches_expected,
          count_if(pt_ambiguous) AS n_pt_ambiguous, count_if(en_ambiguous) AS n_en_ambiguous FROM language_verification""")
def language_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the verification flags."""
    df = table(spark, d, "language_verification")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *curation.sum_flags(df, ["pt_matches_expected", "en_matches_expected", "pt_ambiguous", "en_ambiguous"]))


@query("""SELECT pair_id, round((('0x' || substr(sha256(source_pt || chr(0) || translation_en), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551615::DOUBLE, 12) AS score FROM paired_responses""")
def synthetic_quality(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic quality score of each pair."""
    return _pairs(spark, d).select("pair_id", F.round(quality.synthetic_quality(F.col("source_pt"), F.col("translation_en")), 12).alias("score"))


@query("""WITH s AS (SELECT (('0x' || substr(sha256(source_pt || chr(0) || translation_en), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551615::DOUBLE AS v FROM paired_responses)
          SELECT count(v) AS n, round(avg(v), 8) AS mean, round(min(v), 8) AS low, round(max(v), 8) AS high FROM s""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and range of the scores."""
    s = _pairs(spark, d).select(quality.synthetic_quality(F.col("source_pt"), F.col("translation_en")).alias("v"))
    return s.agg(F.count("v").alias("n"), F.round(F.avg("v"), 8).alias("mean"), F.round(F.min("v"), 8).alias("low"), F.round(F.max("v"), 8).alias("high"))


@query()
def synthetic_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Query and document vectors of both directions, two rows a pair."""
    rows = _pairs(spark, d).select("pair_id", F.lit(0).cast("long").alias("source_row"), "source_pt", "translation_en")
    return embeddings.embed_pairs(rows, lambda: embeddings.SyntheticBackend(64, 1729), 64).drop("source_row")


def _vector_sql() -> str:
    parts = []
    for direction, (query_column, document_column, instruction) in embeddings.DIRECTIONS.items():
        for side, column, domain in (("query", query_column, f"'query' || chr(0) || '{instruction}'"), ("document", document_column, "'document'")):
            parts.append(f"SELECT pair_id, '{direction}' AS direction, '{side}' AS side, encode('1729' || chr(0) || {domain} || chr(0) || {column}) AS h FROM paired_responses WHERE source_pt IS NOT NULL AND translation_en IS NOT NULL")
    hashed = "sha256(h || '\\x00\\x00\\x00\\x00'::BLOB) || sha256(h || '\\x00\\x00\\x00\\x01'::BLOB)"
    entries = "list_transform(range(0, 64), lambda i: ((('0x' || substr(x, (2 * i + 1)::INTEGER, 2))::INTEGER) - 127.5::DOUBLE) / 127.5::DOUBLE)"
    unit = lambda k: f"round((v[{k}] / sqrt(list_inner_product(v, v)))::FLOAT::DOUBLE, 5)"
    return f"WITH t AS ({' UNION ALL '.join(parts)}), b AS (SELECT pair_id, direction, side, {hashed} AS x FROM t), w AS (SELECT pair_id, direction, side, {entries} AS v FROM b) SELECT pair_id, direction, side, " + ", ".join(f"{unit(k)} AS e{k}" for k in (1, 2, 32, 33, 64)) + " FROM w"


@query(_vector_sql())
def synthetic_entries(spark: SparkSession, d: str) -> DataFrame:
    """Five entries of every deterministic vector, queries with their instruction."""
    made = synthetic_embeddings(spark, d)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_embedding").alias("v")) for s in ("query", "document")])).alias("x")
    return made.select("pair_id", "direction", sides).select("pair_id", "direction", "x.side", *[F.round(F.col("x.v")[k - 1].cast("double"), 5).alias(f"e{k}") for k in (1, 2, 32, 33, 64)])


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
          SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_inner_product(e, e)), 8) AS first_unit FROM e""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Norm and first entry of the unit form."""
    df = table(spark, d, "embeddings").filter(vectors.usable(F.col("embedding")))
    return df.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.unit(F.col("embedding"))[0], 8).alias("first_unit"))


# --- retrieval ----------------------------------------------------------------------------------------------------

_BASE = """
    raw AS (SELECT pair_id, direction, source_row, query_embedding::DOUBLE[] AS q, document_embedding::DOUBLE[] AS d FROM pair_vectors WHERE query_embedding IS NOT NULL AND document_embedding IS NOT NULL),
    v AS (SELECT pair_id, direction, min(source_row) AS source_row, any_value(q) AS q, any_value(d) AS d FROM raw
          WHERE list_inner_product(q, q) > 0 AND list_inner_product(d, d) > 0 GROUP BY 1, 2),
    g AS (SELECT v.*, CASE WHEN direction = 'en_to_pt' THEN pt_duplicate_group_id ELSE en_duplicate_group_id END AS grp FROM v JOIN paired_responses p USING (pair_id)),
    u AS (SELECT pair_id, direction, source_row, grp, list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) AS q, list_transform(d, lambda x: x / sqrt(list_inner_product(d, d))) AS d
          FROM g WHERE grp IS NOT NULL),
    own AS (SELECT pair_id, direction, round(list_inner_product(q, d), 9) AS paired_cosine FROM u)"""
_RANKS = (
    "WITH" + _BASE + """,
    s AS (SELECT a.pair_id, a.direction, a.grp AS qg, b.grp, b.source_row AS place, round(list_inner_product(a.q, b.d), 9) AS score FROM u a JOIN u b USING (direction)),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, direction ORDER BY score DESC, place) AS rn FROM s),
    k AS (SELECT pair_id, direction, min(rn) AS retrieval_rank FROM r WHERE grp = qg GROUP BY 1, 2),
    n AS (SELECT direction, count(*) AS n_candidates FROM u GROUP BY 1),
    ranks AS (SELECT pair_id, direction, paired_cosine, retrieval_rank, 1.0::DOUBLE / retrieval_rank AS reciprocal_rank, retrieval_rank <= 1 AS hit_at_1, retrieval_rank <= 5 AS hit_at_5, n_candidates
          FROM k JOIN own USING (pair_id, direction) JOIN n USING (direction))"""
)
_DEDUP = (
    "WITH" + _BASE + """,
    s AS (SELECT a.pair_id, a.direction, a.grp AS qg, b.grp, max(round(list_inner_product(a.q, b.d), 9)) AS score FROM u a JOIN u b USING (direction) GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, direction ORDER BY score DESC, grp) AS rn FROM s),
    k AS (SELECT pair_id, direction, min(rn) AS retrieval_rank FROM r WHERE grp = qg GROUP BY 1, 2),
    n AS (SELECT direction, count(DISTINCT grp) AS n_candidates FROM u GROUP BY 1),
    dedup AS (SELECT pair_id, direction, paired_cosine, retrieval_rank, 1.0::DOUBLE / retrieval_rank AS reciprocal_rank, retrieval_rank <= 1 AS hit_at_1, retrieval_rank <= 5 AS hit_at_5, n_candidates
          FROM k JOIN own USING (pair_id, direction) JOIN n USING (direction))"""
)


def _ranks(spark: SparkSession, d: str, dedup: bool = False) -> DataFrame:
    return retrieval.retrieval_ranks(table(spark, d, "pair_vectors"), _pairs(spark, d), dedup=dedup)


@query("""WITH raw AS (SELECT DISTINCT pair_id, direction, query_embedding::DOUBLE[] AS q, document_embedding::DOUBLE[] AS d FROM pair_vectors WHERE query_embedding IS NOT NULL AND document_embedding IS NOT NULL)
          SELECT pair_id, direction, round(list_inner_product(q, d) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(d, d))), 9) AS paired_cosine FROM raw
          WHERE list_inner_product(q, q) > 0 AND list_inner_product(d, d) > 0""")
def paired_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each pair's own query and document."""
    return retrieval.paired_cosine(retrieval.usable_pairs(table(spark, d, "pair_vectors")))


@query(_RANKS + " SELECT * FROM ranks")
def retrieval_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate-aware rank of each query over all documents of its direction."""
    return _ranks(spark, d)


@query(_DEDUP + " SELECT * FROM dedup")
def retrieval_dedup_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over duplicate groups instead of documents."""
    return _ranks(spark, d, True)


@query(_RANKS + """ SELECT direction, count(*) AS n_pairs, round(avg(paired_cosine), 6) AS mean_cosine, round(avg(reciprocal_rank), 6) AS mrr, round(avg(hit_at_1::INT), 6) AS recall_at_1,
          round(avg(hit_at_5::INT), 6) AS recall_at_5 FROM ranks GROUP BY 1""")
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine, reciprocal rank and hit rates of each direction."""
    return retrieval.summary(_ranks(spark, d))


@query(_RANKS + " SELECT pair_id, " + ", ".join(f"max(CASE WHEN direction = '{x}' THEN {c} END) AS {c}_{x}" for x in ("en_to_pt", "pt_to_en") for c in ("paired_cosine", "retrieval_rank", "reciprocal_rank", "hit_at_1", "hit_at_5")) + " FROM ranks GROUP BY 1")
def retrieval_wide(spark: SparkSession, d: str) -> DataFrame:
    """Both directions of a pair in one row."""
    return retrieval.wide(_ranks(spark, d))


@query(_RANKS + ", dd AS (SELECT * FROM (" + _DEDUP + """ SELECT pair_id, direction, retrieval_rank AS g FROM dedup))
    SELECT direction, count(*) AS n_pairs, count_if(g > retrieval_rank) AS n_worse, count_if(g < retrieval_rank) AS n_better FROM ranks JOIN dd USING (pair_id, direction) GROUP BY 1""")
def dedup_never_worse(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose rank over groups is worse than over documents (there may be none but for ties placed otherwise), and better."""
    both = retrieval.both_ranks(table(spark, d, "pair_vectors"), _pairs(spark, d))
    return both.groupBy("direction").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("groups") > F.col("docs")).alias("n_worse"), F.count_if(F.col("groups") < F.col("docs")).alias("n_better"))


@query("WITH" + _BASE + " SELECT direction, count(*) AS n_documents, count(DISTINCT grp) AS n_groups FROM u GROUP BY 1")
def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and groups that are candidates of each direction."""
    base = retrieval.usable_pairs(table(spark, d, "pair_vectors")).join(_pairs(spark, d).select("pair_id", "pt_duplicate_group_id", "en_duplicate_group_id"), "pair_id")
    grp = F.when(F.col("direction") == "en_to_pt", F.col("pt_duplicate_group_id")).otherwise(F.col("en_duplicate_group_id"))
    return base.withColumn("grp", grp).filter("grp is not null").groupBy("direction").agg(F.count(F.lit(1)).alias("n_documents"), F.count_distinct("grp").alias("n_groups"))


# --- strata, resampling -------------------------------------------------------------------------------------------

_METRICS = ["pt_word_count", "en_word_count", "ingestion_record_count"]
_STRATA = """
    one AS (SELECT * FROM paired_responses WHERE pair_id IN (SELECT min(pair_id) FROM paired_responses WHERE pt_duplicate_group_id IS NOT NULL GROUP BY pt_duplicate_group_id)),
    sown AS (
    SELECT 'overall' AS stratum_type, 'all' AS stratum_value, * FROM paired_responses
    UNION ALL SELECT 'cohort', cohort_id, * FROM paired_responses WHERE cohort_id IS NOT NULL
    UNION ALL SELECT 'prompt_family', prompt_family, * FROM paired_responses WHERE prompt_family IS NOT NULL
    UNION ALL SELECT 'length_band', CASE WHEN pt_word_count <= 2 THEN '1-2' WHEN pt_word_count <= 5 THEN '3-5' WHEN pt_word_count <= 20 THEN '6-20' ELSE '21+' END, * FROM paired_responses WHERE pt_word_count IS NOT NULL
    UNION ALL SELECT 'subset', 'more_than_2_words', * FROM paired_responses WHERE pt_word_count > 2
    UNION ALL SELECT 'subset', 'more_than_5_words', * FROM paired_responses WHERE pt_word_count > 5
    UNION ALL SELECT 'subset', 'not_exact_copy', * FROM paired_responses WHERE NOT coalesce(exact_normalized_copy, false)
    UNION ALL SELECT 'subset', 'one_per_pt_response', * FROM one)"""


@query("WITH" + _STRATA + " " + " UNION ALL ".join(
    f"SELECT stratum_type, stratum_value, count(*) AS n_pairs, count(DISTINCT participant_id) AS n_participants, '{m}' AS metric, round(avg({m}), 6) AS estimate FROM sown GROUP BY 1, 2" for m in _METRICS
))
def strata_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the strata, from one pass over the rows."""
    return strata.stratum_means(_pairs(spark, d), _METRICS).withColumn("estimate", F.round("estimate", 6))


@query("""SELECT cohort_id, participant_id, sum(pt_word_count)::DOUBLE AS s_pt_word_count, coalesce(sum(en_word_count), 0)::DOUBLE AS s_en_word_count, count(pt_word_count) AS c_pt_word_count, count(en_word_count) AS c_en_word_count
          FROM paired_responses GROUP BY 1, 2""")
def cluster_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums and counts of each cluster, the bootstrap's sufficient statistics."""
    return resampling.cluster_sums(_pairs(spark, d), ["cohort_id"], "participant_id", ["pt_word_count", "en_word_count"])


@query("""WITH u AS (SELECT participant_id, row_number() OVER (ORDER BY participant_id) - 1 AS i FROM (SELECT DISTINCT participant_id FROM paired_responses)), n AS (SELECT count(*) AS n FROM u),
          r AS (SELECT prompt_family, participant_id, sum(pt_word_count) AS s, count(pt_word_count) AS c FROM paired_responses WHERE prompt_family IS NOT NULL GROUP BY 1, 2), o AS (SELECT r.*, i FROM r JOIN u USING (participant_id)),
          dr AS (SELECT prompt_family, rep, draw FROM (SELECT DISTINCT prompt_family FROM r) f, range(100) a(rep), n, LATERAL (SELECT unnest(range(n.n)) AS draw) b),
          p AS (SELECT prompt_family, rep, ('0x' || substr(md5(prompt_family || '|' || rep || '|' || draw), 1, 8))::UBIGINT % n.n AS i FROM dr, n),
          v AS (SELECT prompt_family, rep, sum(o.s) / sum(o.c) AS v FROM p JOIN o USING (prompt_family, i) GROUP BY 1, 2),
          e AS (SELECT prompt_family, sum(s) / sum(c) AS e FROM r GROUP BY 1)
          SELECT prompt_family, 'pt_word_count' AS metric, (SELECT n FROM n) AS n_clusters, round(any_value(e), 8) AS estimate, round(quantile_cont(v, 0.025), 8) AS ci_lower, round(quantile_cont(v, 0.975), 8) AS ci_upper
          FROM v JOIN e USING (prompt_family) GROUP BY 1""")
def bootstrap_ci_hash(spark: SparkSession, d: str) -> DataFrame:
    """Cluster-bootstrap intervals by prompt family over all participants, with MD5 draws."""
    df = _pairs(spark, d).filter(F.col("prompt_family").isNotNull())
    out = resampling.intervals_hash(df, ["prompt_family"], "participant_id", ["pt_word_count"], 100, universe=_pairs(spark, d))
    return out.select("prompt_family", "metric", "n_clusters", *[F.round(c, 8).alias(c) for c in ("estimate", "ci_lower", "ci_upper")])


REPETITIONS, SEED = 2_000, 20260820


@query()
def bootstrap_ci_numpy(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of every stratum with seeded multinomial draws; universe: all participants."""
    df = strata.all_strata(_pairs(spark, d)).select("stratum_type", "stratum_value", "participant_id", "pt_word_count", "en_word_count")
    return resampling.intervals_numpy(df, ["stratum_type", "stratum_value"], "participant_id", ["pt_word_count", "en_word_count"], REPETITIONS, 20260820, universe=_pairs(spark, d))


@query()
def bootstrap_ci_poisson(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of every stratum with hashed Poisson weights, for universes of any size."""
    df = strata.all_strata(_pairs(spark, d)).select("stratum_type", "stratum_value", "participant_id", "pt_word_count", "en_word_count")
    return resampling.intervals_poisson(df, ["stratum_type", "stratum_value"], "participant_id", ["pt_word_count", "en_word_count"], REPETITIONS, 20260820)


# --- affect -------------------------------------------------------------------------------------------------------

_TYPES = ("click", "login", "logout", "purchase", "view")
_PROF = """
    e AS (SELECT user_id, event_type, day(ts) % 2 AS odd FROM events),
    t AS (SELECT DISTINCT event_type FROM events),
    c AS (SELECT u.user_id, t.event_type, count_if(e.odd = 1) AS a, count_if(e.odd = 0) AS b FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN t LEFT JOIN e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2),
    m AS (SELECT user_id, event_type, sum(a) OVER (PARTITION BY user_id) AS na, sum(b) OVER (PARTITION BY user_id) AS nb, a, b FROM c),
    f AS (SELECT user_id, event_type, na, nb, CASE WHEN na > 0 THEN a::DOUBLE / na ELSE 0 END AS p, CASE WHEN nb > 0 THEN b::DOUBLE / nb ELSE 0 END AS q FROM m)"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("odd", F.dayofmonth("ts") % 2)
    kinds = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # five values
    counts = events.groupBy("user_id").agg(*[F.count_if((F.col("event_type") == k) & (F.col("odd") == o)).alias(f"{k}_{o}") for k in kinds for o in (1, 0)])
    return counts.select(F.col("user_id").alias("id"), *[affect.shares([F.col(f"{k}_{o}") for k in kinds]).alias(n) for o, n in ((1, "p"), (0, "q"))])


@query("WITH" + _PROF + """ SELECT user_id AS id, round(max(CASE WHEN rn = 1 THEN p END), 8) AS p_first, round(max(CASE WHEN rn = 1 THEN q END), 8) AS q_first, round(sum(p), 6) AS p_total, round(sum(q), 6) AS q_total
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS rn FROM f) GROUP BY 1""")
def profile_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share profiles with zero-denominator rule."""
    p = _profiles(spark, d)
    return p.select("id", F.round(F.col("p")[0], 8).alias("p_first"), F.round(F.col("q")[0], 8).alias("q_first"), F.round(affect.total(F.col("p")), 6).alias("p_total"), F.round(affect.total(F.col("q")), 6).alias("q_total"))


@query("WITH" + _PROF + """ SELECT user_id AS id, round(CASE WHEN max(na) = 0 AND max(nb) = 0 THEN 0 WHEN max(na) = 0 OR max(nb) = 0 THEN sqrt(0.5)
      ELSE sqrt(greatest((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0)) END, 6) AS js_distance FROM f GROUP BY 1""")
def profile_js_distance(spark: SparkSession, d: str) -> DataFrame:
    """Jensen-Shannon distance of two profiles."""
    return _profiles(spark, d).select("id", F.round(affect.js_distance(F.col("p"), F.col("q")), 6).alias("js_distance"))


@query("WITH" + _PROF + " SELECT user_id AS id, round(sum(abs(q - p)) / count(*), 8) AS mean_abs_delta FROM f GROUP BY 1")
def profile_mean_abs_delta(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute share difference."""
    return _profiles(spark, d).select("id", F.round(affect.mean_abs_delta(F.col("p"), F.col("q")), 8).alias("mean_abs_delta"))


@query("WITH" + _PROF + " SELECT user_id AS id, max(na) > 0 AND max(nb) > 0 AS both_nonzero, max(na) = 0 AND max(nb) = 0 AS both_zero, (max(na) > 0) <> (max(nb) > 0) AS one_nonzero FROM f GROUP BY 1")
def profile_nonzero_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which profiles are empty."""
    return _profiles(spark, d).select("id", *affect.nonzero_flags(F.col("p"), F.col("q")))


@query("""SELECT p_partkey, CASE WHEN p_size > 20 AND p_retailprice < 1200 THEN 'ambivalent' WHEN p_size > 20 THEN 'positive' WHEN p_retailprice < 1200 THEN 'negative' ELSE 'neutral' END AS valence FROM part""")
def valence_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Ambivalent before positive before negative before neutral."""
    return table(spark, d, "part").select("p_partkey", affect.valence(F.col("p_size") > 20, F.col("p_retailprice") < 1200).alias("valence"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
          t AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM w),
          n AS (SELECT doc_id, count(DISTINCT t) AS n_nodes FROM t GROUP BY 1),
          e AS (SELECT a.doc_id, count(*) AS n_edges FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i - a.i BETWEEN 1 AND 2 AND a.t <> b.t GROUP BY 1)
          SELECT d.doc_id AS id, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, round(CASE WHEN n_nodes > 1 THEN 2.0 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END, 8)::DOUBLE AS density
          FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id)""")
def network_features(spark: SparkSession, d: str) -> DataFrame:
    """Co-occurrence network of each document."""
    return affect.networks(table(spark, d, "documents"), "doc_id", "text").withColumn("density", F.round("density", 8))


# A small demonstration lexicon, Portuguese and English.
_LEXICON = [
    ("agradeço", "joy"), ("agradeço", "positive"), ("apoio", "trust"), ("apoio", "positive"), ("estresse", "fear"), ("estresse", "negative"), ("conflito", "anger"), ("conflito", "negative"),
    ("orgulhoso", "joy"), ("orgulhoso", "positive"), ("mudanças", "surprise"), ("mudanças", "positive"), ("mudanças", "negative"), ("piorou", "sadness"), ("piorou", "negative"),
    ("thank", "joy"), ("thank", "positive"), ("support", "trust"), ("support", "positive"), ("stress", "fear"), ("stress", "negative"), ("conflict", "anger"), ("conflict", "negative"),
    ("proud", "joy"), ("proud", "positive"), ("changes", "surprise"), ("changes", "positive"), ("changes", "negative"), ("worse", "sadness"), ("worse", "negative"), ("hope", "anticipation"), ("hope", "positive"),
    ("espero", "anticipation"), ("espero", "positive"), ("dirty", "disgust"), ("dirty", "negative"), ("sujo", "disgust"), ("sujo", "negative"),
]
_LEX_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _LEXICON) + ") l(token, emotion)"


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS t FROM w),
           h AS (SELECT doc_id, t, max((emotion = 'joy')::INT) AS joy, max((emotion = 'fear')::INT) AS fear, bool_or(emotion = 'positive') AS p, bool_or(emotion = 'negative') AS n,
                 max((emotion NOT IN ('positive', 'negative'))::INT) AS hit FROM t LEFT JOIN {_LEX_SQL} ON token = t GROUP BY 1, 2)
           SELECT d.doc_id AS id, count(t) AS n_nodes, coalesce(sum(joy), 0)::BIGINT AS joy_count, coalesce(sum(fear), 0)::BIGINT AS fear_count, count_if(coalesce(p, false) AND coalesce(n, false)) AS ambivalent_count,
                  round(CASE WHEN count(t) > 0 THEN coalesce(sum(hit), 0)::DOUBLE / count(t) ELSE 0 END, 8) AS emotion_coverage FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1""")
def lexicon_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Emotion counts and coverage of each document against a small lexicon."""
    lexicon = spark.createDataFrame(_LEXICON, "token string, emotion string")
    out = affect.lexicon_profile(table(spark, d, "documents"), "doc_id", "text", lexicon)
    return out.select("id", "n_nodes", "joy_count", "fear_count", "ambivalent_count", F.round("emotion_coverage", 8).alias("emotion_coverage"))


def demonstration_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LEXICON, "token string, emotion string")


def _affect(spark: SparkSession, d: str) -> DataFrame:
    return affect.pair_features(_pairs(spark, d), demonstration_lexicon(spark))


def _affect_sql() -> str:
    """CTEs up to ``aff``: the affect features of each pair, with its participant and length."""
    of = lambda *kinds: sorted({t for t, e in _LEXICON if e in kinds})
    among = lambda tokens, w: f"len(list_filter({w}, lambda x: x IN ({', '.join(repr(t) for t in tokens)})))" if tokens else "0"
    good, bad = set(of("positive")), set(of("negative"))
    sides = {"pt": "source_pt", "en": "translation_en"}
    words = ", ".join(f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS {s}_t" for s, c in sides.items())
    counts, shares, measures = [], [], []
    for s in sides:
        w = f"{s}_w"
        edges = " + ".join(f"len(list_filter(list_zip({s}_t[1:greatest(len({s}_t) - {k}, 0)], {s}_t[{k + 1}:]), lambda z: z[1] <> z[2]))" for k in (1, 2))
        counts += [f"len({w}) AS {s}_n", f"{edges} AS {s}_edges", f"[{', '.join(among(of(e), w) for e in affect.EMOTIONS)}]::DOUBLE[] AS {s}_e", f"{among(of(*affect.EMOTIONS), w)} AS {s}_matched",
                   f"{among(sorted(good & bad), w)} AS {s}_amb", f"{among(sorted(bad - good), w)} AS {s}_neg", f"{among(sorted(good - bad), w)} AS {s}_pos"]
        shares += [f"{s}_n", f"CASE WHEN list_sum({s}_e) > 0 THEN list_transform({s}_e, lambda x: x / list_sum({s}_e)) ELSE list_transform({s}_e, lambda x: 0.0::DOUBLE) END AS {s}_emotion",
                   f"CASE WHEN {s}_n > 0 THEN list_transform([{s}_amb, {s}_neg, {s}_n - {s}_amb - {s}_neg - {s}_pos, {s}_pos]::DOUBLE[], lambda x: x / {s}_n) ELSE [0.0, 0.0, 0.0, 0.0]::DOUBLE[] END AS {s}_valence",
                   f"CASE WHEN {s}_n > 0 THEN {s}_matched::DOUBLE / {s}_n ELSE 0 END AS {s}_emotion_coverage", f"CASE WHEN {s}_n > 0 THEN ({s}_amb + {s}_neg + {s}_pos)::DOUBLE / {s}_n ELSE 0 END AS {s}_valence_coverage",
                   f"CASE WHEN {s}_n > 1 THEN 2.0::DOUBLE * {s}_edges / ({s}_n * ({s}_n - 1)) ELSE 0 END AS {s}_density"]
    for f in affect.FAMILIES:
        half = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END))"
        p, q = f"pt_{f}", f"en_{f}"
        measures += [f"CASE WHEN list_sum({p}) = 0 AND list_sum({q}) = 0 THEN 0 WHEN list_sum({p}) = 0 OR list_sum({q}) = 0 THEN sqrt(0.5) ELSE sqrt(greatest(({half(p, q)} + {half(q, p)}) / 2, 0)) END AS {f}_js_distance",
                     f"list_sum(list_transform(list_zip({p}, {q}), lambda z: abs(z[1] - z[2]))) / len({p}) AS {f}_mean_abs_delta", f"list_sum({p}) > 0 AND list_sum({q}) > 0 AS {f}_both_nonzero",
                     f"list_sum({p}) = 0 AND list_sum({q}) = 0 AS {f}_both_zero", f"(list_sum({p}) > 0) <> (list_sum({q}) > 0) AS {f}_one_nonzero"]
    return f"""aw AS (SELECT pair_id, participant_id, pt_word_count, {words} FROM paired_responses), ad AS (SELECT *, list_distinct(pt_t) AS pt_w, list_distinct(en_t) AS en_w FROM aw),
      ac AS (SELECT pair_id, participant_id, pt_word_count, {", ".join(counts)} FROM ad), ash AS (SELECT pair_id, participant_id, pt_word_count, {", ".join(shares)} FROM ac),
      aff AS MATERIALIZED (SELECT *, {", ".join(measures)}, abs(en_density - pt_density) AS density_abs_delta FROM ash)"""


_COVERAGES = [f"{s}_{f}_coverage" for f in affect.FAMILIES for s in ("pt", "en")]
_FLAGS = [f"{f}_{n}" for f in affect.FAMILIES for n in affect.NONZERO]


@query("WITH " + _affect_sql() + " SELECT pair_id, pt_n AS pt_n_nodes, en_n AS en_n_nodes, " + ", ".join([f"round({c}, 6) AS {c}" for c in (*affect.DISTANCES, *_COVERAGES, "pt_density", "en_density")] + _FLAGS + [
    f"round(en_{f}[{i + 1}] - pt_{f}[{i + 1}], 6) AS delta_{e}" for f, labels in (("emotion", affect.EMOTIONS), ("valence", affect.VALENCES)) for i, e in enumerate(labels)]) + " FROM aff")
def affect_features(spark: SparkSession, d: str) -> DataFrame:
    """Affect features of each pair: coverages, densities, signed share differences, the five distances."""
    out = _affect(spark, d)
    delta = [F.round(F.col(f"{f}_deltas")[i], 6).alias(f"delta_{e}") for f, labels in (("emotion", affect.EMOTIONS), ("valence", affect.VALENCES)) for i, e in enumerate(labels)]
    return out.select("pair_id", "pt_n_nodes", "en_n_nodes", *[F.round(c, 6).alias(c) for c in (*affect.DISTANCES, *_COVERAGES, "pt_density", "en_density")], *_FLAGS, *delta)


# --- ridge --------------------------------------------------------------------------------------------------------

_FEATURES, _TARGET = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
_COLS = [*_FEATURES, _TARGET]


@query("SELECT l_returnflag AS cohort, count(*) AS n, " + ", ".join(f"round(sum({c}), 2) AS s_{i}" for i, c in enumerate(_COLS)) + ", " + ", ".join(
    f"round(sum({_COLS[i]} * {_COLS[j]}) / 1e6, 4) AS ss_{i}_{j}" for i in range(4) for j in range(i, 4)) + " FROM lineitem GROUP BY 1")
def ridge_gram(spark: SparkSession, d: str) -> DataFrame:
    """Sufficient statistics of each cohort."""
    g = ridge.gram_table(table(spark, d, "lineitem"), "l_returnflag", _FEATURES, _TARGET)
    return g.select("cohort", "n", *[F.round(f"s_{i}", 2).alias(f"s_{i}") for i in range(4)], *[F.round(F.col(f"ss_{i}_{j}") / 1e6, 4).alias(f"ss_{i}_{j}") for i in range(4) for j in range(i, 4)])


def _loco_sql(tail: str) -> str:
    """Two features, fixed alpha 1: each cohort predicted from the others, by Cramer's rule on standardised features."""
    return f"""WITH k AS (SELECT DISTINCT l_returnflag AS held FROM lineitem),
      m AS (SELECT held, count(*)::DOUBLE AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, sqrt(var_pop(l_quantity)) AS d1, sqrt(var_pop(l_discount)) AS d2,
            covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, l_extendedprice) AS c1y, covar_pop(l_discount, l_extendedprice) AS c2y FROM k JOIN lineitem ON l_returnflag <> held GROUP BY 1),
      s AS (SELECT *, n + 1.0 AS a11, n + 1.0 AS a22, n * c12 / (d1 * d2) AS a12, n * c1y / d1 AS b1, n * c2y / d2 AS b2 FROM m),
      w AS (SELECT held, (b1 * a22 - a12 * b2) / (a11 * a22 - a12 * a12) / d1 AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) / d2 AS w2, m1, m2, my FROM s),
      p AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice AS y, my - w1 * m1 - w2 * m2 + w1 * l_quantity + w2 * l_discount AS predicted FROM lineitem JOIN w ON held = l_returnflag) {tail}"""


@query(_loco_sql("SELECT l_returnflag, count(*) AS n, round(avg(abs(predicted - y)), 3) AS mae, round(sqrt(avg((predicted - y) ** 2)), 3) AS rmse, round(1 - avg((predicted - y) ** 2) / var_pop(y), 6) AS r2, round(corr(predicted, y), 6) AS pearson_r FROM p GROUP BY 1"))
def loco_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors of leave-one-cohort-out ridge with two features and alpha 1."""
    m = ridge.leave_one_cohort_out(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"], _TARGET, (1.0,))[1]
    return m.select("l_returnflag", "n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("pearson_r", 6).alias("pearson_r"))


@query(_loco_sql("SELECT l_orderkey, l_linenumber, round(predicted, 3) AS predicted FROM p"))
def loco_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions, each row once."""
    p = ridge.leave_one_cohort_out(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"], _TARGET, (1.0,))[0]
    return p.select("l_orderkey", "l_linenumber", F.round("predicted", 3).alias("predicted"))


def _tuned_sql() -> str:
    """Three features: penalty by inner leave-one-cohort-out over the training cohorts, normal equations by Cramer's rule on standardised features."""
    xs = dict(enumerate(_FEATURES, 1))
    pairs = [(i, j) for i in xs for j in xs if i <= j]
    sums = ["count(*)::DOUBLE AS n", f"sum({_TARGET}) AS sy", f"sum({_TARGET} * {_TARGET}) AS qyy", *[f"sum({x}) AS s{i}" for i, x in xs.items()], *[f"sum({x} * {_TARGET}) AS q{i}y" for i, x in xs.items()], *[f"sum({xs[i]} * {xs[j]}) AS q{i}{j}" for i, j in pairs]]
    names = ["n", "sy", "qyy", *[f"s{i}" for i in xs], *[f"q{i}y" for i in xs], *[f"q{i}{j}" for i, j in pairs]]
    added = ", ".join(f"sum(t.{c}) AS {c}" for c in names)
    q = lambda i, j: f"q{min(i, j)}{max(i, j)}"
    stats = ", ".join([f"s{i} / n AS m{i}" for i in xs] + ["sy / n AS my"] + [f"sqrt(q{i}{i} / n - (s{i} / n) * (s{i} / n)) AS d{i}" for i in xs])
    entry = lambda i, j: f"(n * ({q(i, j)} / n - m{i} * m{j}) / (d{i} * d{j})" + (" + alpha)" if i == j else ")")
    cells = ", ".join([f"{entry(i, j)} AS a{i}{j}" for i in xs for j in xs] + [f"n * (q{i}y / n - m{i} * my) / d{i} AS b{i}" for i in xs])

    def det(column: int = 0) -> str:
        c = lambda i, j: f"b{i}" if j == column else f"a{i}{j}"
        return f"({c(1, 1)} * ({c(2, 2)} * {c(3, 3)} - {c(2, 3)} * {c(3, 2)}) - {c(1, 2)} * ({c(2, 1)} * {c(3, 3)} - {c(2, 3)} * {c(3, 1)}) + {c(1, 3)} * ({c(2, 1)} * {c(3, 2)} - {c(2, 2)} * {c(3, 1)}))"

    weights = ", ".join(f"{det(i)} / {det()} / d{i} AS w{i}" for i in xs)
    square = " + ".join(f"w{i} * w{j} * g.{q(i, j)}" for i in xs for j in xs)
    error = f"(g.qyy - 2 * ({' + '.join(f'w{i} * g.q{i}y' for i in xs)}) + ({square}) - 2 * b * (g.sy - ({' + '.join(f'w{i} * g.s{i}' for i in xs)})) + g.n * b * b) / g.n"
    return f"""WITH g AS (SELECT l_returnflag AS c, {", ".join(sums)} FROM lineitem GROUP BY 1),
      tr AS (SELECT h.c AS h, k.c AS k, {added} FROM g h JOIN g k ON k.c <> h.c JOIN g t ON t.c <> h.c AND t.c <> k.c GROUP BY 1, 2 UNION ALL SELECT h.c, NULL, {added} FROM g h JOIN g t ON t.c <> h.c GROUP BY 1),
      st AS (SELECT *, {stats} FROM tr), al AS (SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS alpha), eq AS (SELECT h, k, alpha, my, {", ".join(f"m{i}, d{i}" for i in xs)}, {cells} FROM st, al),
      so AS (SELECT h, k, alpha, my, {", ".join(f"m{i}" for i in xs)}, {weights} FROM eq), fi AS (SELECT *, my - ({" + ".join(f"w{i} * m{i}" for i in xs)}) AS b FROM so),
      er AS (SELECT h, alpha, avg({error}) AS e FROM fi JOIN g ON g.c = fi.k GROUP BY 1, 2), be AS (SELECT h, arg_min(alpha, e) AS alpha FROM er GROUP BY 1),
      p AS (SELECT l_returnflag, be.alpha, {_TARGET} AS y, b + {" + ".join(f"w{i} * {x}" for i, x in xs.items())} AS predicted FROM lineitem JOIN fi ON fi.h = l_returnflag AND fi.k IS NULL JOIN be ON be.h = fi.h AND be.alpha = fi.alpha)
      SELECT l_returnflag, count(*) AS n, any_value(alpha) AS alpha, round(avg(abs(predicted - y)), 3) AS mae, round(sqrt(avg((predicted - y) ** 2)), 3) AS rmse, round(1 - avg((predicted - y) ** 2) / var_pop(y), 6) AS r2, round(corr(predicted, y), 6) AS pearson_r FROM p GROUP BY 1"""


@query(_tuned_sql())
def ridge_tuned(spark: SparkSession, d: str) -> DataFrame:
    """Nested selection of alpha over five values with three features."""
    m = ridge.leave_one_cohort_out(table(spark, d, "lineitem"), "l_returnflag", _FEATURES, _TARGET)[1]
    return m.select("l_returnflag", "n", "alpha", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("pearson_r", 6).alias("pearson_r"))


# --- sensitivity --------------------------------------------------------------------------------------------------

_LV = "lv AS (SELECT DISTINCT * FROM language_verification), j AS (SELECT p.*, coalesce(pt_matches_expected, false) AS pm, coalesce(en_matches_expected, false) AS em, coalesce(pt_ambiguous, false) AS pa, coalesce(en_ambiguous, false) AS ea FROM paired_responses p JOIN lv USING (pair_id))"
_FLAG_SQL = {
    "flag_pt_matches_expected": "pm", "flag_en_matches_expected": "em", "flag_both_match": "pm AND em", "flag_pt_ambiguous": "pa", "flag_en_ambiguous": "ea", "flag_either_ambiguous": "pa OR ea",
    "flag_pt_explicit_mismatch": "NOT pm AND NOT pa", "flag_en_explicit_mismatch": "NOT em AND NOT ea", "flag_ambiguous_only": "(pa OR ea) AND NOT (NOT pm AND NOT pa) AND NOT (NOT em AND NOT ea)",
}
_BANDED = """b AS (SELECT 'overall' AS stratum_type, 'all' AS stratum_value, * FROM j UNION ALL
      SELECT 'length_band', CASE WHEN pt_word_count <= 2 THEN '1-2' WHEN pt_word_count <= 5 THEN '3-5' WHEN pt_word_count <= 20 THEN '6-20' ELSE '21+' END, * FROM j WHERE pt_word_count IS NOT NULL)"""


def _verified(spark: SparkSession, d: str) -> DataFrame:
    flags = sensitivity.language_flags(table(spark, d, "language_verification").distinct())
    return _pairs(spark, d).join(flags, "pair_id")


@query(f"WITH {_LV} SELECT pair_id, " + ", ".join(f"{e} AS {n}" for n, e in _FLAG_SQL.items()) + " FROM j")
def coverage_flags(spark: SparkSession, d: str) -> DataFrame:
    """Nine language flags of each verified pair."""
    return _verified(spark, d).select("pair_id", *_FLAG_SQL)


@query(f"WITH {_LV}, {_BANDED} " + " UNION ALL ".join(
    f"SELECT stratum_type, stratum_value, count(*) AS n_pairs, count(DISTINCT participant_id) AS n_participants, '{n}' AS flag, round(avg(({e})::INT), 8) AS rate FROM b GROUP BY 1, 2" for n, e in _FLAG_SQL.items()))
def language_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Rate of each flag, overall and by length band."""
    return sensitivity.flag_rates(_verified(spark, d), list(_FLAG_SQL)).withColumn("rate", F.round("rate", 8))


@query()
def language_coverage_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The same with bootstrap intervals."""
    return sensitivity.flag_intervals(_verified(spark, d), list(_FLAG_SQL), REPETITIONS, 20260820)


@query(f"""WITH {_LV}, u AS (SELECT count(DISTINCT participant_id) AS n_universe FROM j), k AS (SELECT * FROM j WHERE pm AND em) """ + " UNION ALL ".join(
    f"SELECT (SELECT count(*) FROM k) AS n_pairs, (SELECT count(DISTINCT participant_id) FROM k) AS n_participants, (SELECT n_universe FROM u) AS n_universe, '{m}' AS metric, round(avg({m}), 8) AS estimate FROM k" for m in _METRICS))
def language_matched_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over pairs whose both languages match."""
    return sensitivity.matched_means(_verified(spark, d), _METRICS).withColumn("estimate", F.round("estimate", 8))


@query(_RANKS + """, h AS (SELECT CASE WHEN pt_word_count <= 2 THEN '1-2' WHEN pt_word_count <= 5 THEN '3-5' WHEN pt_word_count <= 20 THEN '6-20' ELSE '21+' END AS band, direction, hit_at_1 FROM ranks JOIN paired_responses USING (pair_id))
      SELECT band, direction, count(*) AS n, round(avg(hit_at_1::INT), 8) AS recall_at_1 FROM h GROUP BY 1, 2""")
def length_stratified_recall(spark: SparkSession, d: str) -> DataFrame:
    """First-rank rate by length band and direction."""
    j = _ranks(spark, d).join(_pairs(spark, d).select("pair_id", "pt_word_count"), "pair_id")
    return j.groupBy(text.length_band(F.col("pt_word_count")).alias("band"), "direction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit_at_1").cast("double")), 8).alias("recall_at_1"))


@query("""WITH raw AS (SELECT DISTINCT pair_id, direction, query_embedding::DOUBLE[] AS q, document_embedding::DOUBLE[] AS d FROM pair_vectors WHERE query_embedding IS NOT NULL AND document_embedding IS NOT NULL),
      c AS (SELECT pair_id, direction, round(list_inner_product(q, d) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(d, d))), 9) AS a,
            round(list_inner_product(q[1:32], d[1:32]) / (sqrt(list_inner_product(q[1:32], q[1:32])) * sqrt(list_inner_product(d[1:32], d[1:32]))), 9) AS b FROM raw WHERE list_inner_product(q, q) > 0 AND list_inner_product(d, d) > 0)
      SELECT pair_id, direction, round(b - a, 6) AS delta_paired_cosine FROM c""")
def encoder_differences(spark: SparkSession, d: str) -> DataFrame:
    """Second encoder (the first half of the dimensions) minus the first."""
    full = retrieval.usable_pairs(table(spark, d, "pair_vectors"))
    half = full.withColumn("query_embedding", F.slice("query_embedding", 1, 32)).withColumn("document_embedding", F.slice("document_embedding", 1, 32))
    out = sensitivity.encoder_differences(retrieval.paired_cosine(full), retrieval.paired_cosine(half), ["paired_cosine"])
    return out.withColumn("delta_paired_cosine", F.round("delta_paired_cosine", 6))


@query(f"WITH {_LV} SELECT 'both_match' AS name, count_if(pm AND em) AS actual FROM j UNION ALL SELECT 'pt_ambiguous', count_if(pa) FROM j UNION ALL SELECT 'en_ambiguous', count_if(ea) FROM j")
def acceptance_counts(spark: SparkSession, d: str) -> DataFrame:
    """Named counts in one aggregate."""
    named = {"both_match": F.col("flag_both_match"), "pt_ambiguous": F.col("flag_pt_ambiguous"), "en_ambiguous": F.col("flag_en_ambiguous")}
    return sensitivity.acceptance_counts(_verified(spark, d), named)


# --- the analysis frame and its summaries ---------------------------------------------------------------------------

_FRAME = (
    _RANKS + ", wide AS (SELECT pair_id, " + ", ".join(f"max(CASE WHEN direction = '{x}' THEN {c}::DOUBLE END) AS {c}_{x}" for x in analysis.DIRECTIONS for c in ("paired_cosine", "hit_at_1", "hit_at_5", "reciprocal_rank")) + " FROM ranks GROUP BY 1 HAVING count(*) = 2), "
    + _affect_sql() + """, sc AS (SELECT pair_id, (('0x' || substr(sha256(source_pt || chr(0) || translation_en), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551615::DOUBLE AS score FROM paired_responses WHERE source_pt IS NOT NULL AND translation_en IS NOT NULL),
    fr AS MATERIALIZED (SELECT p.*, w.* EXCLUDE (pair_id), s.score, a.* EXCLUDE (pair_id, participant_id, pt_word_count) FROM paired_responses p JOIN wide w USING (pair_id) JOIN sc s USING (pair_id) JOIN aff a USING (pair_id))"""
)
_BAND = "CASE WHEN pt_word_count <= 2 THEN '1-2' WHEN pt_word_count <= 5 THEN '3-5' WHEN pt_word_count <= 20 THEN '6-20' ELSE '21+' END"


def _long_sql(source: str, keys: str, metrics: dict[str, str]) -> str:
    """Long means of metrics (name -> expression) over ``source``."""
    means = ", ".join(f"round(avg(({e})::DOUBLE), 6) AS {n}" for n, e in metrics.items())
    return f"SELECT * FROM (UNPIVOT (SELECT {keys}, count(*) AS n_pairs, count(DISTINCT participant_id) AS n_participants, {means} FROM {source} GROUP BY ALL) ON {', '.join(metrics)} INTO NAME metric VALUE estimate)"


def _frame(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    scores = pairs.select("pair_id", quality.synthetic_quality(F.col("source_pt"), F.col("translation_en")).alias("score"))
    return cut_lineage(analysis.frame(pairs, retrieval.wide(_ranks(spark, d)), scores, _affect(spark, d)))  # read several times by every summary


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("estimate", F.round("estimate", 6))


@query(_FRAME + " SELECT pair_id, participant_id, cohort_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in analysis.METRICS) + " FROM fr")
def analysis_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Metadata, retrieval of both directions, quality and affect of every pair that has all of them."""
    return _frame(spark, d).select("pair_id", "participant_id", "cohort_id", *[F.round(m, 6).alias(m) for m in analysis.METRICS])


@query(_FRAME + ", " + _STRATA.replace("paired_responses", "fr") + " " + _long_sql("sown", "stratum_type, stratum_value", {m: m for m in analysis.METRICS}))
def strata_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means of the fourteen metrics in every stratum."""
    return _rounded(analysis.estimates(*analysis.strata_cells(_frame(spark, d))))


@query()
def strata_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The same with bootstrap intervals over all clusters of the frame."""
    df = _frame(spark, d)
    return analysis.with_intervals(*analysis.strata_cells(df), df, "strata", REPETITIONS, SEED)


_MATCHED = ", lvm AS (SELECT DISTINCT * FROM language_verification), mt AS (SELECT * FROM fr WHERE pair_id IN (SELECT pair_id FROM lvm WHERE pt_matches_expected AND en_matches_expected))"


@query(_FRAME + _MATCHED + " " + _long_sql("mt", "'both_languages_match' AS subset", {m: m for m in analysis.METRICS}))
def matched_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means of the fourteen metrics over pairs whose both languages match."""
    return _rounded(analysis.estimates(*analysis.matched_cells(_frame(spark, d), _language_flags(spark, d))))


def _language_flags(spark: SparkSession, d: str) -> DataFrame:
    return sensitivity.language_flags(table(spark, d, "language_verification").distinct())


@query(_FRAME + " " + _long_sql("fr", f"{_BAND} AS length_band", {f"hit_at_1_{x}": f"hit_at_1_{x}" for x in analysis.DIRECTIONS}))
def length_summary(spark: SparkSession, d: str) -> DataFrame:
    """First-rank rates of the frame by length band."""
    return _rounded(analysis.estimates(*analysis.length_cells(_frame(spark, d))))


@query(_DEDUP + ", dr AS (SELECT * FROM dedup JOIN paired_responses USING (pair_id)) " + _long_sql("dr", "direction, n_candidates", {m: m for m in ("reciprocal_rank", "hit_at_1", "hit_at_5")}))
def retrieval_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Means of the ranks over duplicate groups, with the number of candidates."""
    return _rounded(analysis.estimates(*analysis.retrieval_cells(_ranks(spark, d, True), _pairs(spark, d))))


def _half_encoder(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of a second encoder: the first half of the dimensions."""
    df = table(spark, d, "pair_vectors").withColumn("query_embedding", F.slice("query_embedding", 1, 32)).withColumn("document_embedding", F.slice("document_embedding", 1, 32))
    return retrieval.retrieval_ranks(df, _pairs(spark, d))


_HALF = _RANKS.replace("query_embedding::DOUBLE[] AS q", "query_embedding[1:32]::DOUBLE[] AS q").replace("document_embedding::DOUBLE[] AS d", "document_embedding[1:32]::DOUBLE[] AS d")
_DELTAS = ("paired_cosine", "reciprocal_rank", "hit_at_1", "hit_at_5")


@query(_RANKS + ", hb AS (SELECT * FROM (" + _HALF + " SELECT * FROM ranks)), df AS (SELECT direction, participant_id, " + ", ".join(f"hb.{m}::DOUBLE - ranks.{m}::DOUBLE AS {m}" for m in _DELTAS) + " FROM ranks JOIN hb USING (pair_id, direction) JOIN paired_responses USING (pair_id)) " + _long_sql("df", "direction", {f"delta_{m}": m for m in _DELTAS}))
def encoder_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean differences of two encoders' ranks, pair by pair."""
    return _rounded(analysis.estimates(*analysis.encoder_cells(_ranks(spark, d), _half_encoder(spark, d), _pairs(spark, d))))


@query("WITH " + _affect_sql() + ", nz AS (" + " UNION ALL ".join(f"SELECT participant_id, '{f}' AS family, {f}_js_distance AS js_distance, {f}_mean_abs_delta AS mean_abs_delta FROM aff WHERE {f}_both_nonzero" for f in affect.FAMILIES) + ") " + _long_sql("nz", "family", {m: m for m in ("js_distance", "mean_abs_delta")}))
def affect_nonzero_summary(spark: SparkSession, d: str) -> DataFrame:
    """Distances over pairs whose both profiles are not empty."""
    return _rounded(analysis.estimates(*analysis.nonzero_cells(_pairs(spark, d).select("pair_id", "participant_id").join(_affect(spark, d), "pair_id"))))


def _coverage_sql() -> dict[str, str]:
    out = {}
    for f in affect.FAMILIES:
        for s in ("pt", "en"):
            out |= {f"{s}_{f}_profile_nonzero": f"list_sum({s}_{f}) > 0", f"{s}_{f}_lexicon_coverage": f"{s}_{f}_coverage", f"{s}_{f}_lexicon_coverage_nonzero": f"{s}_{f}_coverage > 0",
                    f"{s}_{f}_coverage_profile_disagreement": f"({s}_{f}_coverage > 0) <> (list_sum({s}_{f}) > 0)"}
        out |= {f"{f}_{n}": f"{f}_{n}" for n in affect.NONZERO}
    return out | {f"{s}_nodes_zero": f"{s}_n = 0" for s in ("pt", "en")}


_AFF_BANDS = f", ab AS (SELECT 'overall' AS stratum_type, 'all' AS stratum_value, * FROM aff UNION ALL SELECT 'length_band', {_BAND}, * FROM aff WHERE pt_word_count IS NOT NULL) "


@query("WITH " + _affect_sql() + _AFF_BANDS + _long_sql("ab", "stratum_type, stratum_value", _coverage_sql()))
def affect_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage diagnostics of the affect profiles, overall and by length band."""
    df = _pairs(spark, d).select("pair_id", "participant_id", "pt_word_count").join(_affect(spark, d), "pair_id")
    return _rounded(analysis.estimates(*analysis.coverage_cells(df)))


@query()
def sensitivity_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of every sensitivity summary: matched languages, length, ranks over groups, encoders, affect."""
    pairs = _pairs(spark, d)

    def stored(df: DataFrame) -> DataFrame:
        out = cut_lineage(df)
        release(spark)  # what led to it is on disk no longer
        return out

    def intervals(cells: dict) -> DataFrame:
        out = None
        for name, (rows, keys, metrics, universe) in cells.items():
            got = analysis.with_intervals(rows, keys, metrics, universe, name, REPETITIONS, SEED)
            got = got.select(F.lit(name).alias("summary"), F.concat_ws("|", *keys).alias("cell"), "metric", "n_pairs", "n_participants", "n_clusters", "estimate", "ci_lower", "ci_upper")
            out = got if out is None else out.unionByName(got)
        return out

    both = stored(retrieval.both_ranks(table(spark, d, "pair_vectors"), pairs))  # documents and groups in one pass, for the frame and two summaries
    half = stored(_half_encoder(spark, d).drop("n_candidates"))
    first, wanted = retrieval.as_ranks(both), pairs.select("pair_id", "participant_id")
    ranks = stored(intervals({"target_dedup": (*analysis.retrieval_cells(retrieval.as_ranks(both, True), wanted), wanted), "encoder_difference": (*analysis.encoder_cells(first, half, wanted), wanted)}))
    del half
    features, flags = analysis.coverage_flags(pairs.select("pair_id", "participant_id", "pt_word_count").join(_affect(spark, d), "pair_id"))
    features = stored(features.select("pair_id", "participant_id", "pt_word_count", *affect.DISTANCES, *flags))
    scores = pairs.select("pair_id", quality.synthetic_quality(F.col("source_pt"), F.col("translation_en")).alias("score"))
    df = analysis.frame(pairs, retrieval.wide(first), scores, features.select("pair_id", *affect.DISTANCES)).select("pair_id", "participant_id", "pt_word_count", *analysis.METRICS)
    df = stored(df)
    del both, first
    framed = stored(intervals({"both_languages_match": (*analysis.matched_cells(df, _language_flags(spark, d)), df), "length_recall": (*analysis.length_cells(df), df)}))
    del df
    people = features.select("participant_id")
    nonzero = analysis.nonzero_cells(features.withColumns({f"{f}_both_nonzero": F.col(f"{f}_both_nonzero") == 1.0 for f in affect.FAMILIES}))
    covered = (sensitivity.with_bands(features), ["stratum_type", "stratum_value"], flags)
    return stored(intervals({"affect_nonzero": (*nonzero, people), "affect_coverage": (*covered, people)})).unionByName(ranks).unionByName(framed)


@query("""WITH lv AS (SELECT DISTINCT * FROM language_verification), jj AS (SELECT coalesce(pt_matches_expected, false) AS pm, coalesce(en_matches_expected, false) AS em, coalesce(pt_ambiguous, false) AS pa, coalesce(en_ambiguous, false) AS ea FROM paired_responses JOIN lv USING (pair_id)),"""
       + _BASE + ", " + _affect_sql() + """,
    cd AS (SELECT direction, count(DISTINCT grp) AS n FROM u GROUP BY 1) SELECT 'paired_rows' AS name, count(*) AS actual FROM aff UNION ALL SELECT 'emotion_both_nonzero_pairs', count_if(emotion_both_nonzero) FROM aff
    UNION ALL SELECT 'emotion_both_nonzero_clusters', count(DISTINCT participant_id) FILTER (emotion_both_nonzero) FROM aff UNION ALL SELECT 'valence_both_nonzero_pairs', count_if(valence_both_nonzero) FROM aff
    UNION ALL SELECT 'pt_nodes_zero', count_if(pt_n = 0) FROM aff UNION ALL SELECT 'en_nodes_zero', count_if(en_n = 0) FROM aff
    UNION ALL SELECT 'pt_emotion_coverage_profile_disagreement', count_if((pt_emotion_coverage > 0) <> (list_sum(pt_emotion) > 0)) FROM aff UNION ALL SELECT 'en_emotion_coverage_profile_disagreement', count_if((en_emotion_coverage > 0) <> (list_sum(en_emotion) > 0)) FROM aff
    UNION ALL SELECT 'language_both_expected', count_if(pm AND em) FROM jj UNION ALL SELECT 'language_ambiguous_only', count_if(NOT (pm AND em) AND NOT (NOT pm AND NOT pa) AND NOT (NOT em AND NOT ea)) FROM jj
    UNION ALL SELECT 'language_explicit_mismatch', count_if((NOT pm AND NOT pa) OR (NOT em AND NOT ea)) FROM jj
    UNION ALL SELECT 'target_candidates_' || direction, n FROM cd""")
def acceptance_report(spark: SparkSession, d: str) -> DataFrame:
    """The thirteen named counts of a run."""
    df = _pairs(spark, d).select("pair_id", "participant_id", "pt_word_count").join(_affect(spark, d), "pair_id")
    return analysis.named_counts(df, _verified(spark, d), candidate_counts(spark, d))


# --- ridge on the eight predictors ------------------------------------------------------------------------------------

_DESIGN = [m if m != "log1p_pt_word_count" else "ln(1 + pt_word_count)" for m in analysis.DESIGN]


@query(_FRAME + ", x AS (SELECT cohort_id, " + ", ".join(f"({e})::DOUBLE AS x{i}" for i, e in enumerate([*_DESIGN, "score"])) + " FROM fr) SELECT cohort_id AS cohort, count(*) AS n, " + ", ".join(
    [f"round(sum(x{i}), 4) AS s_{i}" for i in range(9)] + [f"round(sum(x{i} * x{j}), 4) AS ss_{i}_{j}" for i in range(9) for j in range(i, 9)]) + " FROM x GROUP BY 1")
def design_gram(spark: SparkSession, d: str) -> DataFrame:
    """Sufficient statistics of the eight predictors and the score, by cohort."""
    g = ridge.gram_table(_design(spark, d), "cohort_id", list(analysis.DESIGN), "score")
    return g.select("cohort", "n", *[F.round(f"s_{i}", 4).alias(f"s_{i}") for i in range(9)], *[F.round(f"ss_{i}_{j}", 4).alias(f"ss_{i}_{j}") for i in range(9) for j in range(i, 9)])


def _design(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d).withColumn("log1p_pt_word_count", F.log1p(F.col("pt_word_count").cast("double")))


@query()
def score_validation(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-cohort-out ridge of the score on the eight predictors, penalty chosen inside the training cohorts."""
    df = _design(spark, d)
    splits = curation.splits_leave_one_out(df.select("participant_id", "cohort_id").distinct(), [r.cohort_id for r in df.select("cohort_id").distinct().collect()])  # cohorts are few
    ridge.assert_folds(df, splits, "cohort_id")
    return ridge.leave_one_cohort_out(df, "cohort_id", list(analysis.DESIGN), "score")[1]
