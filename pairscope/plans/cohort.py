"""A curated cohort from raw records: selection, normalisation, duplicates, hashed ids, complete groups, lineage, splits.

Nothing is joined that an expression can say: ids are hashes of the keys, so a record knows its pair. Counts combine on the map side,
and group sizes are joined with hot groups apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.contracts import ContractError
from pairscope.functions import ids, text
from pairscope.operators import curation

RECORD_KEYS = ["cohort_id", "respondent_key_sha256", "question_index", "normalized_pt", "normalized_en"]
PAIRED = [
    "pair_id", "participant_id", "cohort_id", "year", "question_index", "prompt_id", "prompt_family", "source_pt", "translation_en", "pt_word_count", "en_word_count", "exact_normalized_copy",
    "pt_duplicate_group_id", "pt_duplicate_group_size", "en_duplicate_group_id", "en_duplicate_group_size", "ingestion_record_count", "translation_variant_count",
]


def curate(raw: DataFrame, cohorts: dict[str, int], questions: tuple[int, ...] = (1, 2, 3), same: dict[str, str] | None = None, competing: str = "error") -> dict[str, DataFrame]:
    """Tables ``paired``, ``participants``, ``prompts``, ``splits`` and ``lineage``.

    ``raw``: source_record_id, cohort_id, respondent_key_sha256, question_index, prompt_family, source_pt, translation_en and whatever lineage
    columns come along. ``cohorts``: cohort -> year. ``same``: columns that must equal a value, such as the language. Blank texts are left out.
    Several translations of one response are an error, unless ``competing`` is "keep". Of records with the same keys the one of smallest id is kept. Participants who did not answer every question are left out.
    """
    chosen = text.conjunctive_filter(raw, {"cohort_id": sorted(cohorts), "question_index": list(questions)}, same or {}, ["source_pt", "translation_en"])
    chosen = chosen.withColumn("normalized_pt", text.normalize_for_qc(F.col("source_pt"))).withColumn("normalized_en", text.normalize_for_qc(F.col("translation_en")))
    pair = ids.stable_id("pair", *[F.col(k) for k in RECORD_KEYS])
    counted = curation.attach_counts(chosen, RECORD_KEYS[:4], RECORD_KEYS, "normalized_en")
    if competing == "error" and counted.filter(F.col("translation_variant_count") > 1).limit(1).count():
        raise ContractError("a response has competing translations")
    needed = [*RECORD_KEYS, "source_record_id", "source_pt", "translation_en", "prompt_family", "ingestion_record_count", "translation_variant_count"]
    logical = curation.keep_first(counted.select(*needed), RECORD_KEYS, ["source_record_id"])
    logical = logical.withColumn("pair_id", pair).withColumn("participant_id", ids.stable_id("participant", F.col("cohort_id"), F.col("respondent_key_sha256")))
    logical = curation.complete_groups(logical, ["participant_id"], "question_index", len(questions))
    made = logical.withColumns({
        "prompt_id": F.concat("cohort_id", F.lit("_q"), F.col("question_index").cast("string")), "year": text.strict_map(F.col("cohort_id"), cohorts, "cohort").cast("int"),
        "pt_word_count": text.token_count(F.col("normalized_pt")), "en_word_count": text.token_count(F.col("normalized_en")), "exact_normalized_copy": F.col("normalized_pt") == F.col("normalized_en"),
        "pt_duplicate_group_id": ids.stable_id("pt_duplicate", F.col("normalized_pt")), "en_duplicate_group_id": ids.stable_id("en_duplicate", F.col("normalized_en")),
    })
    for side in ("pt", "en"):
        made = curation.with_group_size(made, [f"{side}_duplicate_group_id"], f"{side}_duplicate_group_size")
    paired = made.select(*PAIRED)
    people = curation.participants(paired)
    rest = [c for c in raw.columns if c not in ("source_pt", "translation_en", "pair_id")]
    kept = paired.select("pair_id", F.lit(True).alias("in_cohort"))
    lineage = chosen.withColumn("pair_id", pair).select("pair_id", *rest).join(kept, "pair_id", "left").withColumn("in_cohort", F.coalesce("in_cohort", F.lit(False)))
    return {"paired": paired, "participants": people, "prompts": curation.prompts(paired), "splits": curation.splits_leave_one_out(people, sorted(cohorts)), "lineage": lineage}
