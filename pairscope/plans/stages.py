"""The engine's stages: curate, verify languages, embed, score, profile, analyse, sensitivity.

Each stage reads the tables of the stages it needs, after their seals are checked, and nothing else but the cohort's raw records. Its own tables are
written once, in the order of their keys, without texts (but for the cohort), with checked keys. Tables lie below ``tables_root``, a folder
that all executors share; without one, in the run's own folder, which only a local session may do.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope import queries_reference as q
from pairscope.contracts import assert_no_text, audit
from pairscope.functions import embeddings, language, quality
from pairscope.operators import affect, analysis, curation, retrieval, ridge, sensitivity
from pairscope.plans.cohort import curate
from pairscope.plans.runs import RunWorkspace, StageRegistry
from pairscope.session import table
from pairscope.sources.tables import tree_digests, write_json_once, write_small_csv, write_sorted

REPORTS = frozenset({"strata", "coverage", "matched", "length_recall", "target_dedup", "encoder_differences", "affect_nonzero", "affect_coverage", "acceptance", "validation"})
ENCODERS = {"embeddings": 1729, "embeddings_second": 2718}


@dataclass
class Inputs:
    """What a stage may read: source tables of the data directory and sealed tables of the stages before it."""

    spark: SparkSession
    data: str
    upstream: dict[str, Path]
    repetitions: int

    def source(self, name: str) -> DataFrame:
        return table(self.spark, self.data, name)

    def made(self, stage: str, name: str) -> DataFrame:
        paths = json.loads((Path(self.upstream[stage]) / "artifacts" / "tables.json").read_text())
        return self.spark.read.parquet(paths[name]["path"])


Outputs = dict[str, tuple[DataFrame, list[str]]]  # table -> (rows, unique keys, which are also their order)


def raw_records(i: Inputs) -> DataFrame:
    """Ingested records with the texts of their pairs; records without a pair have no text and fall out of the selection."""
    pairs = i.source("paired_responses").select("pair_id", "cohort_id", "question_index", "prompt_family", "source_pt", "translation_en")
    lineage = i.source("lineage").select("pair_id", "source_record_id", "respondent_key_sha256", "batch_no", "methodology", "sector")
    return curation.attach_lineage(lineage, pairs)


def prepare_cohort(i: Inputs) -> Outputs:
    cohorts = {r.cohort_id: r.year for r in i.source("prompts").select("cohort_id", "year").distinct().collect()}  # twelve prompts
    made = curate(raw_records(i), cohorts, competing="keep")
    rows = curation.source_rows(made["paired"].select("cohort_id", "participant_id", "question_index", "pair_id"), ["cohort_id", "participant_id", "question_index", "pair_id"]).select("pair_id", F.col("source_row").cast("long"))
    return {"paired": (made["paired"].join(rows, "pair_id"), ["pair_id"]), "participants": (made["participants"], ["participant_id"]), "prompts": (made["prompts"], ["prompt_id"]),
            "splits": (made["splits"], ["participant_id", "fold_id"]), "lineage": (made["lineage"].distinct(), ["source_record_id", "pair_id"])}


def _texts(i: Inputs) -> DataFrame:
    return i.made("prepare_cohort", "paired").select("pair_id", "source_row", "source_pt", "translation_en")


def validate_languages(i: Inputs) -> Outputs:
    """Built-in detector on both texts; an undecided text is ambiguous, no row is removed."""
    df = _texts(i).select("pair_id", language.stop_word_predicted(F.col("source_pt")).alias("pt_predicted"), language.stop_word_predicted(F.col("translation_en")).alias("en_predicted"))
    df = language.verification_flags(language.verification_flags(df, "pt_predicted", "pt", "pt"), "en_predicted", "en", "en")
    return {"flags": (df, ["pair_id"])}


def compute_embeddings(i: Inputs) -> Outputs:
    """Vectors of both directions by the deterministic backend, with two seeds as two encoders."""
    out: Outputs = {}
    for name, seed in ENCODERS.items():
        out[name] = (embeddings.embed_pairs(_texts(i), lambda seed=seed: embeddings.SyntheticBackend(64, seed), 64), ["pair_id", "direction"])
    return out


def estimate_translation_quality(i: Inputs) -> Outputs:
    return {"quality": (_texts(i).select("pair_id", quality.synthetic_quality(F.col("source_pt"), F.col("translation_en")).alias("score")), ["pair_id"])}


def compute_emotion_features(i: Inputs) -> Outputs:
    return {"features": (affect.pair_features(_texts(i), q.demonstration_lexicon(i.spark)), ["pair_id"])}


def _ranks(i: Inputs, encoder: str = "embeddings", dedup: bool = False) -> DataFrame:
    vectors = i.made("compute_embeddings", encoder)
    pairs = i.made("prepare_cohort", "paired")
    retrieval.assert_aligned(vectors, pairs)
    return retrieval.retrieval_ranks(vectors, pairs, dedup=dedup)


def analyze(i: Inputs) -> Outputs:
    pairs = i.made("prepare_cohort", "paired")
    ranks = _ranks(i)
    frame = analysis.frame(pairs, retrieval.wide(ranks), i.made("estimate_translation_quality", "quality"), i.made("compute_emotion_features", "features"), check=True)
    ridge.assert_folds(frame, i.made("prepare_cohort", "splits"), "cohort_id")
    design = frame.withColumn("log1p_pt_word_count", F.log1p(F.col("pt_word_count").cast("double")))
    predictions, metrics = ridge.leave_one_cohort_out(design, "cohort_id", list(analysis.DESIGN), "score")
    rows, keys, names = analysis.strata_cells(frame)
    return {"dataset": (frame, ["pair_id"]), "ranks": (ranks, ["pair_id", "direction"]), "strata": (analysis.with_intervals(rows, keys, names, frame, "strata", i.repetitions, q.SEED), [*keys, "metric"]),
            "predictions": (ridge.assert_predicted_once(predictions.select("pair_id", "cohort_id", "predicted", "alpha"), frame), ["pair_id"]), "validation": (metrics, ["cohort_id"])}


def sensitivity_analysis(i: Inputs) -> Outputs:
    pairs, frame = i.made("prepare_cohort", "paired"), i.made("analyze", "dataset")
    flags = sensitivity.language_flags(i.made("validate_languages", "flags"))
    verified = pairs.join(flags, "pair_id")
    grouped = _ranks(i, dedup=True)
    first = i.made("analyze", "ranks")
    worse = first.select("pair_id", "direction", F.col("retrieval_rank").alias("_r")).join(grouped, ["pair_id", "direction"]).filter(F.col("retrieval_rank") > F.col("_r"))
    cells = {
        "matched": (*analysis.matched_cells(frame, flags), frame), "length_recall": (*analysis.length_cells(frame), frame), "target_dedup": (*analysis.retrieval_cells(grouped, pairs), pairs),
        "encoder_differences": (*analysis.encoder_cells(first, _ranks(i, "embeddings_second"), pairs), pairs), "affect_nonzero": (*analysis.nonzero_cells(frame), frame), "affect_coverage": (*analysis.coverage_cells(frame), frame),
        "coverage": (*sensitivity.flag_cells(verified), verified),
    }
    out: Outputs = {n: (analysis.with_intervals(rows, keys, names, universe, n, i.repetitions, q.SEED), [*keys, "metric"]) for n, (rows, keys, names, universe) in cells.items()}
    candidates = grouped.groupBy("direction").agg(F.max("n_candidates").alias("n_groups"))
    return out | {"acceptance": (analysis.named_counts(frame, verified, candidates), ["name"]), "dedup_worse": (worse.select("pair_id", "direction"), ["pair_id", "direction"])}


#: Stage -> (function, stages it needs)
PLAN: dict[str, tuple[Callable[[Inputs], Outputs], tuple[str, ...]]] = {
    "prepare_cohort": (prepare_cohort, ()),
    "validate_languages": (validate_languages, ("prepare_cohort",)),
    "compute_embeddings": (compute_embeddings, ("prepare_cohort", "validate_languages")),
    "estimate_translation_quality": (estimate_translation_quality, ("prepare_cohort", "validate_languages")),
    "compute_emotion_features": (compute_emotion_features, ("prepare_cohort", "validate_languages")),
    "analyze": (analyze, ("prepare_cohort", "compute_embeddings", "estimate_translation_quality", "compute_emotion_features")),
    "sensitivity_analysis": (sensitivity_analysis, ("prepare_cohort", "validate_languages", "compute_embeddings", "analyze")),
}


def registry(spark: SparkSession, data: str, tables_root: str | None = None, repetitions: int = q.REPETITIONS) -> StageRegistry:
    """Stages bound to a session and a data directory."""
    if tables_root is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("tables_root must name a folder that all executors share")
    out = StageRegistry()
    for name, (work, needs) in PLAN.items():

        def stage(run: RunWorkspace, upstream: dict[str, Path], name: str = name, work: Callable[[Inputs], Outputs] = work) -> dict:
            counts, paths = {}, {}
            for need in upstream.values():
                verify_tables(spark, need)
            for made, (rows, keys) in work(Inputs(spark, data, upstream, repetitions)).items():
                target = f"{tables_root.rstrip('/')}/{run.root.name}/{made}" if tables_root else str(run.root / "tables" / made)
                write_sorted(rows if name == "prepare_cohort" else assert_no_text(rows), target, keys)
                written = spark.read.parquet(target)
                audit(written, keys=None if made == "lineage" else keys)
                if made in REPORTS:
                    write_small_csv(written, str(run.root / "artifacts" / f"{made}.csv"), order=keys)
                digests = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in tree_digests(spark, target).collect()}  # one row a file
                paths[made] = {"path": target, "sha256": digests}
                counts[made] = written.count()
                run.checkpoints.write("table_written", {"table": made, "rows": counts[made]})
            write_json_once(run.root / "artifacts" / "tables.json", paths)
            return counts

        out.register(name, needs)(stage)
    return out


def verify_tables(spark: SparkSession, root: str | Path) -> None:
    """Raise unless the files of a run's tables, wherever they lie, are those it wrote."""
    for name, entry in json.loads((Path(root) / "artifacts" / "tables.json").read_text()).items():
        have = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in tree_digests(spark, entry["path"]).collect()}
        if have != entry["sha256"]:
            raise ValueError(f"table {name} does not match the run")
