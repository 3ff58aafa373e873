import json

import pytest
from pyspark.sql import functions as F

from pairscope.contracts import ContractError
from pairscope.plans import runs, stages
from pairscope.plans.cohort import curate
from pairscope.sources import shards, tables
from pairscope.streaming import ingest


def test_run_seals_and_verification_finds_tampering(tmp_path):
    with runs.RunWorkspace(tmp_path / "a", "s", {"runtime": {"shard_size": 5}}) as run:
        run.checkpoints.write("step")
        run.log.info("hello", extra={"fields": {"n": 1}})
        tables.write_json_once(run.root / "artifacts" / "x.json", {"b": 1})
    files = runs.verify_sealed(tmp_path / "a", "s", [tmp_path])
    assert "artifacts/x.json" in files
    with pytest.raises(ValueError):
        runs.verify_sealed(tmp_path / "a", "other", [tmp_path])
    with pytest.raises(ValueError):
        runs.verify_sealed(tmp_path / "a", "s", [tmp_path / "elsewhere"])
    p = tmp_path / "a" / "artifacts" / "x.json"
    p.chmod(0o644)
    p.write_text("{}")
    with pytest.raises(ValueError):
        runs.verify_sealed(tmp_path / "a", "s", [tmp_path])


def test_failed_runs_keep_no_message_and_no_seal(tmp_path):
    with pytest.raises(RuntimeError), runs.RunWorkspace(tmp_path / "b", "s"):
        raise RuntimeError("a private text")
    end = json.loads((tmp_path / "b" / "manifests" / "999_end.json").read_text())
    assert end["status"] == "failed" and "private" not in json.dumps(end) and not (tmp_path / "b" / "seal.json").exists()
    with pytest.raises(FileExistsError):
        runs.RunWorkspace(tmp_path / "b", "s").__enter__()


@pytest.mark.parametrize("config", [{"a": [{"api_key": 1}]}, {"runtime": {"shard_size": 0}}, {"runtime": {"resume": False}}, {"runtime": {"log_text": True}}])
def test_bad_configurations(tmp_path, config):
    with pytest.raises(ValueError):
        runs.RunWorkspace(tmp_path / "c", "s", config).__enter__()


def test_stages_end_to_end(spark, data, tmp_path):
    reg = stages.registry(spark, data, repetitions=50)
    done = {}
    for name, (_, needs) in stages.PLAN.items():
        done[name] = reg.run(name, tmp_path / name, {}, {n: tmp_path / n for n in needs}, [tmp_path])
        runs.verify_sealed(tmp_path / name, name, [tmp_path])
        stages.verify_tables(spark, tmp_path / name)
    n = done["prepare_cohort"]["paired"]
    assert n > 100 and done["validate_languages"]["flags"] == n and done["compute_embeddings"]["embeddings"] == 2 * n == done["analyze"]["ranks"]
    assert done["analyze"]["strata"] % 14 == 0 and done["analyze"]["predictions"] == done["analyze"]["dataset"] == n and done["sensitivity_analysis"]["acceptance"] == 13
    assert done["sensitivity_analysis"]["dedup_worse"] == 0 and done["sensitivity_analysis"]["matched"] == 14
    # what a stage reads is what the one before it wrote
    read = lambda stage, t: spark.read.parquet(json.loads((tmp_path / stage / "artifacts" / "tables.json").read_text())[t]["path"])
    assert {r.pair_id for r in read("analyze", "dataset").collect()} == {r.pair_id for r in read("prepare_cohort", "paired").collect()}
    keys = [r.pair_id for r in read("analyze", "dataset").select("pair_id").collect()]
    rows = (tmp_path / "analyze" / "artifacts" / "strata.csv").read_text().splitlines()
    assert len(keys) == n and rows[1:] == sorted(rows[1:], key=lambda x: tuple(x.split(",")[:2]) + (x.split(",")[rows[0].split(",").index("metric")],))
    with pytest.raises(ValueError):
        reg.register("analyze")(lambda *_: {})
    with pytest.raises(ValueError):
        reg.run("analyze", tmp_path / "x", {})
    assert reg.run("prepare_cohort", tmp_path / "off", {}, execute=False) == {}


def test_tables_in_a_shared_folder_are_verified(spark, data, tmp_path, capsys):
    from pairscope.__main__ import main

    assert main(["list"]) == 0 and "analyze: prepare_cohort" in capsys.readouterr().out
    reg = stages.registry(spark, data, str(tmp_path / "shared"))
    reg.run("prepare_cohort", tmp_path / "prepare_cohort", {})
    stages.verify_tables(spark, tmp_path / "prepare_cohort")
    next((tmp_path / "shared" / "prepare_cohort" / "prompts").glob("*.parquet")).unlink()
    with pytest.raises(ValueError):
        stages.verify_tables(spark, tmp_path / "prepare_cohort")


def _raw(spark, more=()):
    base = [(f"r{u}{i}", "c1" if u < 3 else "c2", f"u{u}", i, "fam", f" texto  {i} ", f"text {i}", "pt") for u in range(5) for i in (1, 2, 3)]
    return spark.createDataFrame([*base, *more], "source_record_id string, cohort_id string, respondent_key_sha256 string, question_index int, prompt_family string, source_pt string, translation_en string, lang string")


def test_a_cohort_from_raw_records(spark):
    more = [("r00a", "c1", "u0", 1, "fam", "texto 1", "text 1", "pt"), ("x1", "c1", "u9", 1, "fam", "só um", "only one", "pt"), ("x2", "c9", "u0", 1, "fam", "a", "b", "pt"), ("x3", "c1", "u8", 1, "fam", "\u00a0", "b", "pt"),
            ("x4", "c1", "u7", 1, "fam", "a", "b", "en"), (None, "c1", None, 2, None, None, None, None)]
    made = curate(_raw(spark, more), {"c1": 2021, "c2": 2024}, same={"lang": "pt"})
    paired = made["paired"].collect()
    assert len(paired) == 15 and {r.year for r in paired} == {2021, 2024} and len({r.pair_id for r in paired}) == 15
    twice = [r for r in paired if r.ingestion_record_count == 2]
    assert len(twice) == 1 and twice[0].source_pt == "texto 1"  # the record of smallest id of the two
    assert {(r.pt_duplicate_group_size, r.pt_word_count) for r in paired} == {(5, 2)} and not any(r.exact_normalized_copy for r in paired)
    assert made["participants"].count() == 5 and made["prompts"].count() == 6 and made["splits"].count() == 10
    lineage = {r.source_record_id: r.in_cohort for r in made["lineage"].collect()}
    assert lineage["r00a"] and lineage["r01"] and not lineage["x1"] and "x2" not in lineage
    competing = [("y", "c1", "u0", 1, "fam", "texto 1", "other words", "pt")]
    with pytest.raises(ContractError):
        curate(_raw(spark, competing), {"c1": 2021, "c2": 2024})
    assert curate(_raw(spark, competing), {"c1": 2021, "c2": 2024}, competing="keep")["paired"].filter("translation_variant_count = 2").count() == 2
    assert curate(_raw(spark).limit(0), {"c1": 2021})["paired"].count() == 0


def test_shards_resume_only_what_matches(spark, tmp_path):
    src = shards.with_shard(spark.range(1700).select(F.col("id").alias("source_row"), F.col("id").cast("string").alias("t")))
    calls = []

    def work(df):
        calls.append(df.count())
        return df.withColumn("y", F.length("t"))

    path = str(tmp_path / "out")
    first = shards.run_shards(spark, src.filter("source_row < 1000"), ["t"], "m1", work, path, 1)
    assert first.count() == 1000
    second = shards.run_shards(spark, src, ["t"], "m1", work, path, 2)
    assert second.count() == 1700 and calls == [1000, 700]
    third = shards.run_shards(spark, src.withColumn("t", F.when(F.col("source_row") == 3, "changed").otherwise(F.col("t"))), ["t"], "m1", work, path, 3)
    assert calls[-1] == 500 and third.filter("source_row = 3").first().y == 7 and third.count() == 1700
    shards.assert_continuous(shards.fingerprints(src, ["t"], "m"), 1700)
    with pytest.raises(ContractError):
        shards.assert_continuous(shards.fingerprints(src.filter("source_row <> 5"), ["t"], "m"), 1700)


def test_snapshots_and_exclusive_writes(spark, tmp_path):
    df = spark.range(10).repartition(3)
    path = str(tmp_path / "snap")
    tables.write_exclusive(df, path)
    assert tables.read_snapshot(spark, path, files=3).count() == 10 and tables.probe(spark, path)[0] == 10
    with pytest.raises(FileNotFoundError):
        tables.read_snapshot(spark, path, files=4)
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_exclusive(df, path)
    assert tables.tree_digests(spark, path).filter("path like '%.parquet'").count() == 3
    tables.write_small_csv(df.select((F.col("id") / 3).alias("x")), str(tmp_path / "x.csv"))
    assert "0.33333333" in (tmp_path / "x.csv").read_text()


def test_stream_curates_each_record_once_and_goes_on(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    df = spark.createDataFrame([("r1", " A  b "), ("r1", " A  b "), ("r2", None)], "rec string, text string").withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    df.coalesce(1).write.mode("append").parquet(landing)
    stream = lambda: ingest.curate(ingest.read_landing(spark, landing, df.schema), "text", "at", ["rec"])
    ingest.run_available(stream(), out, check).awaitTermination()
    df.limit(1).withColumn("rec", F.lit("r3")).coalesce(1).write.mode("append").parquet(landing)
    ingest.run_available(stream(), out, check).awaitTermination()
    got = sorted((r.rec, r.normalized, r.word_count) for r in spark.read.parquet(out).collect())
    assert [g[0] for g in got] == ["r1", "r2", "r3"] and got[0][1:] == ("A b", 2)


def test_stream_drops_no_late_record(spark, tmp_path):
    landing = str(tmp_path / "in")
    schema = "rec string, text string, g string, at timestamp"
    curated = lambda: ingest.curate(ingest.read_landing(spark, landing, spark.createDataFrame([], schema).schema), "text", "at", ["rec"])
    counted = lambda: ingest.counts_by_window(ingest.read_landing(spark, landing, spark.createDataFrame([], schema).schema, 1), "at", "g")
    for rec, at in (("r1", "2024-06-01"), ("r2", "2024-06-02"), ("r3", "2021-01-01"), ("r1", "2020-01-01")):
        spark.createDataFrame([(rec, "a", "x", at)], "rec string, text string, g string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(landing)
        ingest.run_available(curated(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.rec for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["r1", "r2", "r3"]
    ingest.run_available(counted(), str(tmp_path / "counts"), str(tmp_path / "c2"), "complete").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "counts")).agg(F.sum("n_records")).first()[0] == 4
