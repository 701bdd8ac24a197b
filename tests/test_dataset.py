"""The canonical dataset and model runs as files: what is refused, and why."""

import json

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import canonical, ensemble, finalize, integrity
from tallyweave.sources import dataset, files, sinks


def _tables(spark, **change):
    assays = spark.createDataFrame([("a", "ACD:EF", "x;y", "A1C", 0.5)], "assay_id string, wildtype_sequence string, a3m_relative_path string, anchor_mutant string, anchor_dms_score double")
    queries = spark.createDataFrame([("T3", "q", "a")], "task string, query_id string, source_assay string")
    pool = spark.createDataFrame([(1, "q", "C2A:E4A", None), (2, "q", "D3E", None)], "row_id int, candidate_group_id string, mutant string, mutated_sequence string")
    sampled = canonical.samples(canonical.parsed(canonical.distinct_pool(pool, queries, assays)), "d")
    anchors = canonical.provided_context(queries, assays)
    shown = canonical.samples(canonical.parsed(anchors.join(assays.select(F.col("assay_id").alias("source_assay"), "wildtype_sequence"), "source_assay")), "d", canonical.ANCHOR)
    plain = lambda df: df.drop("components", "wildtype_sequence", "bounds")
    return {
        "proteins": canonical.proteins(assays), "samples": plain(sampled), "substitution_components": canonical.substitutions(sampled), "queries": queries.withColumn("expected_samples", F.lit(2)),
        "context_samples": plain(shown), "context_substitution_components": canonical.substitutions(shown), "provided_context_rows": anchors, "msa_contexts": canonical.msa_contexts(assays),
    } | {k: f(sampled, shown) for k, f in change.items()}


def test_dataset_round_trip_and_what_is_refused(spark, tmp_path):
    good = f"{tmp_path}/good"
    told = dataset.write_dataset(spark, _tables(spark), good, "d")
    manifest, tables = dataset.read_dataset(spark, good)
    assert manifest == told and {k: t.count() for k, t in tables.items()} == {k: told[k] for k in dataset.TABLES}
    assert dict(tables["samples"].dtypes)["mutation_count"] == "int" and told["samples"] == 2 and told["substitution_components"] == 3
    with pytest.raises(Exception, match="(?i)exist"):
        dataset.write_dataset(spark, _tables(spark), good, "d")
    file = next((tmp_path / "good/queries.csv").glob("part-*"))
    before = file.read_text()
    for p in file.parent.glob(".*.crc"):
        p.unlink()
    file.write_text(before.replace("q", "r"))
    with pytest.raises(integrity.IntegrityError, match="files"):
        dataset.read_dataset(spark, good)
    file.write_text(before)
    for key, value, why in (("samples", 3, "count"), ("status", "open", "frozen")):
        (tmp_path / "good/dataset.json").write_text(json.dumps(told | {key: value}))
        for p in (tmp_path / "good").glob(".*.crc"):
            p.unlink()
        with pytest.raises(integrity.IntegrityError, match=why):
            dataset.read_dataset(spark, good)


@pytest.mark.parametrize("name, change, why", [
    ("queries", lambda s, c: s.select("task", "query_id", "source_assay", F.lit(3).alias("expected_samples")).distinct(), "query_size"),
    ("msa_contexts", lambda s, c: s.select(F.lit("x").alias("context_sha256"), F.lit(1).alias("sequence_length")).limit(1), "msa_coverage"),
    ("context_samples", lambda s, c: s.drop("components", "wildtype_sequence", "bounds"), "roles_disjoint"),
])
def test_dataset_rules(spark, name, change, why):
    assert why in {r["rule"] for r in dataset.rules(_tables(spark, **{name: change})).collect()}


def test_final_rules(spark):
    columns = "sample_id string, subset string, candidate_group_id string, source_assay string, mutant string, status string, x string"
    rows = [("s1", "T2", "q", "a", "m1", "ok", "1"), ("s1", "T2", "q", "a", "m1", "ok", "2"), ("c", "T3", "q3", "a", "w", "ok", "5")]
    expected = spark.createDataFrame([("s1", "T2", "q", "a", "m1", "evaluation_candidate"), ("c", "T3", "q3", "a", "w", "anchor_context")], "sample_id string, task string, query_id string, source_assay string, mutant string, sample_role string")
    queries = spark.createDataFrame([("T2", "q", 1)], "task string, query_id string, expected_samples int")

    def broken(rows):
        raw = spark.createDataFrame(rows, columns)
        results = finalize.finalised(raw, ["x"])
        return {r["rule"] for r in finalize.final_rules(raw, results, expected, queries, ["x"]).collect()}, results

    found, results = broken(rows)
    assert found == set() and {(r["sample_id"], r["x"], r["n_chains"]) for r in results.collect()} == {("s1", 3.0, 2), ("c", 5.0, 1)}
    assert broken([*rows[:2], ("c", "T3", "q3", "a", "w", "failed", "nan")])[0] == {"status_ok", "finite_outputs"}
    assert broken([rows[0], ("s1", "T2", "q", "a", "m2", "ok", "2"), rows[2]])[0] == {"identity_agrees"}
    assert broken(rows[:2])[0] == {"coverage"} and broken([*rows, ("y", "T2", "q", "a", "m", "ok", "1")])[0] == {"coverage"}
    assert broken([("s1", "T2", "q", "b", "m1", "ok", "1"), rows[2]])[0] == {"same_fields"}


def test_shards_without_rows_and_their_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, 1.5), ("a", 2, 0.5), ("c", 0, 1.0)], "sample_id string, k int, x double")
    dataset.write_shards(rows, f"{tmp_path}/s", "k", 3, ["sample_id", "x"], {"dataset_id": "d", "dataset_hash": "h"}, {"model_id": "m"})
    assert (tmp_path / "s/shard_0002.csv").read_text() == "sample_id,x\na,0.5\nb,1.5\n" and (tmp_path / "s/shard_0001.csv").read_text() == "sample_id,x\n"
    got = files.shards(spark, f"{tmp_path}/s", ["sample_id", "x"], dataset={"dataset_id": "d", "dataset_hash": "h"})
    assert sorted(r["sample_id"] for r in got.collect()) == ["a", "b", "c"] and not (tmp_path / "s/.unsorted").exists()


def test_ensembles(spark):
    raw = spark.createDataFrame([("A", 1.0, 3.0), ("B", -1.0, 0.0), ("wt", 0.0, 0.0)], "mutant string, s0 double, s1 double")
    scores = ensemble.seed_scores(raw, ["s0", "s1"])
    want = spark.createDataFrame([("A",), ("B",)], "mutant string")
    assert {(r["mutant"], r["ensemble"], r["score_s1"]) for r in scores.collect()} == {("A", -2.0, -3.0), ("B", 0.5, -0.0)}
    rules = lambda s, w=want: {r["rule"] for r in ensemble.seed_rules(s, w, ["s0", "s1"], ["mutant"]).collect()}
    assert rules(scores) == set() and rules(scores, want.limit(1)) == {"score_set"} and rules(scores.union(scores)) == {"score_unique"}
    assert rules(scores.withColumn("ensemble", F.col("mean_raw"))) == {"score_mean"} and rules(scores.withColumn("score_s0", F.col("s0"))) == {"score_sign"}
    chains = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A")], "sample_id string, mutant string")
    from_two = scores.withColumn("code", F.when(F.col("mutant") == "A", 0).otherwise(1))
    assert {(r["sample_id"], r["ensemble"]) for r in ensemble.summed_over_chains(chains, scores, ["mutant"], ["ensemble"]).collect()} == {("x", -1.5), ("y", -2.0)}
    for sample, told, why in ((chains, from_two, "different sources"), (chains.union(spark.createDataFrame([("z", "C")], chains.schema)), from_two.withColumn("code", F.lit(0)), "no score")):
        with pytest.raises(Exception, match=why):
            ensemble.summed_over_chains(sample, told, ["mutant"], ["ensemble"], "code").collect()
    with pytest.raises(integrity.IntegrityError, match="same_keys"):
        ensemble.one_to_one(want, want.limit(1), "mutant")
    rows = spark.createDataFrame([("g", 1.0, "evaluation_candidate"), ("g", 3.0, "evaluation_candidate"), ("g", 5.0, "anchor_context")], "g string, v double, role string")
    got = sorted(r["combined"] for r in ensemble.combined(rows, ["g"], ["v"], "role").collect())
    assert got == pytest.approx([-0.70710678, 0.70710678, 2.12132034])
    with pytest.raises(Exception, match="no deviation"):
        ensemble.combined(rows.withColumn("v", F.lit(1.0)), ["g"], ["v"], "role").collect()


def test_flat_summary():
    row = sinks.summary_row("T2", {"num_assays": 1, "num_queries": 2, "num_target_cases": 2, "lenient": 1}, {"NMS@5": 0.5}, {"missing": 0, "random_replacement_cases": 1, "skipped_cases": 0})
    assert list(row) == ["setting", "num_assays", "num_queries", "num_target_cases", "lenient", "random_replacement_cases", "skipped_cases", "NMS@5", "missing"]
