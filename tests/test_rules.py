"""Rules on caches, structures, weights, contexts and released runs; small expressions."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import windows
from tallyweave.operators import geometry, integrity, responses
from tallyweave.sources import cache


def _names(df):
    return {r["rule"] for r in df.collect()}


def test_cache(spark, tmp_path):
    folder, about = f"{tmp_path}/cache", {"format": 1, "config": "c", "tokens": ["A", "C"]}
    sequences = spark.createDataFrame([("h", "ACA")], "context_sha256 string, sequence string")
    needed = spark.createDataFrame([("h", 1), ("h", 2), ("h", 2)], "context_sha256 string, position int")
    calls = []

    def compute(lacking):
        calls.append(lacking.count())
        return lacking.withColumn("values", F.when(F.col("position") == 2, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(2.0))))

    run = lambda need, told=about: cache.extend(spark, folder, told, need, compute, sequences, 2, {"A": 0, "C": 1})
    assert cache.open_cache(spark, folder, about) is None and run(needed) == {"required": 2, "computed": 2, "reused": 0}
    assert run(needed.union(spark.createDataFrame([("h", 3)], needed.schema))) == {"required": 3, "computed": 1, "reused": 2} and calls == [2, 1]
    with pytest.raises(cache.CacheError, match="config"):
        run(needed, about | {"config": "d"})
    assert cache.open_cache(spark, folder, about).count() == 3
    bad = lambda rows: _names(cache.cache_rules(spark.createDataFrame(rows, "context_sha256 string, position int, values array<double>"), sequences, 2, {"A": 0, "C": 1}))
    assert bad([("h", 1, [0.0, 1.0])]) == set() and bad([("h", 1, [0.0, 1.0])] * 2) == {"cache_unique"} and bad([("x", 1, [0.0, 1.0])]) == {"cache_context"}
    assert bad([("h", 4, [0.0, 0.0])]) == {"cache_position", "cache_wild_type"} and bad([("h", 1, [0.0])]) == {"cache_width"}
    assert bad([("h", 1, [0.0, float("inf")])]) == {"cache_finite"} and bad([("h", 2, [0.0, 1.0])]) == {"cache_wild_type"}


def test_structures_weights_contexts(spark):
    need = spark.createDataFrame([("h", "AC"), ("i", "D")], "context_sha256 string, sequence string")
    found = spark.createDataFrame([("p", "AC", True, "d"), ("q", "E", True, "e")], "path string, sequence string, sound boolean, digest string")
    rows = [("h", "p", "ready", 2, "d"), ("i", "q", "ready", 1, "e")]
    rules = lambda rows: _names(integrity.structure_rules(spark.createDataFrame(rows, "context_sha256 string, path string, structure_status string, sequence_length int, digest string"), need, found))
    assert rules(rows) == {"structure_sequence"} and rules(rows[:1]) == {"structure_coverage"} and "structure_unique" in rules([rows[0], *rows])
    assert rules([("h", "p", "open", 3, "x"), rows[1]]) == {"structure_ready", "structure_length", "structure_digest", "structure_sequence"}
    weights = spark.createDataFrame([("h", 0.5), ("h", 1.5), ("i", -1.0)], "context_sha256 string, weight double")
    totals = spark.createDataFrame([("h", 2.0), ("i", -1.0), ("j", 1.0)], "context_sha256 string, neff double")
    assert sorted((r["rule"], r["key"]) for r in integrity.weight_rules(weights, totals).collect()) == [("weight_positive", "i"), ("weight_sum", "i"), ("weight_sum", "j")]
    made = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "context_id string, n_samples int")
    assert _names(integrity.context_rules(made, spark.createDataFrame([("a", 1), ("b", 3)], made.schema))) == {"context_unique", "context_samples"}
    variants = spark.createDataFrame([("h", "A1C", "CC"), ("h", "A1C", "CC"), ("h", "A1D", "DC"), ("h", "A1D", "DD")], "context_sha256 string, variant_key string, sequence string")
    assert [r["key"] for r in integrity.one_sequence(variants).collect()] == ["h|A1D"]


def test_released_runs(spark):
    results = spark.createDataFrame([("s", "T2", "q", "evaluation_candidate", "ok", 1.0)], "sample_id string, task string, query_id string, sample_role string, status string, x double")
    told = spark.createDataFrame([("T2", 1, 1, 0.5)], "task string, samples bigint, queries bigint, nms double")
    per = spark.createDataFrame([("T2", "q")], "task string, assay string")
    summaries = spark.createDataFrame([("T2", 0, 0, 0.5)], "task string, missing int, unknown int, nms double")
    rules = lambda a=results, b=told, c=per, d=summaries: _names(integrity.released_rules(a, b, c, d, ["x"], ["nms"]))
    assert rules() == set()
    assert rules(results.union(results)) == {"released_unique", "released_samples"} and rules(results.withColumn("status", F.lit("failed"))) == {"released_status"}
    assert rules(results.withColumn("x", F.lit(float("nan")))) == {"released_finite"} and rules(c=per.withColumn("assay", F.lit("r"))) == {"released_metrics"}
    assert rules(d=summaries.withColumn("missing", F.lit(1))) == {"released_coverage"} and rules(d=summaries.withColumn("nms", F.lit(0.4))) == {"released_values"}
    assert rules(b=told.withColumn("queries", F.lit(2))) == {"released_queries"} and "released_tasks" in rules(b=told.withColumn("task", F.lit("T3")))


def test_small_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(windows.scorable_chunks(F.lit("abcde"), 3)) == ["abc", "de"]
    with pytest.raises(Exception, match="too short"):
        one(windows.scorable_chunks(F.lit("abcd"), 3))
    assert one(responses.numbered_lines(F.array(F.lit("A"), F.lit("B")))) == "1. A\n2. B" and one(responses.scored_lines(F.array(F.lit("A")), F.array(F.lit("0.5")))) == "A: 0.5"
    assert one(geometry.radial(F.lit(0.5), 0.0, 1.0, 3))[1] == 1.0 and one(geometry.positional(F.lit(0), 4)) == [1.0, 1.0, 0.0, 0.0]
    assert one(responses.prompted(F.lit("T9"), {k: F.lit("") for k in ("wt", "k", "readout", "n", "anchor", "singles")})) is None


@pytest.mark.parametrize("text, want", [
    ('{"ranking": [" A ", "", 1, null]}', ["A", "1", "None"]), ('```json\n{"ranking": ["A"]}\n```', ["A"]), ('so {"ranking": ["A"]} it is', ["A"]), ('{"a": 1} and {"ranking": ["A"]}', []),
    ("[1]", []), ("{'ranking': ['A']}", []), ("none", []), ("", []), (None, []), ('{"ranking": null}', []),
])
def test_greedy_json(text, want):
    assert responses._greedy(text) == want
