"""Queries that write files in the shared folder and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators import canonical, contexts, ensemble, finalize, integrity, scoring
from tallyweave.plans.common import r6, sql_r6, truth_rows
from tallyweave.plans.preparation import _ANCHORS, _MUTATED, _POOL, _SUBS, DATASET, _parse, _samples
from tallyweave.session import cut, scratch_path, table
from tallyweave.sources import dataset, files, sinks

_SAMPLE = ["sample_id", "task", "query_id", "source_assay", "sample_role", "mutant", "model_mutant", "mutation_count", "wt_id", "sequence_sha256", "mutated_sequence"]
_OUTPUTS = ["score", "evolution"]


def _canonical(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The eight tables; queries have the number of samples they really have."""
    assays = table(spark, d, "assays")
    sampled = cut(_samples(spark, d))
    anchors = canonical.provided_context(table(spark, d, "queries"), assays)
    wild = assays.select(F.col("assay_id").alias("source_assay"), "wildtype_sequence")
    shown = cut(canonical.samples(canonical.parsed(anchors.join(F.broadcast(wild), "source_assay")), DATASET, canonical.ANCHOR).dropDuplicates(["sample_id"]))
    sizes = sampled.groupBy("task", "query_id", "source_assay").agg(F.count(F.lit(1)).cast("int").alias("expected_samples"))
    return {
        "proteins": canonical.proteins(assays), "samples": sampled.select(*_SAMPLE), "substitution_components": canonical.substitutions(sampled), "queries": sizes,
        "context_samples": shown.select(*_SAMPLE), "context_substitution_components": canonical.substitutions(shown), "provided_context_rows": anchors,
        "msa_contexts": canonical.msa_contexts(assays),
    }


def _written(spark: SparkSession, d: str) -> tuple[dict, dict[str, DataFrame]]:
    folder = scratch_path(spark, "dataset")
    dataset.write_dataset(spark, _canonical(spark, d), folder, DATASET)
    return dataset.read_dataset(spark, folder)


def d_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table of the canonical dataset after it was written, read back and checked."""
    manifest, tables = _written(spark, d)
    return spark.createDataFrame([(k, manifest[k], tables[k].count()) for k in dataset.TABLES], "name string, n_told bigint, n_rows bigint")


def d_finalised(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in model's chain rows, written as shards, read back, made final: samples and scores by task and role."""
    _, t = _written(spark, d)
    expected = t["samples"].select(*_SAMPLE).unionByName(t["context_samples"].select(*_SAMPLE))
    subs = t["substitution_components"].unionByName(t["context_substitution_components"])
    part = F.struct(F.col("wt_aa").alias("wt"), F.col("global_position").alias("pos"), F.col("mut_aa").alias("alt"))
    chains = subs.groupBy("sample_id", "chain_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    chains = chains.select("sample_id", scoring.stand_in(F.col("parts")).alias("score"), scoring.stand_in_evolution(F.col("parts")).alias("evolution"))
    named = expected.select("sample_id", F.col("task").alias("subset"), F.col("query_id").alias("candidate_group_id"), "source_assay", "mutant")
    columns = ["sample_id", *finalize.IDENTITY, "status", *_OUTPUTS]
    rows = chains.join(named, "sample_id").withColumn("status", F.lit("ok")).withColumn("shard", F.pmod(F.xxhash64("sample_id"), F.lit(4)).cast("int"))
    folder, schema = scratch_path(spark, "run"), files.json_digest(_OUTPUTS)
    about = {"dataset_id": DATASET, "dataset_hash": "h"}
    dataset.write_shards(cut(rows), folder, "shard", 4, columns, about, {"model_id": "stand-in", "output_schema_sha256": schema})
    raw = cut(files.shards(spark, folder, columns, schema, about).drop("path"))
    results = cut(finalize.finalised(raw, _OUTPUTS))
    integrity.require(finalize.final_rules(raw, results, expected, t["queries"], _OUTPUTS))
    return finalize.roles(results, expected).groupBy("task", "sample_role").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("n_chains").alias("n_rows"), *[r6(F.sum(c)).alias(f"sum_{c}") for c in _OUTPUTS]
    )


def d_truth(spark: SparkSession, d: str) -> DataFrame:
    """Candidates written as one truth file a group, read back as T2: valid rows, distinct items and score range of each."""
    folder = scratch_path(spark, "truth")
    rows = truth_rows(spark, d).dropna(subset=["item", "score"])
    tidy = rows.select(text.safe_component(F.col("grp"), 120).alias("name"), F.col("item").alias("mutant"), F.col("score").alias("DMS_score"), F.lit('a "quoted", broken\nnote').alias("readout_note"))
    sinks.csv_by_key(tidy, f"{folder}/norm_data", "name")
    typed = files.typed_truth(files.truth(spark, folder, "T2"))
    return typed.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("item").alias("n_items"), r6(F.min("score")).alias("lowest"), r6(F.max("score")).alias("highest"))


def d_combined(spark: SparkSession, d: str) -> DataFrame:
    """Five seeds' scores by chain variant, summed over chains, beside a stand-in's score: mean z-score inside each query."""
    sampled = cut(_samples(spark, d))
    comps = cut(contexts.components(sampled, canonical.proteins(table(spark, d, "assays"))))
    keys = ["context_sha256", "variant_key"]
    chains = cut(contexts.variant_keys(comps))
    by = comps.groupBy("sample_id", "context_sha256", "chain_id").agg(*[F.sum(((F.col("chain_position") * (k + 3)) % 11 - 5) * F.lit(0.1)).alias(f"seed_{k}") for k in range(5)])
    seeds = [f"seed_{k}" for k in range(5)]
    raw = chains.join(by, ["sample_id", "context_sha256", "chain_id"]).groupBy(*keys).agg(*[F.min(s).alias(s) for s in seeds])
    wt = raw.limit(1).withColumn("variant_key", F.lit("wt"))
    scores = cut(ensemble.seed_scores(raw.unionByName(wt), seeds, "variant_key"))
    integrity.require(ensemble.seed_rules(scores, chains.select(*keys).distinct(), seeds, keys))
    summed = ensemble.summed_over_chains(chains, scores.withColumn("code", F.lit(0)), keys, ["ensemble"], "code")
    other = sampled.select("sample_id", "task", "query_id", "sample_role", scoring.stand_in(F.col("components")).alias("other"))
    rows = ensemble.one_to_one(cut(other), cut(summed), "sample_id")
    # a query has to have some deviation in both scores; the others have no combined score
    spread = rows.groupBy("task", "query_id").agg(*[F.stddev_samp(c).alias(f"_{c}") for c in ("other", "ensemble")]).filter("_other > 1e-9 AND _ensemble > 1e-9").select("task", "query_id")
    out = ensemble.combined(cut(rows.join(spread, ["task", "query_id"], "left_semi")), ["task", "query_id"], ["other", "ensemble"], "sample_role")
    return out.select("sample_id", r6(F.col("ensemble")).alias("ensemble"), F.round(F.col("combined") + 1e-7, 4).alias("combined"))


QUERIES = {f.__name__: f for f in (d_dataset, d_finalised, d_truth, d_combined)}

_ANCHOR_SUBS = ", anchors AS (SELECT x.*, wildtype_sequence FROM (" + _ANCHORS + ") x JOIN assays a ON a.assay_id = x.source_assay)," + _parse("anchors", "ap") + """,
shown AS (SELECT DISTINCT task, query_id, parts, wildtype_sequence FROM ap WHERE legal)"""
_SCORE = "list_sum(list_transform(parts, lambda x: (ascii(x.alt) - ascii(x.wt)) / 25.0 - 0.03 * x.pos))"
_EVOLUTION = "list_sum(list_transform(parts, lambda x: (x.pos % 7 - 3) * 0.2 + (ascii(x.alt) % 5) * 0.05))"
_CHAINS_OF = """len(list_distinct(list_transform(parts, lambda x: len(list_filter(list_transform(range(1, len(string_split(wildtype_sequence, ':')) + 1), lambda k: length(array_to_string(string_split(wildtype_sequence, ':')[1:k], ''))), lambda e: e < x.pos)))))"""

SQL = {
    "d_dataset": _POOL + _MUTATED + _SUBS + _ANCHOR_SUBS + """, n AS (
      SELECT 'proteins' AS name, count(DISTINCT upper(wildtype_sequence)) AS n FROM assays UNION ALL SELECT 'samples', count(*) FROM samples UNION ALL SELECT 'substitution_components', count(*) FROM subs
      UNION ALL SELECT 'queries', count(*) FROM (SELECT DISTINCT task, query_id FROM samples) UNION ALL SELECT 'context_samples', count(*) FROM shown UNION ALL SELECT 'context_substitution_components', sum(len(parts)) FROM shown
      UNION ALL SELECT 'provided_context_rows', count(*) FROM (""" + _ANCHORS + """) UNION ALL SELECT 'msa_contexts', count(DISTINCT c) FROM (SELECT unnest(string_split(upper(wildtype_sequence), ':')) AS c FROM assays))
      SELECT name, CAST(n AS BIGINT) AS n_told, CAST(n AS BIGINT) AS n_rows FROM n""",
    "d_finalised": _POOL + _MUTATED + _ANCHOR_SUBS + f""", every AS (SELECT task, 'evaluation_candidate' AS sample_role, parts, wildtype_sequence FROM samples UNION ALL SELECT task, 'anchor_context', parts, wildtype_sequence FROM shown)
      SELECT task, sample_role, count(*) AS n_samples, CAST(sum({_CHAINS_OF}) AS BIGINT) AS n_rows, {sql_r6(f'sum({_SCORE})')} AS sum_score, {sql_r6(f'sum({_EVOLUTION})')} AS sum_evolution FROM every GROUP BY 1, 2""",
    "d_truth": """WITH t AS (SELECT regexp_replace(trim(candidate_group_id, chr(32) || chr(9) || chr(10) || chr(13)), '[.]csv$', '') AS grp, nullif(trim(mutant, chr(32) || chr(9) || chr(10) || chr(13)), '') AS item, dms_score AS score
        FROM candidates WHERE isfinite(dms_score))
      SELECT grp, count(*) AS n_rows, count(DISTINCT item) AS n_items, """ + f"{sql_r6('min(score)')} AS lowest, {sql_r6('max(score)')} AS highest" + " FROM t WHERE grp <> '' AND item IS NOT NULL GROUP BY 1",
    "d_combined": _POOL + _MUTATED + _SUBS + f""", e AS (SELECT sample_id, -sum(""" + " + ".join(f"((chain_position * {k + 3}) % 11 - 5) * 0.1" for k in range(5)) + f""") / 5 AS ensemble FROM subs GROUP BY 1),
      r AS (SELECT s.sample_id, task, query_id, ensemble, {_SCORE} AS other FROM samples s JOIN e ON e.sample_id = s.sample_id),
      z AS (SELECT *, avg(other) OVER w AS ma, stddev_samp(other) OVER w AS sa, avg(ensemble) OVER w AS mb, stddev_samp(ensemble) OVER w AS sb FROM r WINDOW w AS (PARTITION BY task, query_id))
      SELECT sample_id, {sql_r6('ensemble')} AS ensemble, round(((other - ma) / sa + (ensemble - mb) / sb) / 2 + 1e-7, 4) AS combined FROM z WHERE sa > 1e-9 AND sb > 1e-9""",
}
