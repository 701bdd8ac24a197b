"""From shard rows to one result a sample: integrity, sums over chains, coverage, exports and the leaderboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import nonblank
from tallyweave.operators import canonical, integrity
from tallyweave.session import finite

IDENTITY = ["subset", "candidate_group_id", "source_assay", "mutant"]
SCORES = ["masked_marginal", "mutant_logp", "wt_logp"]


def is_ok(status: Column) -> Column:
    return F.coalesce(F.lower(nonblank(status)) == "ok", F.lit(False))


def delivered_once(rows: DataFrame) -> DataFrame:
    """One row a (model, sample, chain): the latest load, of equal loads the largest row_id. Rows without model or sample go."""
    known = rows.filter(F.col("model_id").isNotNull() & F.col("sample_id").isNotNull() & (F.col("sample_id") != ""))
    rest = [c for c in rows.columns if c not in ("model_id", "sample_id", "chain_id")]
    last = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col("loaded_at").cast("double"), F.lit(float("-inf"))).alias("t"), "row_id"))
    return known.groupBy("model_id", "sample_id", "chain_id").agg(last.alias("r")).select("model_id", "sample_id", "chain_id", "r.*")


def shard_rules(rows: DataFrame) -> DataFrame:
    """Rows and samples that keep a run from being final: failed status, non-finite scores, contradicting identities, repeats."""
    key = F.concat_ws("|", F.coalesce("model_id", F.lit("")), F.coalesce("sample_id", F.lit("")))
    keyed = rows.withColumn("key", key)
    known = keyed.filter(F.col("model_id").isNotNull() & F.col("sample_id").isNotNull())
    ok = keyed.filter(is_ok(F.col("status")))
    return reduce(DataFrame.unionByName, [
        integrity.holds(keyed, "key", is_ok(F.col("status")), "status_ok"), integrity.finite_columns(ok, "key", SCORES, "finite_scores"),
        integrity.holds(keyed, "key", nonblank(F.col("sample_id")).isNotNull() & F.col("model_id").isNotNull(), "identity_present"),
        integrity.one_value(known, ["model_id", "sample_id"], IDENTITY, "identity_agrees"),
        integrity.unique(known.select("model_id", "sample_id", "chain_id"), ["model_id", "sample_id", "chain_id"], "delivered_once"),
    ])


def shard_numbers(rows: DataFrame, shards: int) -> DataFrame:
    """(model_id, shards, missing): distinct shard numbers of each model and how many of 0 .. shards - 1 are absent."""
    seen = rows.filter(F.col("shard_id").between(0, shards - 1) & F.col("model_id").isNotNull()).groupBy("model_id", "shard_id").agg(F.lit(1).alias("one"))
    return seen.groupBy("model_id").agg(F.count(F.lit(1)).alias("shards")).withColumn("missing", F.lit(shards) - F.col("shards"))


def summed_chains(rows: DataFrame) -> DataFrame:
    """One row a (model, sample): identity and every score summed over its chains; good rows only."""
    good = delivered_once(rows.filter(is_ok(F.col("status"))))
    good = good.filter(reduce(lambda a, b: a & b, [finite(F.col(c)) for c in SCORES]))
    return good.groupBy("model_id", "sample_id").agg(
        *[F.min(c).alias(c) for c in IDENTITY], F.count(F.lit(1)).alias("n_chains"), *[F.sum(c).alias(c) for c in SCORES]
    )


def finalised(rows: DataFrame, outputs: list[str]) -> DataFrame:
    """One row a sample of a run's chain rows: its identity and every declared output summed over its chains."""
    return rows.groupBy("sample_id").agg(*[F.min(c).alias(c) for c in IDENTITY], F.count(F.lit(1)).alias("n_chains"), *[F.sum(F.col(c).cast("double")).alias(c) for c in outputs])


def final_rules(rows: DataFrame, results: DataFrame, expected: DataFrame, queries: DataFrame, outputs: list[str]) -> DataFrame:
    """(rule, key, detail) of what keeps a run from being final, given its chain rows, its results and the dataset's samples.

    ``expected`` is (sample_id, task, query_id, source_assay, mutant, sample_role) of evaluation and context samples, ``queries``
    (task, query_id, expected_samples). Failed rows, outputs that aren't finite numbers, identities that differ between
    chains; samples without result and results without sample; fields that differ; queries of another size.
    """
    both = expected.join(results.select("sample_id", *[F.col(c).alias(f"_{c}") for c in IDENTITY]), "sample_id")
    same = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in (("task", "_subset"), ("query_id", "_candidate_group_id"), ("source_assay", "_source_assay"), ("mutant", "_mutant"))])
    ranked = roles(results, expected).filter(F.col("sample_role") == canonical.EVALUATION)
    sizes = ranked.groupBy("task", "query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return reduce(DataFrame.unionByName, [
        integrity.holds(rows, "sample_id", is_ok(F.col("status")), "status_ok"), integrity.finite_columns(rows.select("sample_id", *[F.col(c).cast("double").alias(c) for c in outputs]), "sample_id", outputs, "finite_outputs"),
        integrity.one_value(rows, ["sample_id"], IDENTITY, "identity_agrees"), integrity.unique(expected, ["sample_id"], "expected_unique"),
        integrity.same_set(expected.select("sample_id"), results.select("sample_id"), ["sample_id"], "coverage"), integrity.holds(both, "sample_id", same, "same_fields"),
        integrity.membership(queries.select("task", "query_id", F.col("expected_samples").cast("int").alias("n")), sizes, ["task", "query_id"], "n", "query_size"),
    ])


def roles(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Results with their sample's role, task and query; filtered by role they are the ranking's and the context's results."""
    return results.join(expected.select("sample_id", "sample_role", "task", "query_id"), "sample_id")


def coverage(expected: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of expected and delivered keys with where each is found: both, expected only, result only."""
    a, b = expected.select(*keys).distinct().withColumn("_e", F.lit(True)), results.select(*keys).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_e") & F.col("_r"), "both").when(F.col("_e"), "expected_only").otherwise("result_only")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("found"))


def evaluator_rows(results: DataFrame, score: str) -> DataFrame:
    """What the evaluation reads: (task, model_id, assay, mutant, score)."""
    return results.select(F.col("subset").alias("task"), "model_id", F.col("candidate_group_id").alias("assay"), "mutant", F.col(score).alias("score")).dropna(subset=["assay", "mutant"])


def long_form(summaries: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row a metric: the map of metrics of each summary exploded."""
    pairs = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    return summaries.select(*keys, F.explode(pairs).alias("metric", "value"))
