"""Integrity rules as queries: each gives (rule, key, detail) rows, none where the data pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import mutation
from tallyweave.session import finite


class IntegrityError(ValueError):
    """Raised by require when a rule is broken."""


def _said(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def unique(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once; null keys are equal to each other."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _said(twice, rule, F.concat_ws("|", *keys), F.col("_n"))


def covers(need: DataFrame, have: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys needed but absent."""
    return _said(need.join(have, keys, "left_anti").select(*keys).distinct(), rule, F.concat_ws("|", *keys), F.lit("absent"))


def same_set(a: DataFrame, b: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return covers(a, b, keys, rule).unionByName(covers(b, a, keys, rule))


def disjoint(a: DataFrame, b: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return _said(a.join(b, keys, "left_semi").select(*keys).distinct(), rule, F.concat_ws("|", *keys), F.lit("in both"))


def one_value(df: DataFrame, keys: list[str], values: list[str], rule: str) -> DataFrame:
    """Keys under which one of ``values`` differs between rows; nulls are disregarded."""
    differs = [(F.min(v) != F.max(v)) for v in values]
    bad = df.groupBy(*keys).agg(reduce(lambda x, y: x | y, [F.coalesce(d, F.lit(False)) for d in differs]).alias("_bad")).filter("_bad")
    return _said(bad, rule, F.concat_ws("|", *keys), F.lit("differs"))


def holds(df: DataFrame, key: str, test: Column, rule: str) -> DataFrame:
    """Rows for which ``test`` isn't true (null counts as false)."""
    return _said(df.filter(~F.coalesce(test, F.lit(False))), rule, F.col(key), F.lit("fails"))


def contiguous(df: DataFrame, key: str, index: str, rule: str, order: str | None = None) -> DataFrame:
    """Keys whose ``index`` isn't 1, 2, ..., n; with ``order`` also those where it doesn't rise with the index."""
    shape = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(index).alias("_a"), F.max(index).alias("_b"), F.countDistinct(index).alias("_d"),
        F.sort_array(F.collect_list(F.struct(F.col(index), F.col(order or index)))).alias("_l"),
    )
    bad = (F.col("_a") != 1) | (F.col("_b") != F.col("_n")) | (F.col("_d") != F.col("_n"))
    if order:
        steps = F.transform("_l", lambda x: x[order])
        bad = bad | (F.array_sort(F.array_distinct(steps)) != steps)
    return _said(shape.filter(bad), rule, F.col(key), F.col("_n"))


def membership(expected: DataFrame, actual: DataFrame, keys: list[str], size: str, rule: str) -> DataFrame:
    """Full outer join of expected and actual sizes; what is on one side only or differs is reported."""
    both = expected.select(*keys, F.col(size).alias("_e")).join(actual.select(*keys, F.col(size).alias("_a")), keys, "full_outer")
    bad = both.filter(~F.coalesce(F.col("_e") == F.col("_a"), F.lit(False)))
    return _said(bad, rule, F.concat_ws("|", *keys), F.concat_ws("/", F.coalesce(F.col("_e").cast("string"), F.lit("none")), F.coalesce(F.col("_a").cast("string"), F.lit("none"))))


def finite_columns(df: DataFrame, key: str, columns: list[str], rule: str) -> DataFrame:
    return holds(df, key, reduce(lambda x, y: x & y, [finite(F.col(c)) for c in columns]), rule)


def protein_rules(proteins: DataFrame) -> DataFrame:
    """Hash, length, chain count and boundaries of protein rows agree with their sequences."""
    seq = F.col("wildtype_sequence")
    chains = F.from_json("chain_sequences", "array<string>")
    bounds = F.from_json("chain_boundaries", "array<array<int>>")
    expected = F.transform(mutation.chain_bounds(seq), lambda b: F.array(b["start"], b["end"]))
    tests = {
        "wt_hash": F.sha2(seq, 256) == F.col("sequence_sha256"), "wt_id": F.substring("sequence_sha256", 1, 16) == F.col("wt_id"),
        "wt_length": F.length(mutation.flat_sequence(seq)) == F.col("sequence_length"), "wt_chains": (F.array_join(chains, ":") == seq) & (F.size(chains) == F.col("n_chains")),
        "wt_bounds": bounds == expected, "wt_alphabet": mutation.flat_sequence(seq).rlike(rf"^[{mutation.RESIDUES}]+\z"),
    }
    return reduce(DataFrame.unionByName, [holds(proteins, "wt_id", t, r) for r, t in tests.items()])


def component_rules(samples: DataFrame, substitutions: DataFrame, proteins: DataFrame) -> DataFrame:
    """Samples and components: unique, complete, contiguous, in order, inside their chain, on their residue."""
    sizes = samples.select("sample_id", F.col("mutation_count").alias("n"))
    actual = substitutions.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    home = substitutions.join(samples.select("sample_id", "sequence_sha256"), "sample_id").join(proteins, "sequence_sha256")
    chain = F.element_at(F.from_json("chain_sequences", "array<string>"), F.col("chain_id"))
    start = F.element_at(F.from_json("chain_boundaries", "array<array<int>>"), F.col("chain_id"))[0]
    seated = (
        F.col("chain_id").between(1, F.col("n_chains")) & (F.substring(chain, F.col("chain_position"), F.lit(1)) == F.col("wt_aa"))
        & (start + F.col("chain_position") - 1 == F.col("global_position")) & (F.col("mut_aa") != F.col("wt_aa"))
    )
    return reduce(DataFrame.unionByName, [
        unique(samples, ["sample_id"], "sample_unique"), unique(substitutions, ["sample_id", "component_index"], "component_unique"),
        unique(substitutions, ["sample_id", "global_position"], "position_unique"), membership(sizes, actual, ["sample_id"], "n", "component_count"),
        contiguous(substitutions, "sample_id", "component_index", "component_order", "global_position"),
        holds(home, "sample_id", seated, "component_residue"), holds(samples, "sample_id", F.col("sample_id").rlike(r"^[0-9a-f]{64}\z"), "sample_hex"),
    ])


def one_sequence(variants: DataFrame) -> DataFrame:
    """Variant keys of a context that stand for several sequences: (context_sha256, variant_key, sequence)."""
    return one_value(variants, ["context_sha256", "variant_key"], ["sequence"], "variant_sequence")


def structure_rules(manifest: DataFrame, required: DataFrame, found: DataFrame) -> DataFrame:
    """A manifest of structures (context_sha256, path, structure_status, sequence_length, digest) against the contexts that need
    one (context_sha256, sequence) and what the files hold (path, sequence, sound, digest)."""
    met = required.join(manifest, "context_sha256").join(found.select("path", F.col("sequence").alias("_s"), F.col("digest").alias("_d"), "sound"), "path", "left")
    tests = {
        "structure_ready": F.col("structure_status") == "ready", "structure_length": F.col("sequence_length") == F.length("sequence"),
        "structure_digest": F.col("digest") == F.col("_d"), "structure_sequence": F.col("sound") & (F.col("_s") == F.col("sequence")),
    }
    said = [holds(met, "context_sha256", t, r) for r, t in tests.items()]
    return reduce(DataFrame.unionByName, [unique(manifest, ["context_sha256"], "structure_unique"), covers(required, manifest, ["context_sha256"], "structure_coverage"), *said])


def weight_rules(weights: DataFrame, totals: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Weights of alignment records (context_sha256, weight) are positive and finite and add up to their context's ``neff``."""
    sums = weights.groupBy("context_sha256").agg(F.sum("weight").alias("_w")).join(totals, "context_sha256", "full_outer")
    good = finite(F.col("weight")) & (F.col("weight") > 0)
    return holds(weights, "context_sha256", good, "weight_positive").unionByName(holds(sums, "context_sha256", F.abs(F.col("_w") - F.col("neff")) <= tolerance * F.col("neff"), "weight_sum"))


def context_rules(contexts: DataFrame, needed: DataFrame) -> DataFrame:
    """Prepared contexts (context_id, n_samples): unique, all that are needed (context_id, n_samples), each with its number."""
    return unique(contexts, ["context_id"], "context_unique").unionByName(membership(needed, contexts, ["context_id"], "n_samples", "context_samples"))


def released_rules(results: DataFrame, told: DataFrame, per_query: DataFrame, summaries: DataFrame, scores: list[str], metrics: list[str], tolerance: float = 1e-12) -> DataFrame:
    """A released run: its results, what its manifest tells of each task, its metrics by query, its summaries.

    results: (sample_id, task, query_id, sample_role, status, scores); told: (task, samples, queries, metrics); per_query:
    (task, assay); summaries: (task, missing, unknown, metrics). Samples are unique, evaluated ones, ok and finite; tasks, numbers of
    samples and queries, and the queries themselves agree; no group is missing or unknown; metrics agree.
    """
    keyed = results.withColumn("_ok", (F.col("status") == "ok") & (F.col("sample_role") == "evaluation_candidate"))
    sizes = results.groupBy("task").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("query_id").alias("queries"))
    pairs = results.select("task", F.col("query_id").alias("assay"))
    both = told.select("task", *[F.col(m).alias(f"_{m}") for m in metrics]).join(summaries, "task")
    close = reduce(lambda a, b: a & b, [F.abs(F.col(m) - F.col(f"_{m}")) <= tolerance for m in metrics])
    return reduce(DataFrame.unionByName, [
        unique(results, ["sample_id"], "released_unique"), holds(keyed, "sample_id", F.col("_ok"), "released_status"), finite_columns(results, "sample_id", scores, "released_finite"),
        membership(told, sizes, ["task"], "samples", "released_samples"), membership(told, sizes, ["task"], "queries", "released_queries"), same_set(told.select("task"), summaries.select("task"), ["task"], "released_tasks"),
        unique(per_query, ["task", "assay"], "released_metrics_unique"), same_set(pairs, per_query, ["task", "assay"], "released_metrics"),
        holds(summaries, "task", (F.col("missing") == 0) & (F.col("unknown") == 0), "released_coverage"), holds(both, "task", close, "released_values"),
    ])


def require(violations: DataFrame, show: int = 10) -> None:
    """Raise IntegrityError naming some broken rules, if there are any."""
    some = violations.limit(show).collect()
    if some:
        raise IntegrityError("; ".join(f"{r['rule']}: {r['key']} ({r['detail']})" for r in some))
