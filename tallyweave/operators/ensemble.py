"""Putting several models' scores of a sample together: seeds, chains, other models, z-scores inside each query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import integrity, scoring
from tallyweave.session import finite


def seed_scores(raw: DataFrame, seeds: list[str], item: str = "mutant") -> DataFrame:
    """Adds ``score_<seed>``, each seed's value with its sign turned, ``mean_raw`` and ``ensemble``; the row of the wild type goes."""
    rows = raw.filter(F.col(item) != "wt")
    mean = reduce(lambda a, b: a + b, [F.col(s) for s in seeds]) / len(seeds)
    return rows.withColumns({f"score_{s}": -F.col(s) for s in seeds}).withColumn("mean_raw", mean).withColumn("ensemble", -F.col("mean_raw"))


def seed_rules(scores: DataFrame, expected: DataFrame, seeds: list[str], keys: list[str], tolerance: float = 1e-7) -> DataFrame:
    """What is wrong with scores from seeds: repeated, missing or alien keys, values that aren't finite, signs, means."""
    close = lambda a, b: F.abs(a - b) <= tolerance
    mean = reduce(lambda a, b: a + b, [F.col(s) for s in seeds]) / len(seeds)
    keyed = scores.withColumn("_key", F.concat_ws("|", *keys))
    signs = reduce(lambda a, b: a & b, [close(F.col(f"score_{s}"), -F.col(s)) for s in seeds])
    return reduce(DataFrame.unionByName, [
        integrity.unique(scores, keys, "score_unique"), integrity.same_set(expected.select(*keys), scores.select(*keys), keys, "score_set"),
        integrity.finite_columns(keyed, "_key", [*seeds, *(f"score_{s}" for s in seeds), "mean_raw", "ensemble"], "score_finite"), integrity.holds(keyed, "_key", signs, "score_sign"),
        integrity.holds(keyed, "_key", close(F.col("mean_raw"), mean) & close(F.col("ensemble"), -F.col("mean_raw")), "score_mean"),
    ])


def summed_over_chains(sample_chains: DataFrame, scores: DataFrame, keys: list[str], columns: list[str], source: str | None = None) -> DataFrame:
    """(sample_id, columns summed over a sample's chains) after a left join on ``keys``, under which ``scores`` has one row.

    A sample-chain without score raises when it is read, and so does a sample whose chains differ in ``source``.
    """
    met = sample_chains.join(scores.select(*keys, *columns, *([source] if source else [])), keys, "left")
    lost = F.raise_error(F.concat(F.lit("no score for a chain of "), F.col("sample_id"))).cast("double")
    out = met.groupBy("sample_id").agg(
        *[F.sum(F.coalesce(c, lost)).alias(c) for c in columns], *([F.min(source).alias(source), F.max(source).alias("_last")] if source else [])
    )
    if not source:
        return out
    mixed = F.raise_error(F.concat(F.lit("chains of different sources: "), F.col("sample_id"))).cast(dict(scores.dtypes)[source])
    return out.withColumn(source, F.when(F.col(source) == F.col("_last"), F.col(source)).otherwise(mixed)).drop("_last")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``, which is unique on both sides and in both of them, else it raises IntegrityError. Reads both."""
    integrity.require(reduce(DataFrame.unionByName, [
        integrity.unique(left, [key], "left_unique"), integrity.unique(right, [key], "right_unique"), integrity.same_set(left.select(key), right.select(key), [key], "same_keys"),
    ]))
    return left.join(right, key)


def combined(rows: DataFrame, group: list[str], columns: list[str], role: str, name: str = "combined") -> DataFrame:
    """Mean z-score of ``columns`` inside each group, statistics from its evaluation rows alone, for all rows.

    A group without deviation in some column raises when it is read, as its z-scores mean nothing.
    """
    out = scoring.z_ensemble(rows, group, columns, F.col(role) == "evaluation_candidate", name)
    known = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns])
    flat = F.raise_error(F.concat_ws(" ", F.lit("no deviation in"), *group)).cast("double")
    return out.withColumn(name, F.when(known & F.col(name).isNull(), flat).otherwise(F.col(name)))
