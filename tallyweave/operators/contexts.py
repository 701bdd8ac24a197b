"""From substitutions to scoring contexts: components by chain, statistics, windows, shard plans."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import canonical
from tallyweave.session import cut


def chains(proteins: DataFrame) -> DataFrame:
    """(sequence_sha256, chain_id, chain, context_sha256): each chain of each protein."""
    rows = proteins.select("sequence_sha256", F.posexplode(F.split("wildtype_sequence", ":", -1)).alias("i", "chain"))
    return rows.select("sequence_sha256", (F.col("i") + 1).alias("chain_id"), "chain", F.sha2("chain", 256).alias("context_sha256"))


def components(sampled: DataFrame, proteins: DataFrame) -> DataFrame:
    """Components of samples with their chain's context; none is lost: one whose chain isn't there raises when it is read.

    A sample's columns come along from its own row, without a join. Chains number as many as the fixed assay list has and
    are broadcast.
    """
    subs = canonical.substitutions(sampled, ["task", "query_id", "source_assay", "sequence_sha256"])
    met = subs.join(F.broadcast(chains(proteins)), ["sequence_sha256", "chain_id"], "left")
    lost = F.raise_error(F.concat(F.lit("no chain for a component of "), F.col("sample_id"))).cast("string")
    return met.withColumn("context_sha256", F.coalesce("context_sha256", lost))


def statistics(comps: DataFrame) -> DataFrame:
    """Per context: distinct samples, components, distinct positions and their sorted list (at most a chain's length).

    Components are worked out once and written narrow, as they are counted in two ways.
    """
    slim = cut(comps.select("context_sha256", F.length("chain").alias("length"), "chain_position", "sample_id"))
    # by position first: the final arrays are built from distinct positions only
    by_pos = slim.groupBy("context_sha256", "length", "chain_position").agg(F.count(F.lit(1)).alias("n"))
    by_sample = slim.groupBy("context_sha256", "sample_id").agg(F.lit(1).alias("one")).groupBy("context_sha256").agg(F.count(F.lit(1)).alias("n_samples"))
    out = by_pos.groupBy("context_sha256", "length").agg(
        F.sum("n").alias("n_components"), F.count(F.lit(1)).alias("n_positions"), F.array_sort(F.collect_list("chain_position")).alias("positions")
    )
    return out.join(by_sample, "context_sha256")


def variant_keys(comps: DataFrame) -> DataFrame:
    """Per sample and chain the ordered key of its substitutions there, joined by ``:``."""
    part = F.struct(F.col("chain_position").alias("p"), F.concat("wt_aa", F.col("chain_position").cast("string"), "mut_aa").alias("t"))
    return comps.groupBy("sample_id", "chain_id", "context_sha256").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), ":").alias("variant_key"))


def plan_shards(costs: list[tuple[str, int]], shards: int) -> list[tuple[str, int, int]]:
    """(key, cost, shard): longest first, each to the least loaded shard, the lower number on ties."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for key, cost in sorted(costs, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out.append((key, cost, shard))
        heapq.heappush(heap, (load + cost, shard))
    return out


def shard_plan(contexts: DataFrame, key: str, cost: Column, shards: int, most: int = 200_000) -> DataFrame:
    """Plan contexts onto shards on the driver: contexts are chains of the fixed assay list. Beyond ``most`` it refuses."""
    rows = contexts.select(F.col(key).alias("k"), cost.cast("bigint").alias("c")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} contexts: plan them in parts")
    return contexts.sparkSession.createDataFrame(plan_shards([(r["k"], r["c"]) for r in rows], shards), f"{key} string, cost bigint, shard_id int")
