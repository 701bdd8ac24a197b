"""Per-key results when a few keys hold most records: fragment and replicate by estimated load.

Loads come from one pre-aggregated count. A key whose load reaches a fraction of one task's share is planned by name:
it is cut into shards in proportion to its load and the shards are packed onto tasks, heaviest first, each onto the task
with the least load. All other keys go to tasks by hash. Rows of a planned key choose a shard by hash of the value that
is counted distinct, so distinct counts of shards add up; the matching side is replicated to a planned key's shards only.

How large the plan can get is fixed beforehand: keys of at least ``1 / (fine * tasks)`` of all rows are at most
``fine * tasks``, whatever the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import cut, finite

_FINE = 4


def key_loads(df: DataFrame, keys: list[str]) -> DataFrame:
    """(field, key_val, n): rows of each value of each key column, null and empty ones included. Counted map-side first."""
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("key_val")) for k in keys]))
    return df.select(pairs).groupBy("field", "key_val").agg(F.count(F.lit(1)).alias("n"))


def plan_shards(loads: list[tuple[str, str, int]], rows: int, tasks: int) -> list[tuple[str, str, int, int, int]]:
    """(field, key_val, shards, shard, task) for the heavy keys in ``loads``.

    A key gets one shard for each begun half of a task's share; shards are packed longest first, each onto the task with
    the least load so far. Ties go by name, so the plan depends on the loads alone.
    """
    share = max(1.0, rows / tasks)
    pieces = []
    for field, key, n in loads:
        shards = min(tasks, max(1, -int(-2 * n // share)))
        pieces += [(n / shards, field, key, shards, s) for s in range(shards)]
    heap = [(0.0, t) for t in range(tasks)]
    plan = []
    for load, field, key, shards, s in sorted(pieces, key=lambda p: (-p[0], *p[1:])):
        at, task = heapq.heappop(heap)
        plan.append((field, key, shards, s, task))
        heapq.heappush(heap, (at + load, task))
    return plan


def heavy_plan(loads: DataFrame, tasks: int) -> DataFrame:
    """The plan of all keys that hold at least ``1 / (4 * tasks)`` of their field's rows: 4 * tasks keys a field at most.

    ``loads`` is read several times: it is to be a written table.
    """
    spark = loads.sparkSession
    known = loads.filter(F.col("key_val") != "")
    totals = known.groupBy("field").agg(F.sum("n").alias("rows"))
    heavy = known.join(F.broadcast(totals), "field").filter(F.col("n") * (_FINE * tasks) >= F.col("rows")).collect()
    plan: list[tuple] = []
    for field in sorted({r["field"] for r in heavy}):
        own = [r for r in heavy if r["field"] == field]
        plan += plan_shards(sorted((r["field"], r["key_val"], r["n"]) for r in own), own[0]["rows"], tasks)
    return spark.createDataFrame(plan, "field string, key_val string, shards int, shard int, task int")


def _placed(rows: DataFrame, plan: DataFrame, tasks: int, spread: Column) -> DataFrame:
    """Add shard and task; ``spread`` picks the shard of a planned key's row."""
    by_key = plan.groupBy("field", "key_val").agg(
        F.max("shards").alias("shards"), F.array_sort(F.collect_list(F.struct("shard", "task"))).alias("tasks_of")
    )
    placed = rows.join(F.broadcast(by_key), ["field", "key_val"], "left")
    shard = F.coalesce(F.pmod(F.xxhash64(spread), F.col("shards").cast("bigint")).cast("int"), F.lit(0))
    return placed.withColumn("shard", shard).withColumn(
        "task",
        F.coalesce(
            F.try_element_at(F.col("tasks_of"), F.col("shard") + 1)["task"],
            F.pmod(F.xxhash64("field", "key_val"), F.lit(tasks).cast("bigint")).cast("int"),
        ),
    ).drop("tasks_of", "shards")


def balanced_results(
    df: DataFrame, keys: list[str], distinct: str, measure: str, row_id: str, tasks: int | None = None, loads: DataFrame | None = None
) -> DataFrame:
    """(field, key_val, n_rows, n_samples, mean_measure, tasks_used) for every value of every key column.

    n_rows counts all rows of the key, n_samples the distinct non-null, non-empty values of ``distinct``, mean_measure
    averages the finite values of ``measure`` (null where there is none). Null and empty keys have no result. Rows that
    are delivered twice count twice in n_rows and in the mean. An empty table gives an empty result.
    """
    spark = df.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    plan = heavy_plan(cut(key_loads(df, keys)) if loads is None else loads, tasks)
    value = F.when(finite(F.col(measure)), F.col(measure))
    sample = F.nullif(F.col(distinct).cast("string"), F.lit(""))
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("key_val")) for k in keys]))
    rows = df.select(sample.alias("_s"), F.col(row_id).alias("_r"), value.alias("_v"), pairs).filter(F.col("key_val") != "")
    # a row without a sample is spread by its own id, else all of them would meet in one shard
    placed = _placed(rows, plan, tasks, F.coalesce(F.col("_s"), F.col("_r").cast("string")))
    placed = placed.select("field", "key_val", "shard", "task", "_s", "_v").repartitionById(tasks, "task")
    once = placed.groupBy("task", "field", "key_val", "shard", "_s").agg(
        F.count(F.lit(1)).alias("n"), F.count("_v").alias("n_v"), F.sum("_v").alias("sum_v")
    )
    shards = once.groupBy("task", "field", "key_val", "shard").agg(
        F.sum("n").alias("n"), F.count("_s").alias("n_s"), F.sum("n_v").alias("n_v"), F.sum("sum_v").alias("sum_v")
    )
    return shards.groupBy("field", "key_val").agg(
        F.sum("n").alias("n_rows"),
        F.sum("n_s").alias("n_samples"),
        (F.sum("sum_v") / F.nullif(F.sum("n_v"), F.lit(0))).alias("mean_measure"),
        F.countDistinct("task").alias("tasks_used"),
    )


def replicated_join(df: DataFrame, side: DataFrame, key: str, spread: str, tasks: int | None = None) -> DataFrame:
    """Left join of ``df`` with ``side`` on ``key``, hot keys cut into shards and their side rows copied to each shard.

    ``spread`` is a column of ``df`` with many values; its null counts as one value. Columns of ``side`` whose names occur in
    ``df`` are left out. A row with a null key keeps nulls for the side's columns.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = heavy_plan(cut(key_loads(df, [key])), tasks).select("key_val", "shards", "shard")
    shards = plan.groupBy("key_val").agg(F.max("shards").alias("_n"))
    left = df.withColumn("_k", F.col(key).cast("string")).join(
        F.broadcast(shards.withColumnRenamed("key_val", "_k")), "_k", "left"
    ).withColumn("_shard", F.coalesce(F.pmod(F.xxhash64(F.col(spread)), F.col("_n").cast("bigint")).cast("int"), F.lit(0)))
    extra = [c for c in side.columns if c not in df.columns]
    right = side.select(F.col(key).cast("string").alias("_k"), *extra).join(
        F.broadcast(plan.select(F.col("key_val").alias("_k"), F.col("shard").alias("_s"))), "_k", "left"
    ).withColumn("_shard", F.coalesce("_s", F.lit(0))).drop("_s")
    return left.join(right, ["_k", "_shard"], "left").select(*df.columns, *extra)


def frequent_keys(results: DataFrame, rows: int, least: float) -> DataFrame:
    """(field, key_val) of the results that hold at least ``least`` of ``rows`` rows."""
    return results.filter(F.col("n_rows") >= F.lit(least) * F.lit(float(rows))).select("field", "key_val")


def hot_keys(df: DataFrame, keys: list[str], distinct: str, measure: str, row_id: str, least: float) -> DataFrame:
    """Values of the key columns that hold at least ``least`` of all rows, read off the balanced results.

    Loads are counted once, for the plan and, as rows without a key are in them, for the number of all rows.
    """
    loads = cut(key_loads(df, keys))
    rows = loads.filter(F.col("field") == keys[0]).agg(F.sum("n")).first()[0] or 0
    return frequent_keys(balanced_results(df, keys, distinct, measure, row_id, loads=loads), rows, least)
