"""What to do with groups whose predictions are missing, short or incomplete, and the summary over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import ranking
from tallyweave.session import cut

METRICS = ["nms", "recall", "ndcg", "spearman"]


class StrictnessError(ValueError):
    """Raised in strict mode; the message names how many groups fail each test."""


def group_flags(truth: DataFrame, predictions: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row for each group of either side with its task, k, n, number of rows, and the tests it fails.

    missing: in the truth only; unknown: predicted only; short: fewer rows than min(k, n), repeated and illegal ones
    counted; incomplete: a ranking task whose row count isn't n; unranked: a ranking task whose legal items don't cover the pool;
    repeated and outside: some item named twice or not in the pool. A group whose task is unknown counts as T2.
    """
    sizes = truth.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    by_item = predictions.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("c"))
    by_item = by_item.join(truth.select("grp", "item", F.lit(True).alias("legal")), ["grp", "item"], "left")
    given = by_item.groupBy("grp").agg(
        F.sum("c").alias("provided"), F.count_if("legal").alias("legal_items"), F.count_if(F.col("c") > 1).alias("twice"), F.count_if(F.col("legal").isNull()).alias("foreign")
    )
    both = sizes.join(given, "grp", "full_outer").join(tasks, "grp", "left").withColumn("task", F.coalesce("task", F.lit("T2")))
    both = both.withColumn("k", ranking.top_k(F.col("task")))
    known, present = F.col("n").isNotNull(), F.col("provided").isNotNull()
    ranks = F.col("task") != "T1"
    return both.select(
        "grp", "task", "k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("provided", F.lit(0)).alias("provided"),
        (known & ~present).alias("missing"), (~known).alias("unknown"),
        F.coalesce(known & present & (F.col("provided") < F.least("k", "n")), F.lit(False)).alias("short"),
        F.coalesce(known & present & ranks & (F.col("provided") != F.col("n")), F.lit(False)).alias("incomplete"),
        F.coalesce(known & present & ranks & (F.col("legal_items") != F.col("n")), F.lit(False)).alias("unranked"),
        F.coalesce(known & (F.col("twice") > 0), F.lit(False)).alias("repeated"),
        F.coalesce(known & ranks & (F.col("foreign") > 0), F.lit(False)).alias("outside"),
    )


def decide(flags: DataFrame, mode: int) -> DataFrame:
    """Add status: provided, random_replacement or skipped. Unknown groups go. Mode 0 raises if any group fails a test."""
    if mode not in (0, 1, 2):
        raise ValueError("mode is 0, 1 or 2")
    lacking = F.col("missing") | F.col("short")
    if mode == 0:
        tests = ["missing", "unknown", "short", "incomplete", "repeated", "outside"]
        counts = flags.agg(*[F.count_if(t).alias(t) for t in tests]).first().asDict()
        if any(counts.values()):
            raise StrictnessError(", ".join(f"{t}: {n} groups" for t, n in counts.items() if n))
        status = F.lit("provided")
    elif mode == 1:
        status = F.when(F.when(F.col("task") == "T1", lacking).otherwise(F.col("missing")), "random_replacement").otherwise("provided")
    else:
        status = F.when(lacking | F.col("incomplete"), "skipped").otherwise("provided")
    return flags.filter(~F.col("unknown")).withColumn("status", status)


def evaluate(truth: DataFrame, predictions: DataFrame, decided: DataFrame, heavy: bool = False) -> DataFrame:
    """Metrics of every group that isn't skipped; T1 has null ndcg and spearman. One plan over all groups."""
    kept = cut(decided.filter(F.col("status") != "skipped").select("grp", "task", "k", "status", "provided"))
    given = predictions.join(kept.filter(F.col("status") == "provided").select("grp"), "grp", "left_semi")
    drawn = ranking.replacement(truth, kept.filter(F.col("status") == "random_replacement"), heavy)
    # both are read by several metrics: written once, they aren't computed again for each
    places = cut(ranking.truth_places(truth.join(kept.select("grp"), "grp", "left_semi"), heavy))
    ranked = cut(ranking.joined(places, given.unionByName(drawn), heavy))
    head = ranking.head_metrics(places, ranked, kept.select("grp", "k"))
    rho = ranking.spearman(ranking.prediction_ranks(places, ranked, heavy))
    out = head.drop("k").join(rho, "grp").join(kept, "grp")
    full = F.col("task") != "T1"
    return out.withColumn("ndcg", F.when(full, F.col("ndcg"))).withColumn("spearman", F.when(full, F.col("spearman")))


def summary(results: DataFrame, flags: DataFrame, quality: DataFrame) -> DataFrame:
    """One row a task: unweighted means over its groups, numbers of problem groups, sums of truth counters.

    Counters add up over all truth groups, skipped ones included. A task without scored groups has null means.
    """
    means = results.groupBy("task").agg(
        F.count(F.lit(1)).alias("num_queries"), *[F.avg(m).alias(f"mean_{m}") for m in METRICS],
        F.avg("illegal_in_budget").alias("mean_illegal_in_budget"), F.avg("duplicate_in_budget").alias("mean_duplicate_in_budget"),
        F.count_if(F.col("status") == "random_replacement").alias("random_replacement_cases"),
    )
    problems = flags.groupBy("task").agg(
        F.count_if(~F.col("unknown")).alias("num_target_cases"), F.count_if("missing").alias("missing_groups"), F.count_if("unknown").alias("unknown_groups"),
        F.count_if("short").alias("short_groups"), F.count_if("unranked").alias("unranked_groups"),
    )
    sums = quality.join(flags.select("grp", "task"), "grp").groupBy("task").agg(
        F.sum("invalid_score_rows").alias("invalid_score_rows"), F.sum("invalid_mutant_rows").alias("invalid_mutant_rows"), F.sum("duplicate_mutants_collapsed").alias("duplicates_collapsed")
    )
    return problems.join(means, "task", "left").join(sums, "task", "left")


def overall(summaries: DataFrame, metric: str = "mean_nms", expected: int | None = 4) -> DataFrame:
    """Unweighted mean over exactly ``expected`` tasks; another number, or a task with groups but no mean, raises when read.

    With ``expected`` None all tasks that have groups count.
    """
    out = summaries.filter("num_target_cases > 0").agg(F.count(F.lit(1)).alias("_n"), F.count(metric).alias("n_tasks"), F.avg(metric).alias("average"))
    good = (F.col("n_tasks") == F.col("_n")) & (F.lit(expected is None) | (F.col("n_tasks") == F.lit(expected or 0)))
    error = F.raise_error(F.lit("not every task has a mean")).cast("double")
    return out.select("n_tasks", F.when(good, F.col("average")).otherwise(error).alias("average"))
