"""Tie-aware evaluation of rankings against measured scores, for all groups in one plan.

Tables: truth (grp, item, score), one row an item; predictions (grp, item, order_value, input_index), smaller is better.
Every prediction takes a place in the ranking, also one outside the pool or named before; only the first legal naming of
an item gains anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators.ordering import average_rank, numbered
from tallyweave.session import finite

#: How many of a ranking count, by task.
TOP_K = {"T1": 40, "T2": 5, "T3": 5, "T4": 5}
_SEED = "missing-query-random"


def top_k(task: Column) -> Column:
    return F.when(task == "T1", TOP_K["T1"]).otherwise(TOP_K["T2"])


def read_truth(raw: DataFrame) -> DataFrame:
    """Typed truth rows of (grp, item, score): item null where blank, score null where not finite; null groups go."""
    return raw.select(
        text.group_id(F.col("grp")).alias("grp"), text.nonblank(F.col("item")).alias("item"), F.when(finite(F.col("score")), F.col("score") + F.lit(0.0)).alias("score")
    ).filter(F.col("grp").isNotNull())


def collapse(rows: DataFrame) -> DataFrame:
    """One row an item with its largest score; rows without item or score don't count."""
    return rows.dropna().groupBy("grp", "item").agg(F.max("score").alias("score"))


def truth_quality(rows: DataFrame) -> DataFrame:
    """Per group: raw, invalid and collapsed rows, distinct items, and the range of the scores."""
    valid = F.col("item").isNotNull() & F.col("score").isNotNull()
    # first by item, so the count of distinct items needs no second copy of the rows
    by_item = rows.groupBy("grp", "item").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("item").isNull()).alias("no_item"), F.count_if(F.col("score").isNull()).alias("no_score"),
        F.count_if(valid).alias("valid"), F.min(F.when(valid, F.col("score"))).alias("lo"), F.max(F.when(valid, F.col("score"))).alias("hi"),
        F.max(F.when(valid, F.col("score"))).alias("best"),
    )
    out = by_item.groupBy("grp").agg(
        F.sum("n").alias("raw_rows"), F.sum("no_item").alias("invalid_mutant_rows"), F.sum("no_score").alias("invalid_score_rows"),
        F.sum("valid").alias("valid_rows"), F.count_if(F.col("valid") > 0).alias("num_truth"), F.min("best").alias("score_min"), F.max("best").alias("score_max"),
    )
    return out.withColumn("duplicate_mutants_collapsed", F.col("valid_rows") - F.col("num_truth")).drop("valid_rows")


def read_predictions(raw: DataFrame) -> DataFrame:
    """Predictions of (grp, item, order_value, input_index) that have a group, an item and a finite order value."""
    rows = raw.select(
        text.group_id(F.col("grp")).alias("grp"), text.nonblank(F.col("item")).alias("item"), (F.col("order_value") + F.lit(0.0)).alias("order_value"), "input_index"
    )
    return rows.filter(finite(F.col("order_value"))).dropna(subset=["grp", "item"])


def placed(predictions: DataFrame, heavy: bool = False) -> DataFrame:
    """Add pos, the place in the group's ranking."""
    return numbered(predictions, "grp", F.col("order_value"), [F.col("input_index"), F.col("item")], "pos", heavy)


def truth_places(truth: DataFrame, heavy: bool = False) -> DataFrame:
    """Add best-first place, average rank, the group's size, range, and gain (1 where all scores are equal)."""
    out = numbered(truth.withColumn("down", -F.col("score")), "grp", F.col("down"), [F.col("item")], "place", heavy)
    out = average_rank(out, "grp", "score", "place", "truth_rank", heavy).drop("down")
    stats = truth.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    gain = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return out.join(stats, "grp").withColumn("gain", F.greatest(F.lit(0.0), F.least(F.lit(1.0), gain)))


def missing_order(group: Column, item: Column, seed: str | None = None) -> Column:
    """What items without prediction are ordered by."""
    parts = [F.lit(seed)] if seed else []
    return F.sha2(F.concat_ws("\0", *parts, group, item), 256)


def as_number(digest: Column) -> Column:
    """The first 12 hex digits of a digest as a number, in the digest's order."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")


def joined(truth: DataFrame, predictions: DataFrame, heavy: bool = False) -> DataFrame:
    """Placed predictions beside their item's truth; ``first`` marks an item's first naming, ``legal`` those in the pool."""
    ranked = placed(predictions, heavy)
    if not heavy:
        ranked = ranked.withColumn("first", F.col("pos") == F.min("pos").over(Window.partitionBy("grp", "item")))
    else:
        firsts = ranked.groupBy("grp", "item").agg(F.min("pos").alias("_first"))
        ranked = ranked.join(firsts, ["grp", "item"]).withColumn("first", F.col("pos") == F.col("_first")).drop("_first")
    known = truth.select("grp", "item", "score", "gain", "truth_rank")
    return ranked.join(known, ["grp", "item"], "left").withColumn("legal", F.col("score").isNotNull())


def head_metrics(truth: DataFrame, ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group of ``groups`` (grp, k): nms, recall, ndcg and the counters of selected, legal, illegal and repeated rows.

    ``truth`` comes from truth_places, ``ranked`` from joined. A group without predictions has nms 0 (1 if all its
    scores are equal), recall 0 and ndcg 0.
    """
    per = truth.join(groups, "grp")
    need = F.least(F.col("k"), F.col("n"))
    per = per.groupBy("grp").agg(
        F.max("k").alias("k"), F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max(need).alias("den"),
        F.max(F.when(F.col("place") == need, F.col("score"))).alias("threshold"), F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("ideal"),
    )
    used = ranked.join(per, "grp")
    hit = F.col("legal") & F.col("first")
    head = F.col("pos") <= F.col("k")
    again = F.col("legal") & ~F.col("first")
    got = used.groupBy("grp").agg(
        F.max(F.when(hit & head, F.col("score"))).alias("best"),
        F.count_if(hit & head & (F.col("score") >= F.col("threshold"))).alias("hits"),
        F.sum(F.when(hit & (F.col("pos") <= F.col("n")), F.col("gain") / F.log2(F.col("pos") + 1))).alias("dcg"),
        F.count(F.lit(1)).alias("predicted_rows"),
        F.count_if(head).alias("selected_rows"),
        F.count_if(hit).alias("unique_legal"),
        F.count_if(hit & head).alias("unique_legal_in_budget"),
        F.count_if(~F.col("legal")).alias("illegal_total"),
        F.count_if(~F.col("legal") & head).alias("illegal_in_budget"),
        F.count_if(~F.col("first")).alias("duplicate_total"),
        F.count_if(again & head).alias("duplicate_in_budget"),
    )
    out = per.join(got, "grp", "left")
    span = F.col("hi") - F.col("lo")
    nms = F.when(span <= 0, 1.0).otherwise((F.coalesce("best", "lo") - F.col("lo")) / span)
    counters = [c for c in got.columns if c not in ("grp", "best", "hits", "dcg")]
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return out.select(
        "grp", "k", "n",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counters],
        one(nms).alias("nms"),
        one(F.coalesce("hits", F.lit(0)) / F.col("den")).alias("recall"),
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
    )


def prediction_ranks(truth: DataFrame, ranked: DataFrame, heavy: bool = False) -> DataFrame:
    """Per truth item its predicted rank: average ranks of the first legal namings by order value, then what is missing."""
    legal = ranked.filter(F.col("legal") & F.col("first")).select("grp", "item", "order_value", "pos")
    legal = numbered(legal, "grp", F.col("order_value"), [F.col("pos")], "number", heavy)
    legal = average_rank(legal, "grp", "order_value", "number", "predicted_rank", heavy).select("grp", "item", "predicted_rank")
    sizes = legal.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    rest = truth.select("grp", "item", "truth_rank").join(legal.select("grp", "item"), ["grp", "item"], "left_anti")
    rest = rest.withColumn("digest", missing_order(F.col("grp"), F.col("item")))
    rest = numbered(rest, "grp", as_number(F.col("digest")), [F.col("digest")], "number", heavy).join(sizes, "grp", "left")
    missing = rest.select("grp", "item", "truth_rank", (F.coalesce("m", F.lit(0)) + F.col("number")).cast("double").alias("predicted_rank"))
    return truth.select("grp", "item", "truth_rank").join(legal, ["grp", "item"]).unionByName(missing.select("grp", "item", "truth_rank", "predicted_rank"))


def spearman(ranks: DataFrame) -> DataFrame:
    """(grp, spearman): correlation of both ranks by centred sums; 0 where either is constant."""
    n, a, b = F.count(F.lit(1)), F.col("truth_rank"), F.col("predicted_rank")
    # doubled ranks are whole numbers, so these sums are exact up to 2**53 and in any order
    sums = ranks.groupBy("grp").agg(n.alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    cov, va, vb = (F.col(x) - F.col(y) * F.col(z) / F.col("n") for x, y, z in (("ab", "a", "b"), ("aa", "a", "a"), ("bb", "b", "b")))
    rho = F.when((va <= 0) | (vb <= 0), 0.0).otherwise(cov / F.sqrt(va) / F.sqrt(vb))
    return sums.select("grp", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("spearman"))


def replacement(truth: DataFrame, groups: DataFrame, heavy: bool = False) -> DataFrame:
    """The pseudo-random ranking of all items of ``groups`` (grp, task, k), cut to k for T1, as predictions."""
    rows = truth.select("grp", "item").join(groups.select("grp", "task", "k"), "grp")
    rows = rows.withColumn("digest", missing_order(F.col("grp"), F.col("item"), _SEED))
    rows = numbered(rows, "grp", as_number(F.col("digest")), [F.col("digest")], "number", heavy)
    rows = rows.filter((F.col("task") != "T1") | (F.col("number") <= F.col("k")))
    return rows.select("grp", "item", F.col("number").cast("double").alias("order_value"), F.col("number").cast("bigint").alias("input_index"))
