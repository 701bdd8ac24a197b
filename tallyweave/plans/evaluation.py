"""Queries of the ranking evaluation: truth, predictions, metrics, policies, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import ordering, policy, ranking
from tallyweave.plans.common import BASE, predictions, r6, sql_r6, tasks, truth, truth_rows
from tallyweave.session import cut, table

_COUNTERS = ["predicted_rows", "selected_rows", "unique_legal", "unique_legal_in_budget", "illegal_total", "illegal_in_budget", "duplicate_total", "duplicate_in_budget"]


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Truth and predictions, written once for all that reads them."""
    return cut(truth(spark, d)), cut(predictions(spark, d))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return policy.group_flags(truth(spark, d), predictions(spark, d), tasks(spark, d))


def _heavy(flags: DataFrame) -> bool:
    """Whether a group is too large for one task's sort, on either side."""
    return not flags.filter(F.greatest("n", "provided") >= ordering.HEAVY_FROM).isEmpty()


def _results(spark: SparkSession, d: str, mode: int, heavy: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and flags of all groups."""
    known, said = _tables(spark, d)
    flags = cut(policy.group_flags(known, said, tasks(spark, d)))
    return policy.evaluate(known, said, policy.decide(flags, mode), _heavy(flags) if heavy is None else heavy), flags


def _summary(spark: SparkSession, d: str) -> DataFrame:
    results, flags = _results(spark, d, 1)
    return policy.summary(results, flags, ranking.truth_quality(truth_rows(spark, d)))


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Truth by place, predictions beside it, flags, and whether a group is large."""
    known, said = _tables(spark, d)
    flags = cut(policy.group_flags(known, said, tasks(spark, d)))
    heavy = _heavy(flags)
    places = ranking.truth_places(known, heavy)
    return places, ranking.joined(places, said, heavy), flags, heavy


def _prediction_ranks(spark: SparkSession, d: str) -> DataFrame:
    places, ranked, _, heavy = _ranked(spark, d)
    return ranking.prediction_ranks(places, ranked, heavy)


def _heads(spark: SparkSession, d: str) -> DataFrame:
    places, ranked, flags, _ = _ranked(spark, d)
    return ranking.head_metrics(places, ranked, flags.filter("NOT unknown").select("grp", "k"))


def e_truth(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed truth rows (valid rows only, the largest score of each item)."""
    return truth(spark, d)


def e_truth_quality(spark: SparkSession, d: str) -> DataFrame:
    return ranking.truth_quality(truth_rows(spark, d))


def e_placed(spark: SparkSession, d: str) -> DataFrame:
    said = cut(predictions(spark, d))
    return _order_sums(ranking.placed(said, ordering.has_heavy(said, "grp")))


def e_placed_large(spark: SparkSession, d: str) -> DataFrame:
    """As e_placed, all groups numbered the way large ones are."""
    return _order_sums(ranking.placed(predictions(spark, d), True))


def _order_sums(placed: DataFrame) -> DataFrame:
    return placed.select("grp", "item", "order_value", "input_index", "pos").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("pos").alias("last_pos"), F.sum(F.col("pos") * F.pmod(F.col("input_index"), F.lit(97))).alias("order_sum")
    )


def e_legal(spark: SparkSession, d: str) -> DataFrame:
    """Predictions by place with whether their item is in the pool and named for the first time."""
    _, ranked, _, _ = _ranked(spark, d)
    return ranked.groupBy("grp", "legal", "first").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("pos").alias("pos_sum"))


def e_groups_only(spark: SparkSession, d: str) -> DataFrame:
    """Groups on one side only: anti-joins both ways."""
    a, b = truth(spark, d).select("grp").distinct(), predictions(spark, d).select("grp").distinct()
    return a.join(b, "grp", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "grp", "left_anti").withColumn("side", F.lit("unknown")))


def e_groups_both(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d).select("grp").intersect(predictions(spark, d).select("grp"))


def e_nms(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("grp", "k", "n", r6(F.col("nms")).alias("nms"))


def e_recall(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("grp", r6(F.col("recall")).alias("recall"))


def e_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("grp", r6(F.col("ndcg")).alias("ndcg"))


def e_quality(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("grp", *_COUNTERS)


def e_average_rank(spark: SparkSession, d: str) -> DataFrame:
    known = cut(truth(spark, d))
    return ranking.truth_places(known, ordering.has_heavy(known, "grp")).select("grp", "item", "place", "truth_rank", r6(F.col("gain")).alias("gain"))


def e_prediction_rank(spark: SparkSession, d: str) -> DataFrame:
    return _prediction_ranks(spark, d).select("grp", "item", "predicted_rank")


def e_spearman(spark: SparkSession, d: str) -> DataFrame:
    return ranking.spearman(_prediction_ranks(spark, d)).select("grp", r6(F.col("spearman")).alias("spearman"))


def e_replacement(spark: SparkSession, d: str) -> DataFrame:
    flags = _flags(spark, d).filter("NOT unknown")
    known = cut(truth(spark, d))
    return ranking.replacement(known, flags, ordering.has_heavy(known, "grp")).select("grp", "item", "input_index")


def e_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


def _mode(mode: int, heavy: bool | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out, _ = _results(spark, d, mode, heavy)
        return out.select("grp", "task", "status", "provided", "n", *[r6(F.col(m)).alias(m) for m in policy.METRICS], "illegal_in_budget", "duplicate_in_budget")

    return run


def e_summary(spark: SparkSession, d: str) -> DataFrame:
    out = _summary(spark, d)
    return out.select(*[r6(F.col(c)).alias(c) if c.startswith("mean_") else F.col(c) for c in out.columns])


def e_overall(spark: SparkSession, d: str) -> DataFrame:
    """Mean over tasks; exactly three have to have one, as these tables hold no pools of T1."""
    out = policy.overall(_summary(spark, d), expected=3)
    return out.select("n_tasks", r6(F.col("average")).alias("average"))


def e_best_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct source assays behind the groups of each task."""
    return table(spark, d, "queries").groupBy("task").agg(F.count_distinct("source_assay").alias("num_assays"), F.count(F.lit(1)).alias("num_queries"))


QUERIES = {
    f.__name__: f
    for f in (
        e_truth, e_truth_quality, e_placed, e_placed_large, e_legal, e_groups_only, e_groups_both, e_nms, e_recall, e_ndcg, e_quality, e_average_rank, e_prediction_rank,
        e_spearman, e_replacement, e_flags, e_summary, e_overall, e_best_sources,
    )
} | {"e_mode1": _mode(1), "e_mode2": _mode(2), "e_mode1_large": _mode(1, True)}

_HEADS = BASE + """,
used AS (
  SELECT p.grp, p.item, order_value, row_number() OVER (PARTITION BY p.grp ORDER BY order_value, input_index, p.item) AS pos, t.score, t.gain, t.truth_rank,
    t.score IS NOT NULL AS legal
  FROM {pred} p LEFT JOIN places t ON t.grp = p.grp AND t.item = p.item),
ranked AS (SELECT *, pos = min(pos) OVER (PARTITION BY grp, item) AS first FROM used),
per AS (SELECT p.grp, max(k) AS k, max(p.n) AS n, max(lo) AS lo, max(hi) AS hi, max(least(k, p.n)) AS den,
    max(CASE WHEN place = least(k, p.n) THEN score END) AS threshold, sum(gain / log2(place + 1)) AS ideal
  FROM places p JOIN flags f ON f.grp = p.grp GROUP BY 1),
heads AS (
  SELECT per.grp, per.k, per.n, count(pos) AS predicted_rows, count(*) FILTER (WHERE pos <= k) AS selected_rows, count(*) FILTER (WHERE legal AND first) AS unique_legal,
    count(*) FILTER (WHERE legal AND first AND pos <= k) AS unique_legal_in_budget, count(*) FILTER (WHERE NOT legal) AS illegal_total,
    count(*) FILTER (WHERE NOT legal AND pos <= k) AS illegal_in_budget, count(*) FILTER (WHERE NOT first) AS duplicate_total,
    count(*) FILTER (WHERE legal AND NOT first AND pos <= k) AS duplicate_in_budget,
    CASE WHEN any_value(hi) <= any_value(lo) THEN 1.0 ELSE (coalesce(max(CASE WHEN legal AND pos <= k THEN score END), any_value(lo)) - any_value(lo)) / (any_value(hi) - any_value(lo)) END AS nms,
    count(*) FILTER (WHERE legal AND first AND pos <= k AND score >= threshold) / any_value(den) AS recall,
    coalesce(sum(CASE WHEN legal AND first AND pos <= per.n THEN gain / log2(pos + 1) END), 0.0) / any_value(ideal) AS ndcg
  FROM per LEFT JOIN ranked USING (grp) GROUP BY 1, 2, 3),
legal_first AS (SELECT grp, item, rank() OVER (PARTITION BY grp ORDER BY order_value) + (count(*) OVER (PARTITION BY grp, order_value) - 1) / 2.0 AS predicted_rank FROM ranked WHERE legal AND first),
m AS (SELECT grp, count(*) AS m FROM legal_first GROUP BY 1),
ranks AS (
  SELECT p.grp, p.item, p.truth_rank, CASE WHEN l.item IS NOT NULL THEN l.predicted_rank ELSE coalesce(m, 0) +
    row_number() OVER (PARTITION BY p.grp, l.item IS NULL ORDER BY sha256(p.grp || chr(0) || p.item)) END AS predicted_rank
  FROM places p LEFT JOIN legal_first l ON l.grp = p.grp AND l.item = p.item LEFT JOIN m ON m.grp = p.grp),
rho AS (
  SELECT grp, CASE WHEN sum(truth_rank * truth_rank) - sum(truth_rank) * sum(truth_rank) / count(*) <= 0 OR sum(predicted_rank * predicted_rank) - sum(predicted_rank) * sum(predicted_rank) / count(*) <= 0 THEN 0.0 ELSE
    (sum(truth_rank * predicted_rank) - sum(truth_rank) * sum(predicted_rank) / count(*)) / sqrt(sum(truth_rank * truth_rank) - sum(truth_rank) * sum(truth_rank) / count(*))
    / sqrt(sum(predicted_rank * predicted_rank) - sum(predicted_rank) * sum(predicted_rank) / count(*)) END AS spearman FROM (SELECT grp, CAST(truth_rank AS DOUBLE) AS truth_rank, CAST(predicted_rank AS DOUBLE) AS predicted_rank FROM ranks) GROUP BY 1)
"""
_H = _HEADS.format(pred="pred")
_DRAWN = """,
drawn AS (SELECT t.grp, t.item, row_number() OVER (PARTITION BY t.grp ORDER BY sha256('missing-query-random' || chr(0) || t.grp || chr(0) || t.item)) AS number, task, k
  FROM truth t JOIN flags f ON f.grp = t.grp)
"""


def _policy(status: str) -> str:
    decided = f""", decided AS (SELECT *, {status} AS status FROM flags WHERE NOT unknown),
    final AS (SELECT p.* FROM pred p JOIN decided d ON d.grp = p.grp AND status = 'provided'
      UNION ALL SELECT n.grp, item, CAST(number AS DOUBLE), number FROM drawn n JOIN decided d ON d.grp = n.grp AND status = 'random_replacement' AND (n.task <> 'T1' OR number <= n.k)) """
    heads = _HEADS.format(pred="final")[len(BASE) :]
    return BASE + _DRAWN + decided + heads + """, results AS (SELECT h.grp, task, status, provided, h.n, nms, recall, CASE WHEN task <> 'T1' THEN ndcg END AS ndcg,
      CASE WHEN task <> 'T1' THEN spearman END AS spearman, illegal_in_budget, duplicate_in_budget
      FROM heads h JOIN decided d ON d.grp = h.grp JOIN rho r ON r.grp = h.grp WHERE status <> 'skipped') """


_MODE1 = _policy("CASE WHEN (task = 'T1' AND (missing OR short)) OR (task <> 'T1' AND missing) THEN 'random_replacement' ELSE 'provided' END")
_MODE2 = _policy("CASE WHEN missing OR short OR incomplete THEN 'skipped' ELSE 'provided' END")
_METRICS = ", ".join(f"{sql_r6(m)} AS {m}" for m in policy.METRICS)
_RESULT = f"SELECT grp, task, status, provided, n, {_METRICS}, illegal_in_budget, duplicate_in_budget FROM results"
_SUMMARY = _MODE1 + """, q AS (SELECT grp, count(*) FILTER (WHERE score IS NULL) AS s, count(*) FILTER (WHERE item IS NULL) AS m,
    count(*) FILTER (WHERE item IS NOT NULL AND score IS NOT NULL) - count(DISTINCT CASE WHEN score IS NOT NULL THEN item END) AS dup FROM truth_rows GROUP BY 1),
  summ AS (SELECT f.task, count(*) FILTER (WHERE NOT unknown) AS num_target_cases, count(*) FILTER (WHERE missing) AS missing_groups, count(*) FILTER (WHERE unknown) AS unknown_groups,
    count(*) FILTER (WHERE short) AS short_groups, count(*) FILTER (WHERE unranked) AS unranked_groups, count(r.grp) AS num_queries, avg(nms) AS mean_nms, avg(recall) AS mean_recall,
    avg(ndcg) AS mean_ndcg, avg(spearman) AS mean_spearman, avg(illegal_in_budget) AS mean_illegal_in_budget, avg(duplicate_in_budget) AS mean_duplicate_in_budget,
    count(*) FILTER (WHERE status = 'random_replacement') AS random_replacement_cases, CAST(sum(s) AS BIGINT) AS invalid_score_rows, CAST(sum(m) AS BIGINT) AS invalid_mutant_rows, CAST(sum(dup) AS BIGINT) AS duplicates_collapsed
    FROM flags f LEFT JOIN results r ON r.grp = f.grp LEFT JOIN q ON q.grp = f.grp GROUP BY 1) """

SQL = {
    "e_truth": BASE + "SELECT * FROM truth",
    "e_truth_quality": BASE + """SELECT grp, count(*) AS raw_rows, count(*) FILTER (WHERE item IS NULL) AS invalid_mutant_rows, count(*) FILTER (WHERE score IS NULL) AS invalid_score_rows,
      count(DISTINCT CASE WHEN score IS NOT NULL THEN item END) AS num_truth, min(b) AS score_min, max(b) AS score_max,
      count(*) FILTER (WHERE item IS NOT NULL AND score IS NOT NULL) - count(DISTINCT CASE WHEN score IS NOT NULL THEN item END) AS duplicate_mutants_collapsed
      FROM (SELECT r.*, t.score AS b FROM truth_rows r LEFT JOIN truth t ON t.grp = r.grp AND t.item = r.item) GROUP BY 1""",
    "e_placed": BASE + """SELECT grp, count(*) AS n_rows, CAST(max(pos) AS INT) AS last_pos, CAST(sum(pos * (((input_index % 97) + 97) % 97)) AS BIGINT) AS order_sum FROM
      (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY order_value, input_index, item) AS pos FROM pred) GROUP BY 1""",
    "e_placed_large": BASE + """SELECT grp, count(*) AS n_rows, CAST(max(pos) AS INT) AS last_pos, CAST(sum(pos * (((input_index % 97) + 97) % 97)) AS BIGINT) AS order_sum FROM
      (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY order_value, input_index, item) AS pos FROM pred) GROUP BY 1""",
    "e_legal": _H + "SELECT grp, legal, first, count(*) AS n_rows, CAST(sum(pos) AS BIGINT) AS pos_sum FROM ranked GROUP BY 1, 2, 3",
    "e_groups_only": BASE + "SELECT grp, CASE WHEN missing THEN 'missing' ELSE 'unknown' END AS side FROM flags WHERE missing OR unknown",
    "e_groups_both": BASE + "SELECT grp FROM truth INTERSECT SELECT grp FROM pred",
    "e_nms": _H + f"SELECT grp, k, n, {sql_r6('nms')} AS nms FROM heads",
    "e_recall": _H + f"SELECT grp, {sql_r6('recall')} AS recall FROM heads",
    "e_ndcg": _H + f"SELECT grp, {sql_r6('ndcg')} AS ndcg FROM heads",
    "e_quality": _H + f"SELECT grp, {', '.join(_COUNTERS)} FROM heads",
    "e_average_rank": BASE + f"SELECT grp, item, CAST(place AS INT) AS place, CAST(truth_rank AS DOUBLE) AS truth_rank, {sql_r6('gain')} AS gain FROM places",
    "e_prediction_rank": _H + "SELECT grp, item, CAST(predicted_rank AS DOUBLE) AS predicted_rank FROM ranks",
    "e_spearman": _H + f"SELECT grp, {sql_r6('spearman')} AS spearman FROM rho",
    "e_replacement": BASE + _DRAWN + "SELECT grp, item, number AS input_index FROM drawn WHERE task <> 'T1' OR number <= k",
    "e_flags": BASE + "SELECT * FROM flags",
    "e_mode1": _MODE1 + _RESULT,
    "e_mode1_large": _MODE1 + _RESULT,
    "e_mode2": _MODE2 + _RESULT,
    "e_summary": _SUMMARY + "SELECT * REPLACE (" + ", ".join(f"{sql_r6('mean_' + m)} AS mean_{m}" for m in [*policy.METRICS, "illegal_in_budget", "duplicate_in_budget"]) + ") FROM summ",
    "e_overall": _SUMMARY + f"SELECT count(mean_nms) AS n_tasks, {sql_r6('avg(mean_nms)')} AS average FROM summ",
    "e_best_sources": "SELECT task, count(DISTINCT source_assay) AS num_assays, count(*) AS num_queries FROM queries GROUP BY 1",
}
