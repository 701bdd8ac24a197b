"""Shared bits of the registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import ranking
from tallyweave.session import table

STRIP = "chr(32) || chr(9) || chr(10) || chr(13)"


def r6(column: Column) -> Column:
    """Rounded for comparison; the shift keeps exact ties from falling either way."""
    return F.round(column + 1e-10, 6)


def sql_r6(text: str) -> str:
    return f"round({text} + 1e-10, 6)"


def truth_rows(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "candidates")
    return ranking.read_truth(raw.select(F.col("candidate_group_id").alias("grp"), F.col("mutant").alias("item"), F.col("dms_score").alias("score")))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return ranking.collapse(truth_rows(spark, d))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "predictions")
    return ranking.read_predictions(raw.select(F.col("assay").alias("grp"), F.col("mutant").alias("item"), "order_value", "input_index"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").groupBy(F.col("query_id").alias("grp")).agg(F.min("task").alias("task"))


BASE = f"""
WITH truth_rows AS (
  SELECT regexp_replace(trim(candidate_group_id, {STRIP}), '[.]csv$', '') AS grp, nullif(trim(mutant, {STRIP}), '') AS item,
    CASE WHEN isfinite(dms_score) THEN dms_score END AS score
  FROM candidates WHERE regexp_replace(trim(candidate_group_id, {STRIP}), '[.]csv$', '') <> ''),
truth AS (SELECT grp, item, max(score) AS score FROM truth_rows WHERE item IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2),
tasks AS (SELECT query_id AS grp, min(task) AS task FROM queries GROUP BY 1),
pred AS (
  SELECT regexp_replace(trim(assay, {STRIP}), '[.]csv$', '') AS grp, trim(mutant, {STRIP}) AS item, order_value, input_index FROM predictions
  WHERE isfinite(order_value) AND regexp_replace(trim(assay, {STRIP}), '[.]csv$', '') <> '' AND trim(mutant, {STRIP}) <> ''),
places AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, item) AS place,
    rank() OVER (PARTITION BY grp ORDER BY score DESC) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS truth_rank,
    count(*) OVER (PARTITION BY grp) AS n, min(score) OVER (PARTITION BY grp) AS lo, max(score) OVER (PARTITION BY grp) AS hi,
    CASE WHEN max(score) OVER (PARTITION BY grp) > min(score) OVER (PARTITION BY grp) THEN (score - min(score) OVER (PARTITION BY grp)) /
      (max(score) OVER (PARTITION BY grp) - min(score) OVER (PARTITION BY grp)) ELSE 1.0 END AS gain
  FROM truth),
sizes AS (SELECT grp, count(*) AS n FROM truth GROUP BY 1),
flags0 AS (
  SELECT coalesce(s.grp, p.grp) AS grp, coalesce(s.n, 0) AS n, coalesce(provided, 0) AS provided, s.grp IS NULL AS unknown, p.grp IS NULL AS missing, legal_items, twice, alien
  FROM sizes s FULL JOIN (
    SELECT grp, sum(c) AS provided, count(legal) AS legal_items, count(*) FILTER (WHERE c > 1) AS twice, count(*) FILTER (WHERE legal IS NULL) AS alien
    FROM (SELECT i.grp, i.item, c, t.score AS legal FROM (SELECT grp, item, count(*) AS c FROM pred GROUP BY 1, 2) i LEFT JOIN truth t ON t.grp = i.grp AND t.item = i.item) GROUP BY 1) p ON s.grp = p.grp),
flags AS (
  SELECT f.grp, coalesce(task, 'T2') AS task, CASE WHEN task = 'T1' THEN 40 ELSE 5 END AS k, n, CAST(provided AS BIGINT) AS provided, missing, unknown,
    NOT missing AND NOT unknown AND provided < least(n, CASE WHEN task = 'T1' THEN 40 ELSE 5 END) AS short,
    NOT missing AND NOT unknown AND coalesce(task, 'T2') <> 'T1' AND provided <> n AS incomplete,
    NOT missing AND NOT unknown AND coalesce(task, 'T2') <> 'T1' AND legal_items <> n AS unranked,
    NOT missing AND NOT unknown AND twice > 0 AS repeated, NOT missing AND NOT unknown AND coalesce(task, 'T2') <> 'T1' AND alien > 0 AS outside
  FROM flags0 f LEFT JOIN tasks t ON t.grp = f.grp)
"""
