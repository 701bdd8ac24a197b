"""Queries of the general data problems: rejected rows, packed fields, dominant keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import balance, packed, rejects
from tallyweave.session import table

_SHARD_KEYS = ["source_assay", "context_sha256"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.violations(table(spark, d, "raw_lines"), table(spark, d, "assays"))


def p1_truth(spark: SparkSession, d: str) -> DataFrame:
    return rejects.clean_rows(table(spark, d, "raw_lines"), table(spark, d, "assays"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = rejects.rejected(table(spark, d, "raw_lines"), table(spark, d, "assays"))
    return found.groupBy("reasons").agg(F.count(F.lit(1)).alias("n_lines"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.flatten_packed(table(spark, d, "mutation_tasks"), "task_no", "mutants")


def p3_results(spark: SparkSession, d: str) -> DataFrame:
    out = balance.balanced_results(table(spark, d, "shard_rows"), _SHARD_KEYS, "sample_id", "masked_marginal", "row_id")
    return out.select("field", "key_val", "n_rows", "n_samples", F.round(F.col("mean_measure") + 1e-10, 6).alias("mean_masked_marginal"))


def p3_assays(spark: SparkSession, d: str) -> DataFrame:
    """Scored rows with their assay's length, the assay side replicated to the hot assays' shards."""
    rows = table(spark, d, "shard_rows").select("row_id", F.col("source_assay").alias("assay_id"), "chain_id")
    joined = balance.replicated_join(rows, table(spark, d, "assays").select("assay_id", "sequence_length"), "assay_id", "row_id")
    return joined.groupBy("sequence_length").agg(F.count(F.lit(1)).alias("n_rows"), F.count("chain_id").alias("n_chains"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return balance.hot_keys(table(spark, d, "shard_rows"), _SHARD_KEYS, "sample_id", "masked_marginal", "row_id", 0.04)


QUERIES = {f.__name__: f for f in (p1_found, p1_truth, p1_reasons, p2_found, p3_found, p3_results, p3_assays)}

_LINES = r"""
WITH heads AS (
  SELECT source_csv, list_transform(regexp_extract_all(',' || h, ',(?:"(?:[^"]|"")*"|[^",]*)'),
    lambda x: CASE WHEN substr(x, 2, 1) = '"' THEN replace(substr(x, 3, length(x) - 3), '""', '"') ELSE substr(x, 2) END) AS names
  FROM (SELECT source_csv, ltrim(rtrim(raw_line, chr(13)), chr(65279)) AS h FROM raw_lines WHERE line_no = 1)),
body AS (
  SELECT line_id, source_csv, source_assay,
    CASE WHEN raw_line LIKE '%' || chr(13) THEN substr(raw_line, 1, length(raw_line) - 1) ELSE coalesce(raw_line, '') END AS b
  FROM raw_lines WHERE line_no > 1),
cut AS (
  SELECT *, regexp_extract_all(',' || b, ',(?:"(?:[^"]|"")*"|[^",]*)') AS cells,
    regexp_full_match(b, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS sound FROM body),
named AS (
  SELECT line_id, source_assay, sound, names IS NOT NULL AND len(names) = len(cells) AS fits,
    list_transform(cells, lambda x: CASE WHEN substr(x, 2, 1) = '"' THEN replace(substr(x, 3, length(x) - 3), '""', '"') ELSE substr(x, 2) END) AS cells, names
  FROM cut LEFT JOIN heads USING (source_csv)),
typed AS (
  SELECT n.line_id, n.source_assay, sound, fits, replace(wildtype_sequence, ':', '') AS wt,
    trim(coalesce(cells[list_position(names, 'candidate_group_id')], ''), chr(32) || chr(9) || chr(10) || chr(13)) AS grp,
    upper(trim(coalesce(cells[list_position(names, 'mutant')], ''), chr(32) || chr(9) || chr(10) || chr(13))) AS m,
    trim(coalesce(cells[list_position(names, 'DMS_score')], ''), chr(32) || chr(9) || chr(10) || chr(13)) AS s
  FROM named n LEFT JOIN assays a ON a.assay_id = n.source_assay),
judged AS (
  SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN NOT fits THEN 'column_count' END AS broken,
    CASE WHEN m = '' THEN 'blank_mutant'
      WHEN NOT regexp_full_match(m, '[ACDEFGHIKLMNPQRSTVWY][0-9]+[ACDEFGHIKLMNPQRSTVWY]([+:][ACDEFGHIKLMNPQRSTVWY][0-9]+[ACDEFGHIKLMNPQRSTVWY])*') THEN 'bad_mutant'
      WHEN wt IS NULL OR NOT list_bool_and(list_transform(string_split_regex(m, '[+:]'), lambda x:
             x[1] <> x[-1] AND coalesce(substr(wt, TRY_CAST(x[2:-2] AS INT), 1) = x[1], false)))
        OR len(list_distinct(list_transform(string_split_regex(m, '[+:]'), lambda x: TRY_CAST(x[2:-2] AS INT)))) <> len(string_split_regex(m, '[+:]'))
        THEN 'bad_mutant' END AS bad_m,
    CASE WHEN NOT regexp_full_match(s, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') OR coalesce(isinf(TRY_CAST(s AS DOUBLE)), true) THEN 'bad_score' END AS bad_s
  FROM typed)
"""

_HOT = " UNION ALL ".join(
    f"SELECT '{k}' AS field, {k} AS key_val, row_id, sample_id, masked_marginal FROM shard_rows WHERE {k} <> ''" for k in _SHARD_KEYS
)

_Q = "\"[^\"]*\"|''[^'']*''|`[^`]*`|´[^´]*´|“[^”]*”|„[^”]*”|‘[^’]*’|‚[^’]*’|«[^»]*»|‹[^›]*›|「[^」]*」|『[^』]*』|＂[^＂]*＂|＇[^＇]*＇"
_S = "[A-Za-z][0-9]+[A-Za-z]"

SQL = {
    "p1_found": _LINES
    + """SELECT line_id, broken AS reason FROM judged WHERE broken IS NOT NULL
         UNION ALL SELECT line_id, bad_m FROM judged WHERE broken IS NULL AND bad_m IS NOT NULL
         UNION ALL SELECT line_id, bad_s FROM judged WHERE broken IS NULL AND bad_s IS NOT NULL""",
    "p1_truth": _LINES
    + """SELECT line_id, source_assay, nullif(grp, '') AS candidate_group_id, m AS mutant, CAST(s AS DOUBLE) AS dms_score
         FROM judged WHERE broken IS NULL AND bad_m IS NULL AND bad_s IS NULL""",
    "p1_reasons": _LINES
    + """SELECT reasons, count(*) AS n_lines FROM (SELECT coalesce(broken, concat_ws(',', CASE WHEN bad_m = 'bad_mutant' THEN bad_m END, bad_s,
         CASE WHEN bad_m = 'blank_mutant' THEN bad_m END)) AS reasons FROM judged) WHERE reasons <> '' GROUP BY reasons""",
    "p2_found": f"""
      WITH items AS (SELECT task_no, regexp_extract_all(mutants, '{_Q}|{_S}(?: *[+:] *{_S})*') AS found FROM mutation_tasks),
      one AS (SELECT task_no, list_filter(list_transform(found, lambda x: regexp_extract_all(x, '{_S}')), lambda x: len(x) > 0) AS found FROM items),
      mutant AS (SELECT task_no, unnest(range(1, len(found) + 1)) AS item_pos, unnest(found) AS subs FROM one)
      SELECT task_no, CAST(item_pos AS INT) AS item_pos, CAST(unnest(range(1, len(subs) + 1)) AS INT) AS sub_pos, upper(unnest(subs)) AS substitution FROM mutant""",
    "p3_found": f"SELECT field, key_val FROM ({_HOT}) GROUP BY 1, 2 HAVING count(*) >= 0.04 * (SELECT count(*) FROM shard_rows)",
    "p3_results": f"""SELECT field, key_val, count(*) AS n_rows, count(DISTINCT nullif(sample_id, '')) AS n_samples,
      round(avg(CASE WHEN isfinite(masked_marginal) THEN masked_marginal END) + 1e-10, 6) AS mean_masked_marginal FROM ({_HOT}) GROUP BY 1, 2""",
    "p3_assays": """SELECT a.sequence_length, count(*) AS n_rows, count(s.chain_id) AS n_chains
      FROM shard_rows s LEFT JOIN assays a ON a.assay_id = s.source_assay GROUP BY 1""",
}
