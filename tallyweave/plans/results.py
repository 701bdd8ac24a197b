"""Queries over shard rows and model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import mutation, text
from tallyweave.operators import finalize, ranking, responses
from tallyweave.plans.common import STRIP, r6, sql_r6
from tallyweave.session import table

_SHARDS = 32
#: What a log may tell; the words are invented.
_TOLD = [
    "Authorization: Bearer abc.def-123", "API key = k12345 left", "using sk-proj-abcdefghijklmnop now", "token xai-AB.cd_ef-0123456789.", "access token:zzz bearer token = Bearer y1",
    "MODEL_API_KEY=abc", "authorization : none", "sk-short stays", "apikey:a api_key=b",
]


def f_rules(spark: SparkSession, d: str) -> DataFrame:
    return finalize.shard_rules(table(spark, d, "shard_rows")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_broken"))


def f_shards(spark: SparkSession, d: str) -> DataFrame:
    return finalize.shard_numbers(table(spark, d, "shard_rows"), _SHARDS)


def f_summed(spark: SparkSession, d: str) -> DataFrame:
    out = finalize.summed_chains(table(spark, d, "shard_rows"))
    return out.select("model_id", "sample_id", *finalize.IDENTITY, "n_chains", *[r6(F.col(c)).alias(c) for c in finalize.SCORES])


def f_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the queries against groups with results, by task and model."""
    results = finalize.summed_chains(table(spark, d, "shard_rows")).select("model_id", F.col("subset").alias("task"), F.col("candidate_group_id").alias("query_id")).dropna()
    # models are few and the queries' side stays small: each query is expected of each model that has results
    models = F.broadcast(results.select("model_id").distinct().groupBy().agg(F.collect_set("model_id").alias("models")))
    expected = table(spark, d, "queries").select("task", "query_id", F.lit(1).alias("one")).join(models.withColumn("one", F.lit(1)), "one")
    expected = expected.select("task", "query_id", F.explode("models").alias("model_id"))
    return finalize.coverage(expected, results, ["model_id", "task", "query_id"]).groupBy("model_id", "task", "found").agg(F.count(F.lit(1)).alias("n_queries"))


def f_export(spark: SparkSession, d: str) -> DataFrame:
    """Per task and model: rows and queries the evaluation gets, and the score's range."""
    out = finalize.evaluator_rows(finalize.summed_chains(table(spark, d, "shard_rows")), "masked_marginal")
    return out.groupBy("task", "model_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("assay").alias("n_queries"), r6(F.min("score")).alias("lowest"), r6(F.max("score")).alias("highest"))


def f_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Long form of per-model, per-task means."""
    out = finalize.summed_chains(table(spark, d, "shard_rows")).groupBy("model_id", F.col("subset").alias("task")).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("masked_marginal").alias("mean_marginal"), F.max("n_chains").alias("most_chains"))
    return finalize.long_form(out, ["model_id", "task"], ["n_samples", "mean_marginal", "most_chains"]).select("model_id", "task", "metric", r6(F.col("value")).alias("value"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source = 'llm_response'")
    return docs.select("doc_id", "source_assay", "text", responses.extracted_ranking(F.col("text")).alias("ranking"))


def r_rankings(spark: SparkSession, d: str) -> DataFrame:
    return responses.long_ranking(_responses(spark, d), "doc_id", "ranking")


def _greedy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source = 'llm_response'")
    named = docs.select("doc_id", "source_assay", "task", F.posexplode(responses.greedy_ranking(F.col("text"))).alias("i", "mutant"))
    return named.select("doc_id", "source_assay", "task", (F.col("i") + 1).alias("rank"), "mutant")


def r_greedy(spark: SparkSession, d: str) -> DataFrame:
    return _greedy(spark, d).select("doc_id", "rank", "mutant")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each assay's queries of a task, with that group's name."""
    asked = table(spark, d, "queries").select(F.col("query_id").alias("candidate_group_id"), F.concat_ws("|", "source_assay", "task").alias("grp"))
    return table(spark, d, "candidates").join(asked, "candidate_group_id").select("grp", text.nonblank(F.col("mutant")).alias("mutant")).dropna()


def r_closed_set(spark: SparkSession, d: str) -> DataFrame:
    """Named mutants against the candidates of the queries that the response's assay has in its task."""
    rows = _greedy(spark, d).select("doc_id", F.concat_ws("|", "source_assay", "task").alias("grp"), "rank", "mutant")
    return responses.closed_set(rows, _pool(spark, d), "doc_id", "grp")


def r_generated(spark: SparkSession, d: str) -> DataFrame:
    """Free proposals; those of an assay and task with candidates have to be among them to count as measured."""
    wild = table(spark, d, "assays").select(F.col("assay_id").alias("source_assay"), mutation.flat_sequence(F.col("wildtype_sequence")).alias("wt"))
    named = _greedy(spark, d).withColumn("grp", F.concat_ws("|", "source_assay", "task")).join(F.broadcast(wild), "source_assay", "left")
    pool = _pool(spark, d).distinct()
    groups = pool.select("grp").distinct().withColumn("known", F.lit(True))
    named = named.join(groups, "grp", "left").join(pool.withColumn("there", F.lit(True)), ["grp", "mutant"], "left")
    measured = F.when(F.col("known"), F.coalesce("there", F.lit(False)))
    return responses.generated(named.select("doc_id", "rank", "mutant", "wt", measured.alias("measured")), "doc_id", 5)


def r_marks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    counted = responses.marks(F.col("text"), ["execute", "solution"])
    return docs.select("doc_id", *counted.values(), F.array_join(responses.mentions(F.col("text"), r"\b(score_[a-z]+|rank_[a-z]+)\b"), ",").alias("tools"))


def r_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Logs, each with a line that tells credentials, with assay names of one family taken as secrets."""
    logs = table(spark, d, "documents").filter("source = 'agent_log'")
    told = F.array(*[F.lit(x) for x in _TOLD])
    logs = logs.select("doc_id", F.concat("text", F.lit("\n"), F.get(told, F.pmod("doc_id", F.lit(len(_TOLD))).cast("int"))).alias("text"))
    return logs.select("doc_id", F.md5(text.redact(F.col("text"), ["ALGAV_S25", "ALGAV_S2", "timeout"])).alias("digest"))


def r_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Heads of the prompts of all queries: wild type, what is measured, how many candidates there are."""
    a = table(spark, d, "assays").select(F.col("assay_id").alias("source_assay"), "wildtype_sequence", "anchor_mutant", "readout_subclass")
    pool = table(spark, d, "candidates").select(F.col("candidate_group_id").alias("query_id"), text.nonblank(F.col("mutant")).alias("m")).dropna()
    lists = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "queries").join(F.broadcast(a), "source_assay").join(lists, "query_id", "left")
    shown = F.coalesce(text.nonblank(F.col("readout_subclass")), F.lit("unknown"))
    values = {
        "readout": shown, "anchor": F.col("anchor_mutant"), "wt": F.col("wildtype_sequence"), "k": ranking.top_k(F.col("task")), "n": F.coalesce("n", F.lit(0)),
        "singles": responses.scored_lines(F.array(F.coalesce("anchor_mutant", F.lit("none"))), F.array(F.lit("1.0"))),
    }
    body = responses.prompted(F.col("task"), values)
    return rows.select("task", "query_id", F.md5(body).alias("digest"), F.length(body).alias("n_chars"))


def r_written(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source = 'llm_response'")
    rows = docs.select(F.col("source_assay").alias("assay"), responses.greedy_ranking(F.col("text")).alias("ranking"), F.lit("m").alias("model"), F.concat(F.lit('{"doc":'), F.col("doc_id").cast("string"), F.lit("}")).alias("usage_json"))
    return responses.written_predictions(rows.filter("size(ranking) > 0")).groupBy("assay", "rank").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("usage_json") != "").alias("n_described"))


def r_safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", text.safe_component(F.col("source_csv"), 40).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (f_rules, f_shards, f_summed, f_coverage, f_export, f_leaderboard, r_rankings, r_greedy, r_closed_set, r_generated, r_marks, r_redacted, r_prompts, r_written, r_safe_names)
}

_LOGS = f"SELECT doc_id, text || chr(10) || list_extract([{', '.join(repr(x) for x in _TOLD)}], CAST(((doc_id % {len(_TOLD)}) + {len(_TOLD)}) % {len(_TOLD)} AS INT) + 1) AS text FROM documents WHERE source = 'agent_log'"
_OK = f"coalesce(lower(trim(status, {STRIP})) = 'ok', false)"
_FIN = " AND ".join(f"coalesce(isfinite({c}), false)" for c in finalize.SCORES)
_SUMMED = f"""
WITH good AS (SELECT *, row_number() OVER (PARTITION BY model_id, sample_id, chain_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS nth FROM shard_rows
  WHERE {_OK} AND model_id IS NOT NULL AND sample_id <> ''),
summed AS (SELECT model_id, sample_id, {', '.join(f'min({c}) AS {c}' for c in finalize.IDENTITY)}, count(*) AS n_chains, {', '.join(f'sum({c}) AS {c}' for c in finalize.SCORES)}
  FROM good WHERE nth = 1 AND {_FIN} GROUP BY 1, 2)
"""
_KNOWN = "model_id IS NOT NULL AND sample_id IS NOT NULL"
#: Responses that are JSON as a whole or from their first to their last brace.
_GREEDY = r"""
WITH t AS (SELECT doc_id, source_assay, task, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents WHERE source = 'llm_response'),
bare AS (SELECT * REPLACE (CASE WHEN contains(x, '```') THEN regexp_replace(regexp_replace(regexp_replace(x, '^```(?:json)?', ''), '```$', ''), '^\s+|\s+$', '', 'g') ELSE x END AS x) FROM t),
span AS (SELECT * EXCLUDE (x), CASE WHEN json_valid(x) THEN x WHEN strpos(x, '{') > 0 THEN substr(x, strpos(x, '{'), length(x) - strpos(reverse(x), '}') + 2 - strpos(x, '{')) END AS x FROM bare),
found AS (SELECT doc_id, source_assay, task, list_filter(list_transform(CAST(json_extract(x, '$.ranking') AS JSON[]), lambda v: regexp_replace(json_extract_string(v, '$'), '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS l
  FROM span WHERE json_valid(x) AND json_type(x, '$.ranking') = 'ARRAY'),
g AS (SELECT doc_id, source_assay, task, concat_ws('|', source_assay, task) AS grp, CAST(unnest(range(1, len(l) + 1)) AS INT) AS rank, unnest(l) AS mutant FROM found)
"""
_POOLS = f""", pool AS (SELECT DISTINCT concat_ws('|', source_assay, task) AS grp, trim(mutant, {STRIP}) AS mutant FROM candidates c JOIN queries q ON q.query_id = c.candidate_group_id WHERE trim(mutant, {STRIP}) <> '')"""
_NAME_CLEAN = "regexp_replace(regexp_replace(regexp_replace(source_csv, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', ''), '[._]+$', '')"

SQL = {
    "f_rules": f"""SELECT * FROM (SELECT 'status_ok' AS rule, count(*) AS n_broken FROM shard_rows WHERE NOT {_OK}
      UNION ALL SELECT 'finite_scores', count(*) FROM shard_rows WHERE {_OK} AND NOT ({_FIN})
      UNION ALL SELECT 'identity_present', count(*) FROM shard_rows WHERE model_id IS NULL OR coalesce(trim(sample_id, {STRIP}), '') = ''
      UNION ALL SELECT 'identity_agrees', count(*) FROM (SELECT 1 FROM shard_rows WHERE {_KNOWN} GROUP BY model_id, sample_id HAVING {' OR '.join(f'min({c}) <> max({c})' for c in finalize.IDENTITY)})
      UNION ALL SELECT 'delivered_once', count(*) FROM (SELECT 1 FROM shard_rows WHERE {_KNOWN} GROUP BY model_id, sample_id, chain_id HAVING count(*) > 1)) WHERE n_broken > 0""",
    "f_shards": f"SELECT model_id, count(DISTINCT shard_id) AS shards, {_SHARDS} - count(DISTINCT shard_id) AS missing FROM shard_rows WHERE shard_id BETWEEN 0 AND {_SHARDS - 1} AND model_id IS NOT NULL GROUP BY 1",
    "f_summed": _SUMMED + f"SELECT model_id, sample_id, {', '.join(finalize.IDENTITY)}, n_chains, {', '.join(f'{sql_r6(c)} AS {c}' for c in finalize.SCORES)} FROM summed",
    "f_coverage": _SUMMED + """, r AS (SELECT DISTINCT model_id, subset AS task, candidate_group_id AS query_id FROM summed WHERE subset IS NOT NULL AND candidate_group_id IS NOT NULL),
      e AS (SELECT DISTINCT model_id, task, query_id FROM queries, (SELECT DISTINCT model_id FROM r))
      SELECT coalesce(e.model_id, r.model_id) AS model_id, coalesce(e.task, r.task) AS task, CASE WHEN e.task IS NULL THEN 'result_only' WHEN r.task IS NULL THEN 'expected_only' ELSE 'both' END AS found, count(*) AS n_queries
      FROM e FULL JOIN r ON e.model_id = r.model_id AND e.task = r.task AND e.query_id = r.query_id GROUP BY 1, 2, 3""",
    "f_export": _SUMMED + f"SELECT subset AS task, model_id, count(*) AS n_rows, count(DISTINCT candidate_group_id) AS n_queries, {sql_r6('min(masked_marginal)')} AS lowest, {sql_r6('max(masked_marginal)')} AS highest FROM summed WHERE candidate_group_id IS NOT NULL AND mutant IS NOT NULL GROUP BY 1, 2",
    "f_leaderboard": _SUMMED + f""", s AS (SELECT model_id, subset AS task, CAST(count(*) AS DOUBLE) AS n_samples, avg(masked_marginal) AS mean_marginal, CAST(max(n_chains) AS DOUBLE) AS most_chains FROM summed GROUP BY 1, 2)
      SELECT model_id, task, metric, {sql_r6('value')} AS value FROM (SELECT model_id, task, unnest(['n_samples', 'mean_marginal', 'most_chains']) AS metric, unnest([n_samples, mean_marginal, most_chains]) AS value FROM s)""",
    "r_marks": r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)<execute\b')) AS INT) AS n_execute, CAST(len(regexp_extract_all(text, '(?i)<solution\b')) AS INT) AS n_solution,
      coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b(score_[a-z]+|rank_[a-z]+)\b', 1))), ','), '') AS tools FROM documents WHERE text IS NOT NULL""",
    "r_redacted": rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(replace(text, 'ALGAV_S25', '[REDACTED]'), 'ALGAV_S2', '[REDACTED]'), 'timeout', '[REDACTED]'),
      '(?i)(api\s*key|api_key|authorization|bearer\s+token|access\s*token)(\s*[:=]\s*)(bearer\s+)?\S+', '\1\2[REDACTED]', 'g'), '\b(sk|sk-proj|sk-ant|xai)-[A-Za-z0-9._-]{{12,}}\b', '[REDACTED]', 'g')) AS digest
      FROM ({_LOGS})""",
    "r_prompts": f"""WITH c AS (SELECT candidate_group_id AS query_id, nullif(trim(mutant, {STRIP}), '') AS m FROM candidates),
      l AS (SELECT query_id, count(*) AS n FROM c WHERE m IS NOT NULL AND query_id IS NOT NULL GROUP BY 1),
      v AS (SELECT task, q.query_id, 'Sequence: ' || coalesce(wildtype_sequence, '') || chr(10) AS s, 'Readout: ' || coalesce(nullif(trim(readout_subclass, {STRIP}), ''), 'unknown') || chr(10) AS r, anchor_mutant AS a,
        CAST(coalesce(n, 0) AS VARCHAR) || ' candidates follow, one a line.' AS c FROM queries q JOIN assays a ON a.assay_id = q.source_assay LEFT JOIN l ON l.query_id = q.query_id),
      b AS (SELECT task, query_id, s || CASE task WHEN 'T1' THEN 'Name up to 40 single substitutions, best first, as {{"ranking": [...]}}' ELSE r || CASE task WHEN 'T3' THEN 'Measured: ' || coalesce(a, '') || chr(10)
        WHEN 'T4' THEN 'Single substitutions measured:' || chr(10) || coalesce(a, 'none') || ': 1.0' || chr(10) ELSE '' END || 'Order all candidates, best first, as {{"ranking": [...]}}' || chr(10) || c END AS b FROM v)
      SELECT task, query_id, md5(b) AS digest, CAST(length(b) AS INT) AS n_chars FROM b""",
    "r_greedy": _GREEDY + "SELECT doc_id, rank, mutant FROM g",
    "r_closed_set": _GREEDY + _POOLS + """, f AS (SELECT g.*, p.mutant IS NOT NULL AS legal, rank = min(rank) OVER (PARTITION BY doc_id, g.mutant) AS first FROM g LEFT JOIN pool p ON p.grp = g.grp AND p.mutant = g.mutant)
      SELECT doc_id, grp, rank, mutant, CASE WHEN NOT legal THEN 'outside' WHEN first THEN 'kept' ELSE 'duplicate' END AS verdict,
        CAST(CASE WHEN legal AND first THEN sum(CASE WHEN legal AND first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rank) END AS INT) AS new_rank FROM f""",
    "r_generated": _GREEDY + _POOLS + f""", w AS (SELECT g.doc_id, g.rank, g.mutant, regexp_full_match(g.mutant, '[{mutation.RESIDUES}][0-9]+[{mutation.RESIDUES}]') AND g.mutant[1] <> g.mutant[-1]
        AND coalesce(substr(replace(wildtype_sequence, ':', ''), TRY_CAST(g.mutant[2:-2] AS INT), 1) = g.mutant[1], false) AND TRY_CAST(g.mutant[2:-2] AS INT) >= 1 AS legal,
        CASE WHEN g.grp IN (SELECT grp FROM pool) THEN p.mutant IS NOT NULL ELSE true END AS measured
        FROM g LEFT JOIN assays a ON a.assay_id = g.source_assay LEFT JOIN pool p ON p.grp = g.grp AND p.mutant = g.mutant),
      o AS (SELECT *, coalesce(legal, false) AS lg, coalesce(legal, false) AND measured AS ok, rank = min(rank) OVER (PARTITION BY doc_id, mutant) AS new FROM w),
      b AS (SELECT *, coalesce(sum(CASE WHEN ok AND new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
      SELECT doc_id, count(*) FILTER (WHERE ok AND new) AS accepted, count(*) FILTER (WHERE NOT lg) AS invalid, count(*) FILTER (WHERE ok AND NOT new) AS duplicate, count(*) FILTER (WHERE lg AND NOT ok) AS not_measured
      FROM b WHERE before < 5 GROUP BY 1""",
    "r_written": _GREEDY + "SELECT source_assay AS assay, rank, count(*) AS n_rows, count(*) FILTER (WHERE rank = 1) AS n_described FROM g GROUP BY 1, 2",
    "r_safe_names": f"""SELECT query_id, CASE WHEN length(c) <= 40 THEN c ELSE substr(c, 1, 29) || '_' || substr(sha1(source_csv), 1, 10) END AS name
      FROM (SELECT query_id, source_csv, CASE WHEN {_NAME_CLEAN} = '' THEN 'unknown' ELSE {_NAME_CLEAN} END AS c FROM queries)""",
}
