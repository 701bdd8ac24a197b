"""Queries that prepare canonical tables and check them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import mutation
from tallyweave.operators import canonical, integrity
from tallyweave.plans.common import STRIP
from tallyweave.session import table

DATASET = "pool-1"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return canonical.parsed(canonical.pool(table(spark, d, "candidates"), table(spark, d, "queries"), table(spark, d, "assays")))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    distinct = canonical.distinct_pool(table(spark, d, "candidates"), table(spark, d, "queries"), table(spark, d, "assays"))
    return canonical.samples(canonical.parsed(distinct), DATASET)


def c_proteins(spark: SparkSession, d: str) -> DataFrame:
    return canonical.proteins(table(spark, d, "assays"))


def c_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by whether their mutant is legal and whether the given sequence is the recomputed one."""
    rows = _parsed(spark, d).withColumn("legal", F.col("components").isNotNull())
    agrees = F.when(F.col("given_sequence").isNull() | ~F.col("legal"), None).otherwise(F.col("given_sequence") == F.col("mutated_sequence"))
    return rows.groupBy("task", "legal", agrees.alias("sequence_agrees")).agg(F.count(F.lit(1)).alias("n_rows"))


def c_samples(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).drop("components", "wildtype_sequence", "bounds")


def c_substitutions(spark: SparkSession, d: str) -> DataFrame:
    return canonical.substitutions(_samples(spark, d))


def c_contexts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.msa_contexts(table(spark, d, "assays"))


def c_anchors(spark: SparkSession, d: str) -> DataFrame:
    return canonical.provided_context(table(spark, d, "queries"), table(spark, d, "assays"))


def c_anchor_samples(spark: SparkSession, d: str) -> DataFrame:
    """Context samples of the anchors, legal ones only."""
    anchors = c_anchors(spark, d).withColumn("given_sequence", F.lit(None).cast("string"))
    wild = table(spark, d, "assays").select(F.col("assay_id").alias("source_assay"), "wildtype_sequence")
    rows = canonical.parsed(anchors.join(F.broadcast(wild), "source_assay"))
    return canonical.samples(rows, DATASET, canonical.ANCHOR).select("sample_id", "task", "query_id", "source_assay", "sample_role", "mutant", "model_mutant", "mutation_count")


def c_query_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose expected number of samples isn't the actual one, either side missing included."""
    actual = table(spark, d, "candidates").filter("candidate_group_id IS NOT NULL").groupBy(F.col("candidate_group_id").alias("query_id")).agg(F.count(F.lit(1)).cast("int").alias("expected_samples"))
    return integrity.membership(table(spark, d, "queries").select("query_id", "expected_samples"), actual, ["query_id"], "expected_samples", "query_size")


def c_rules(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule on the canonical tables is broken (raw tables: repeated mutants, unknown assays)."""
    proteins, sampled = canonical.proteins(table(spark, d, "assays")), _samples(spark, d)
    subs = canonical.substitutions(sampled)
    raw = _parsed(spark, d)
    assays = table(spark, d, "assays")
    lengths = integrity.holds(assays, "assay_id", F.length(mutation.flat_sequence(F.col("wildtype_sequence"))) == F.col("sequence_length"), "assay_length")
    paths = F.size(F.split("a3m_relative_path", ";", -1)) == F.size(F.split("wildtype_sequence", ":", -1))
    said = [
        integrity.protein_rules(proteins), integrity.component_rules(sampled, subs, proteins), lengths, integrity.holds(assays, "assay_id", paths, "assay_paths"),
        integrity.unique(raw, ["task", "query_id", "mutant"], "repeated_mutant"), integrity.unique(assays, ["assay_id"], "assay_unique"),
        integrity.covers(table(spark, d, "queries").select(F.col("source_assay").alias("assay_id")), assays, ["assay_id"], "query_assay"),
        integrity.one_value(assays, ["wildtype_sequence"], ["uniprot_id"], "one_protein"),
        integrity.disjoint(sampled, c_anchor_samples(spark, d), ["sample_id"], "roles_disjoint"),
    ]
    return reduce(DataFrame.unionByName, said).groupBy("rule").agg(F.count(F.lit(1)).alias("n_broken"))


def c_dialects(spark: SparkSession, d: str) -> DataFrame:
    """Variant records under each notation: how many are valid, and why not."""
    wild = table(spark, d, "assays").select(F.col("assay_id").alias("source_assay"), mutation.flat_sequence(F.col("wildtype_sequence")).alias("wt"))
    rows = table(spark, d, "variant_records").select("source_assay", "original").join(F.broadcast(wild), "source_assay", "left")
    names = ["strict", "colon", "mixed", "prefixed"]
    said = F.inline(F.array(*[F.struct(F.lit(n).alias("dialect"), mutation.dialect(F.col("original"), F.col("wt"), n).alias("r")) for n in names]))
    return rows.select(said).groupBy("dialect", F.col("r.valid").alias("valid"), F.col("r.error").alias("error")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("r.normalized").alias("n_variants")
    )


def c_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per task: source assays, queries, samples."""
    sampled = _samples(spark, d).groupBy("task").agg(F.count(F.lit(1)).alias("evaluation_samples"))
    asked = table(spark, d, "queries").groupBy("task").agg(F.count_distinct("source_assay").alias("source_assays"), F.count(F.lit(1)).alias("queries"))
    return asked.join(sampled, "task", "left").withColumn("evaluation_samples", F.coalesce("evaluation_samples", F.lit(0)))


QUERIES = {f.__name__: f for f in (c_proteins, c_parsed, c_samples, c_substitutions, c_contexts, c_anchors, c_anchor_samples, c_query_sizes, c_rules, c_dialects, c_summary)}

_AA = "ACDEFGHIKLMNPQRSTVWY"


def _parse(rows: str, out: str, mutant: str = "mutant") -> str:
    """CTEs that parse ``mutant`` of ``rows`` (with wildtype_sequence): legal, parts as sorted list of (pos, wt, alt), mutated sequence."""
    return f"""
{out}0 AS (SELECT *, replace(wildtype_sequence, ':', '') AS flat, string_split_regex({mutant}, '[+:]') AS raw FROM {rows}),
{out}1 AS (SELECT *, CASE WHEN list_bool_and(list_transform(raw, lambda x: regexp_full_match(x, '[{_AA}][0-9]+[{_AA}]'))) THEN
    list_sort(list_transform(raw, lambda x: {{'pos': TRY_CAST(x[2:-2] AS INT), 'wt': x[1], 'alt': x[-1]}})) END AS parts FROM {out}0),
{out}2 AS (SELECT *, coalesce(parts IS NOT NULL AND list_bool_and(list_transform(parts, lambda x: coalesce(x.wt <> x.alt AND x.pos >= 1 AND substr(flat, x.pos, 1) = x.wt, false)))
    AND len(list_distinct(list_transform(parts, lambda x: x.pos))) = len(raw), false) AS legal FROM {out}1),
{out} AS (SELECT *, array_to_string(list_transform(parts, lambda x: x.wt || CAST(x.pos AS VARCHAR) || x.alt), ':') AS model_mutant FROM {out}2)"""


_POOL = f"""
WITH pool AS (SELECT row_id, task, query_id, q.source_assay, trim(c.mutant, {STRIP}) AS mutant, upper(trim(c.mutated_sequence, {STRIP})) AS given, upper(trim(wildtype_sequence, {STRIP})) AS wildtype_sequence
  FROM candidates c JOIN queries q ON c.candidate_group_id = q.query_id JOIN assays a ON a.assay_id = q.source_assay WHERE trim(c.mutant, {STRIP}) <> ''),""" + _parse("pool", "p")
# the mutated flat sequence, letter by letter, cut into chains again
_MUTATED = """,
uniq AS (SELECT *, row_number() OVER (PARTITION BY task, query_id, mutant ORDER BY row_id) AS nth FROM p WHERE legal),
letters AS (SELECT row_id, array_to_string(list_transform(range(1, length(flat) + 1), lambda i: coalesce(list_filter(parts, lambda x: x.pos = i)[1].alt, substr(flat, i, 1))), '') AS m,
    list_transform(string_split(wildtype_sequence, ':'), lambda x: length(x)) AS lens FROM p WHERE legal),
whole AS (SELECT row_id, array_to_string(list_transform(range(1, len(lens) + 1), lambda k: substr(m, 1 + CAST(coalesce(list_sum(lens[1:k-1]), 0) AS INT), lens[k])), ':') AS mutated_sequence FROM letters),
samples AS (SELECT sha256('{"dataset_id":"pool-1","mutant":"' || mutant || '","query_id":"' || query_id || '","sample_role":"evaluation_candidate","task":"' || task || '"}') AS sample_id,
    task, query_id, source_assay, 'evaluation_candidate' AS sample_role, mutant, model_mutant, CAST(len(parts) AS INT) AS mutation_count, substr(sha256(wildtype_sequence), 1, 16) AS wt_id,
    sha256(wildtype_sequence) AS sequence_sha256, mutated_sequence, parts, wildtype_sequence FROM uniq JOIN whole USING (row_id) WHERE nth = 1)"""
_SUBS = """,
flat_subs AS (SELECT sample_id, wildtype_sequence, unnest(range(1, len(parts) + 1)) AS component_index, unnest(parts) AS c FROM samples),
subs AS (SELECT sample_id, CAST(component_index AS INT) AS component_index, CAST(1 + length(pre) - length(replace(pre, ':', '')) AS INT) AS chain_id,
    CAST(length(pre) - coalesce(length(pre) - strpos(reverse(pre), ':') + 1, 0) * CASE WHEN pre LIKE '%:%' THEN 1 ELSE 0 END AS INT) AS chain_position, c.pos AS global_position, c.wt AS wt_aa, c.alt AS mut_aa
  FROM (SELECT *, list_filter(list_transform(range(1, length(wildtype_sequence) + 1), lambda i: substr(wildtype_sequence, 1, i)),
    lambda s: length(replace(s, ':', '')) = c.pos AND s[-1] <> ':')[1] AS pre FROM flat_subs))"""
_DIALECT = {
    "strict": ("'[+:]'", "text", "true"), "colon": ("':'", "text", "false"), "mixed": (r"'[:;,|\s]+'", "text", "false"),
    "prefixed": (r"'[+:;,|\s]+'", r"regexp_replace(text, '(^|[+:;,|\s])P\.', '\1', 'g')", "false"),
}
_DIALECTS = f"WITH v AS (SELECT upper(trim(coalesce(original, ''), {STRIP})) AS text, replace(wildtype_sequence, ':', '') AS wt FROM variant_records r LEFT JOIN assays a ON a.assay_id = r.source_assay), said AS (" + " UNION ALL ".join(
    f"""SELECT dialect, CASE WHEN dialect = 'prefixed' AND text IN ('', 'WT') THEN NULL WHEN text = '' OR wt IS NULL THEN 'empty' WHEN list_bool_or(list_transform(parts, lambda x: x.pos IS NULL)) THEN 'format'
      WHEN list_bool_or(list_transform(parts, lambda x: x.pos < 1 OR x.pos > length(wt))) THEN 'range' WHEN list_bool_or(list_transform(parts, lambda x: substr(wt, x.pos, 1) <> x.wt)) THEN 'residue'
      WHEN {same} AND list_bool_or(list_transform(parts, lambda x: x.wt = x.alt)) THEN 'synonymous' WHEN len(list_distinct(list_transform(parts, lambda x: x.pos))) < len(parts) THEN 'position' END AS error,
      CASE WHEN dialect = 'prefixed' AND text IN ('', 'WT') THEN 'WT' ELSE array_to_string(list_transform({'parts' if n == 'colon' else 'list_sort(parts)'}, lambda x: x.wt || CAST(x.pos AS VARCHAR) || x.alt), ':') END AS shown
      FROM (SELECT '{n}' AS dialect, text, wt, {'list_distinct' if n == 'prefixed' else ''}(list_transform(string_split_regex({column}, {split}), lambda x: CASE WHEN regexp_full_match(x, '[{_AA}][0-9]+[{_AA}]') THEN {{'pos': TRY_CAST(x[2:-2] AS INT), 'wt': x[1], 'alt': x[-1]}} ELSE {{'pos': NULL, 'wt': NULL, 'alt': NULL}} END)) AS parts FROM v)"""
    for n, (split, column, same) in _DIALECT.items()
) + ") SELECT dialect, error IS NULL AS valid, error, count(*) AS n_rows, count(DISTINCT CASE WHEN error IS NULL THEN shown END) AS n_variants FROM said GROUP BY 1, 2, 3"
_ANCHORS = f"SELECT task, query_id, q.source_assay, 'anchor_context' AS sample_role, trim(anchor_mutant, {STRIP}) AS mutant, anchor_dms_score AS visible_score FROM queries q JOIN assays a ON a.assay_id = q.source_assay WHERE task = 'T3' AND anchor_mutant IS NOT NULL"

SQL = {
    "c_proteins": f"""SELECT substr(sha256(s), 1, 16) AS wt_id, sha256(s) AS sequence_sha256, s AS wildtype_sequence, CAST(length(replace(s, ':', '')) AS INT) AS sequence_length, CAST(len(c) AS INT) AS n_chains,
      '["' || array_to_string(c, '","') || '"]' AS chain_sequences, '[' || array_to_string(list_transform(range(1, len(c) + 1), lambda k: '[' || CAST(1 + CAST(coalesce(list_sum(list_transform(c[1:k-1], lambda x: length(x))), 0) AS INT) AS VARCHAR)
        || ',' || CAST(CAST(list_sum(list_transform(c[1:k], lambda x: length(x))) AS INT) AS VARCHAR) || ']'), ',') || ']' AS chain_boundaries
      FROM (SELECT DISTINCT upper(trim(wildtype_sequence, {STRIP})) AS s, string_split(upper(trim(wildtype_sequence, {STRIP})), ':') AS c FROM assays WHERE wildtype_sequence <> '')""",
    "c_parsed": _POOL + _MUTATED + "SELECT task, legal, CASE WHEN given IS NOT NULL AND legal THEN given = mutated_sequence END AS sequence_agrees, count(*) AS n_rows FROM p LEFT JOIN whole USING (row_id) GROUP BY 1, 2, 3",
    "c_samples": _POOL + _MUTATED + "SELECT * EXCLUDE (parts, wildtype_sequence) FROM samples",
    "c_substitutions": _POOL + _MUTATED + _SUBS + "SELECT * FROM subs",
    "c_contexts": f"""SELECT sha256(chain) AS context_sha256, CAST(length(chain) AS INT) AS sequence_length, chain AS chain_sequence, min(path) AS a3m_path, count(DISTINCT path) AS n_paths FROM
      (SELECT unnest(string_split(upper(trim(wildtype_sequence, {STRIP})), ':')) AS chain, unnest(string_split(a3m_relative_path, ';')) AS path FROM assays) WHERE chain <> '' GROUP BY chain""",
    "c_anchors": _ANCHORS,
    "c_anchor_samples": f"WITH anchors AS (SELECT x.*, wildtype_sequence FROM ({_ANCHORS}) x JOIN assays a ON a.assay_id = x.source_assay)," + _parse("anchors", "p") + """
      SELECT DISTINCT sha256('{"dataset_id":"pool-1","mutant":"' || mutant || '","query_id":"' || query_id || '","sample_role":"anchor_context","task":"' || task || '"}') AS sample_id, task, query_id, source_assay,
      sample_role, mutant, model_mutant, CAST(len(parts) AS INT) AS mutation_count FROM p WHERE legal""",
    "c_query_sizes": """SELECT 'query_size' AS rule, coalesce(q.query_id, c.g) AS key, coalesce(CAST(expected_samples AS VARCHAR), 'none') || '/' || coalesce(CAST(n AS VARCHAR), 'none') AS detail
      FROM queries q FULL JOIN (SELECT candidate_group_id AS g, count(*) AS n FROM candidates WHERE candidate_group_id IS NOT NULL GROUP BY 1) c ON c.g = q.query_id WHERE expected_samples IS DISTINCT FROM n OR n IS NULL""",
    "c_rules": _POOL + """ SELECT * FROM (
      SELECT 'repeated_mutant' AS rule, count(*) AS n_broken FROM (SELECT 1 FROM p GROUP BY task, query_id, mutant HAVING count(*) > 1)
      UNION ALL SELECT 'one_protein', count(*) FROM (SELECT 1 FROM assays GROUP BY wildtype_sequence HAVING min(uniprot_id) <> max(uniprot_id))
      UNION ALL SELECT 'assay_length', count(*) FROM assays WHERE coalesce(length(replace(wildtype_sequence, ':', '')) <> sequence_length, true)
      UNION ALL SELECT 'assay_paths', count(*) FROM assays WHERE coalesce(len(string_split(a3m_relative_path, ';')) <> len(string_split(wildtype_sequence, ':')), true)
      UNION ALL SELECT 'assay_unique', count(*) FROM (SELECT 1 FROM assays GROUP BY assay_id HAVING count(*) > 1)
      UNION ALL SELECT 'query_assay', count(DISTINCT source_assay) FROM queries WHERE source_assay NOT IN (SELECT assay_id FROM assays)) WHERE n_broken > 0""",
    "c_dialects": _DIALECTS,
    "c_summary": _POOL + _MUTATED + """SELECT q.task, count(DISTINCT q.source_assay) AS source_assays, count(*) AS queries, coalesce(any_value(s.n), 0) AS evaluation_samples
      FROM queries q LEFT JOIN (SELECT task, count(*) AS n FROM samples GROUP BY 1) s ON s.task = q.task GROUP BY 1""",
}
