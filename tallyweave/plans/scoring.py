"""Queries that expand samples to contexts and score them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import arrays, mutation, windows
from tallyweave.operators import canonical, contexts, scoring
from tallyweave.plans.common import r6, sql_r6
from tallyweave.plans.preparation import _MUTATED, _POOL, _SUBS, _samples
from tallyweave.session import cut, finite, table

_WIDTH = 100


def _components(spark: SparkSession, d: str) -> DataFrame:
    sampled = _samples(spark, d)
    return contexts.components(sampled, canonical.proteins(table(spark, d, "assays")))


def x_components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).select("sample_id", "component_index", "chain_id", "chain_position", "wt_aa", "mut_aa", "context_sha256")


def x_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = contexts.statistics(_components(spark, d))
    return out.select("context_sha256", "n_samples", "n_components", "n_positions", F.array_join("positions", ",").alias("positions"), "length")


def x_variant_keys(spark: SparkSession, d: str) -> DataFrame:
    return contexts.variant_keys(_components(spark, d))


def x_windows(spark: SparkSession, d: str) -> DataFrame:
    """The four window rules at each needed position, 100 wide."""
    rows = _components(spark, d).select("context_sha256", F.length("chain").alias("n"), F.col("chain_position").alias("p")).distinct()
    c, h = windows.centred(F.col("n"), F.col("p"), _WIDTH), windows.half_open(F.col("n"), F.col("p") - 1, _WIDTH)
    return rows.select("context_sha256", "p", c["first"].alias("c_first"), c["last"].alias("c_last"), c["relative"].alias("c_relative"),
                       windows.token_window(F.col("n") + 2, F.col("p"), _WIDTH).alias("t_first"), h["start"].alias("h_start"), h["stop"].alias("h_stop"))


def x_required(spark: SparkSession, d: str) -> DataFrame:
    """Windows that hold all of a sample's positions on a chain, batch sizes and costs."""
    rows = _components(spark, d).groupBy("sample_id", "context_sha256", F.length("chain").alias("n")).agg(F.min("chain_position").alias("a"), F.max("chain_position").alias("b"))
    w = windows.required(F.col("n"), F.col("a"), F.col("b"), _WIDTH)
    return rows.select("sample_id", "context_sha256", w["first"].alias("first"), w["last"].alias("last"), windows.batch_size(F.col("n"), 64, _WIDTH).alias("batch"), windows.attention_cost(F.col("n"), _WIDTH).alias("cost"))


def x_shards(spark: SparkSession, d: str) -> DataFrame:
    """Contexts planned onto eight shards by positions times window."""
    stats = contexts.statistics(_components(spark, d))
    return contexts.shard_plan(stats, "context_sha256", F.col("n_positions") * F.least("length", F.lit(_WIDTH)), 8)


def x_costs(spark: SparkSession, d: str) -> DataFrame:
    """All cost formulas per context; the number of components stands for the size of an alignment."""
    comps = cut(_components(spark, d))
    s = contexts.statistics(comps)
    n, p = F.col("length").cast("bigint"), F.col("n_positions")
    keys = contexts.variant_keys(comps).groupBy("context_sha256").agg(F.countDistinct("variant_key").alias("v"))
    w = F.least(n, F.lit(_WIDTH))
    return s.join(keys, "context_sha256").select("context_sha256", (p * w).alias("by_position"), ((F.col("v") + 1) * windows.attention_cost(n, _WIDTH)).alias("by_variant"), (n * n + w * w).alias("by_structure"), (n * n).alias("by_surface"), (F.col("n_components") + w * w).alias("by_alignment"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """A table of log probabilities for each position: those of the embedding of that number, the residues' in front."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("chain_position"), arrays.log_softmax(F.col("embedding")).alias("values"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return scoring.looked_up(_components(spark, d), _matrix(spark, d), {a: i for i, a in enumerate(mutation.RESIDUES)}, ["chain_position"])


def s_log_softmax(spark: SparkSession, d: str) -> DataFrame:
    lp = arrays.log_softmax(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(lp).alias("token", "v"), arrays.normalised(lp).alias("ok"))
    return rows.select("vec_id", "token", r6(F.col("v")).alias("log_value"), "ok")


def s_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.summed(_found(spark, d), ["sample_id"])
    return out.select("sample_id", "n_components", *[r6(F.col(c)).alias(c) for c in ("masked_marginal", "mutant_logp", "wt_logp")])


def s_saturation(spark: SparkSession, d: str) -> DataFrame:
    return scoring.saturation(_components(spark, d)).groupBy("context_sha256", "mut_aa").agg(F.count(F.lit(1)).alias("n_positions"))


def s_stand_in(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d)
    return rows.select("sample_id", r6(scoring.stand_in(F.col("components"))).alias("score"), r6(scoring.stand_in_evolution(F.col("components"))).alias("evolution"))


def s_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Mean z-score of two scores inside each query and model, statistics from rows that went well only."""
    rows = table(spark, d, "shard_rows").filter("candidate_group_id IS NOT NULL AND model_id IS NOT NULL").select("row_id", "model_id", "candidate_group_id", "status", "masked_marginal", "mutant_logp")
    out = scoring.z_ensemble(rows, ["candidate_group_id", "model_id"], ["masked_marginal", "mutant_logp"], F.lower(F.trim("status")) == "ok")
    return out.select("row_id", F.round(F.col("ensemble") + 1e-7, 4).alias("ensemble"))


def s_blend(spark: SparkSession, d: str) -> DataFrame:
    """Blend of two score columns, once and twice, and with a missing prior."""
    rows = table(spark, d, "shard_rows").filter(finite(F.col("mutant_logp")))
    a, b = F.col("mutant_logp"), F.when(finite(F.col("wt_logp")), F.col("wt_logp"))
    return rows.select("row_id", r6(arrays.blend(a, b, 0.8)).alias("once"), r6(arrays.blend(a, b, 0.8, 2)).alias("twice"))


def s_nll(spark: SparkSession, d: str) -> DataFrame:
    """Both-direction likelihoods of chains by chunks, each residue worth its code: -(sum of chunk means) / length."""
    rows = contexts.chains(canonical.proteins(table(spark, d, "assays"))).select("context_sha256", "chain").distinct()

    def means(seq):
        return F.aggregate(windows.chunks(seq, _WIDTH), F.lit(0.0), lambda acc, c: acc + F.aggregate(F.split(c, ""), F.lit(0.0), lambda s, x: s + F.ascii(x)) / F.length(c))

    marked = F.concat(F.lit("1"), F.col("chain"), F.lit("2"))
    return rows.select("context_sha256", F.size(windows.chunks(marked, _WIDTH)).alias("n_chunks"), r6(-0.5 * (means(marked) + means(F.reverse(marked))) / F.length(marked)).alias("value"))


def s_identity(spark: SparkSession, d: str) -> DataFrame:
    """Seeds and structure tokens from digests."""
    rows = contexts.chains(canonical.proteins(table(spark, d, "assays"))).select("context_sha256").distinct()
    codes = F.transform(F.split(F.substring("context_sha256", 1, 8), ""), lambda x: F.ascii(x))
    return rows.select("context_sha256", arrays.key_seed(F.col("context_sha256")).alias("seed"), F.array_join(arrays.structure_tokens(F.filter(codes, lambda x: x > 0)), ",").alias("tokens"))


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    return scoring.aligned(scoring.fasta_records(table(spark, d, "documents").filter("source = 'alignment'"), "doc_id", "text"), "doc_id")


def s_records(spark: SparkSession, d: str) -> DataFrame:
    return _alignments(spark, d).select("doc_id", "record_no", "header", F.length("sequence").alias("n"), F.length("aligned").alias("n_aligned"), r6(F.col("gap_fraction")).alias("gap_fraction"), "plain", "fits")


def s_depths(spark: SparkSession, d: str) -> DataFrame:
    return scoring.depths(_alignments(spark, d), "doc_id")


def s_profile(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.column_profile(_alignments(spark, d), "doc_id")
    return out.select("doc_id", "column_no", "token", "n", r6(F.col("frequency")).alias("frequency"), r6(F.col("log_value")).alias("log_value"))


QUERIES = {
    f.__name__: f
    for f in (
        x_components, x_statistics, x_variant_keys, x_windows, x_required, x_shards, x_costs, s_log_softmax, s_lookup, s_saturation, s_stand_in, s_ensemble, s_blend, s_nll, s_identity,
        s_records, s_depths, s_profile,
    )
}

_X = _POOL + _MUTATED + _SUBS + """,
chains AS (SELECT DISTINCT wildtype_sequence, unnest(range(1, len(string_split(wildtype_sequence, ':')) + 1)) AS chain_id, unnest(string_split(wildtype_sequence, ':')) AS chain
  FROM (SELECT DISTINCT wildtype_sequence FROM p)),
comps AS (SELECT s.*, chain, sha256(chain) AS context_sha256 FROM subs s JOIN samples USING (sample_id) JOIN chains c ON c.wildtype_sequence = samples.wildtype_sequence AND c.chain_id = s.chain_id),
stats AS (SELECT context_sha256, count(DISTINCT sample_id) AS n_samples, count(*) AS n_components, count(DISTINCT chain_position) AS n_positions,
  array_to_string(list_sort(list(DISTINCT chain_position)), ',') AS positions, CAST(length(any_value(chain)) AS INT) AS length FROM comps GROUP BY 1),
keys AS (SELECT sample_id, chain_id, context_sha256, string_agg(wt_aa || CAST(chain_position AS VARCHAR) || mut_aa, ':' ORDER BY chain_position) AS variant_key FROM comps GROUP BY 1, 2, 3)
"""
_W = _WIDTH
_CHAINS = "WITH seqs AS (SELECT DISTINCT unnest(string_split(wildtype_sequence, ':')) AS chain FROM assays)"
_NLL = ("list_sum(list_transform(range(0, CAST(ceil(length({m}) / 100.0) AS INT)), lambda k: list_sum(list_transform(range(1, length(substr({m}, CAST(1 + k * 100 AS INT), 100)) + 1), "
        "lambda i: ascii(substr({m}, CAST(k * 100 + i AS INT), 1)))) / CAST(length(substr({m}, CAST(1 + k * 100 AS INT), 100)) AS DOUBLE)))")  # fmt: skip
_ALN = r"""
WITH parts AS (SELECT doc_id, list_filter(string_split_regex(chr(10) || replace(text, chr(13), ''), '\n\s*>'), lambda x: trim(x, chr(32) || chr(9) || chr(10)) <> '') AS l
  FROM documents WHERE source = 'alignment' AND regexp_matches(text, '^\s*>')),
recs AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS record_no, unnest(l) AS part FROM parts),
seqs AS (SELECT doc_id, CAST(record_no AS INT) AS record_no, trim(string_split(part, chr(10))[1], chr(32) || chr(9)) AS header,
  CASE WHEN strpos(part, chr(10)) > 0 THEN regexp_replace(substr(part, strpos(part, chr(10)) + 1), '\s', '', 'g') ELSE '' END AS sequence FROM recs),
al AS (SELECT *, regexp_replace(sequence, '[a-z.]', '', 'g') AS aligned FROM seqs),
aln AS (SELECT a.*, length(q.aligned) AS ql, length(regexp_replace(a.aligned, '[^-]', '', 'g')) / CAST(nullif(length(q.aligned), 0) AS DOUBLE) AS gap_fraction,
  regexp_full_match(a.aligned, '[ACDEFGHIKLMNPQRSTVWY-]*') AS plain, length(a.aligned) = length(q.aligned) AS fits FROM al a JOIN al q ON a.doc_id = q.doc_id AND q.record_no = 1)
"""

SQL = {
    "x_components": _X + "SELECT sample_id, component_index, chain_id, chain_position, wt_aa, mut_aa, context_sha256 FROM comps",
    "x_statistics": _X + "SELECT * FROM stats",
    "x_variant_keys": _X + "SELECT * FROM keys",
    "x_windows": _X + f""", n AS (SELECT DISTINCT context_sha256, length(chain) AS n, chain_position AS p FROM comps),
      w AS (SELECT *, CASE WHEN n <= {_W} THEN 1 ELSE greatest(1, least(n, greatest(1, p - {_W // 2}) + {_W - 1}) - {_W - 1}) END AS f FROM n)
      SELECT context_sha256, p, CAST(f AS INT) AS c_first, CAST(CASE WHEN n <= {_W} THEN n ELSE least(n, greatest(1, p - {_W // 2}) + {_W - 1}) END AS INT) AS c_last, CAST(p - f + 1 AS INT) AS c_relative,
      CAST(CASE WHEN n + 2 <= {_W} OR p < {_W // 2} THEN 0 WHEN p >= n + 2 - {_W // 2} THEN n + 2 - {_W} ELSE p - {_W // 2} END AS INT) AS t_first,
      CAST(CASE WHEN n <= {_W} OR p - 1 < {_W // 2} THEN 0 WHEN p - 1 >= n - {_W // 2} THEN n - {_W} ELSE p - 1 - {_W // 2} END AS INT) AS h_start,
      CAST(CASE WHEN n <= {_W} THEN n WHEN p - 1 < {_W // 2} THEN {_W} WHEN p - 1 >= n - {_W // 2} THEN n ELSE p - 1 + {_W // 2} END AS INT) AS h_stop FROM w""",
    "x_required": _X + f""", r AS (SELECT sample_id, context_sha256, length(any_value(chain)) AS n, min(chain_position) AS a, max(chain_position) AS b FROM comps GROUP BY 1, 2),
      s AS (SELECT *, greatest(1, (a + b) // 2 - {(_W - 1) // 2}) AS s0 FROM r), t AS (SELECT *, least(n, s0 + {_W - 1}) AS e1, greatest(1, least(n, s0 + {_W - 1}) - {_W - 1}) AS s1 FROM s)
      SELECT sample_id, context_sha256, CAST(CASE WHEN n <= {_W} THEN 1 WHEN b - a < {_W} THEN s1 END AS INT) AS first, CAST(CASE WHEN n <= {_W} THEN n WHEN b - a < {_W} THEN e1 END AS INT) AS last,
      CAST(least(64, greatest(1, {_W * _W} // (least(n, {_W}) * least(n, {_W})))) AS INT) AS batch, CAST(((n + 2) // {_W}) * {_W * _W} + ((n + 2) % {_W}) * ((n + 2) % {_W}) AS BIGINT) AS cost FROM t""",
    "x_costs": _X + f""", v AS (SELECT context_sha256, count(DISTINCT variant_key) AS v FROM keys GROUP BY 1) SELECT context_sha256, n_positions * least(length, {_W}) AS by_position,
      (v + 1) * CAST(((length + 2) // {_W}) * {_W * _W} + ((length + 2) % {_W}) * ((length + 2) % {_W}) AS BIGINT) AS by_variant, CAST(length AS BIGINT) * length + least(length, {_W}) * least(length, {_W}) AS by_structure,
      CAST(length AS BIGINT) * length AS by_surface, n_components + least(length, {_W}) * least(length, {_W}) AS by_alignment FROM stats JOIN v USING (context_sha256)""",
    "x_shards": _X.replace("WITH ", "WITH RECURSIVE ", 1) + f""", item AS (SELECT context_sha256 AS k, n_positions * least(length, {_W}) AS c, row_number() OVER (ORDER BY n_positions * least(length, {_W}) DESC, context_sha256) AS i FROM stats),
      walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS k, CAST(NULL AS BIGINT) AS c, CAST(NULL AS INT) AS s, [CAST(0 AS HUGEINT) FOR x IN range(8)] AS loads
        UNION ALL SELECT item.i, item.k, item.c, CAST(list_position(loads, list_min(loads)) - 1 AS INT), list_transform(range(1, 9), lambda x: loads[x] + CASE WHEN x = list_position(loads, list_min(loads)) THEN item.c ELSE 0 END)
        FROM walk JOIN item ON item.i = walk.i + 1)
      SELECT k AS context_sha256, c AS cost, s AS shard_id FROM walk WHERE k IS NOT NULL""",
    "s_log_softmax": f"""SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INT) AS token, {sql_r6('unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) - lse))')} AS log_value, true AS ok
      FROM (SELECT vec_id, embedding, ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))))) AS lse FROM embeddings)""",
    "s_lookup": _X + f""", m AS (SELECT vec_id, list_transform(e, lambda x: CAST(x AS DOUBLE) - ln(list_sum(list_transform(e, lambda y: exp(CAST(y AS DOUBLE)))))) AS v FROM (SELECT vec_id, embedding AS e FROM embeddings)),
      f AS (SELECT sample_id, v[strpos('ACDEFGHIKLMNPQRSTVWY', mut_aa)] AS mv, v[strpos('ACDEFGHIKLMNPQRSTVWY', wt_aa)] AS wv FROM comps LEFT JOIN m ON vec_id = chain_position)
      SELECT sample_id, count(*) AS n_components, {sql_r6('CASE WHEN count(mv) = count(*) THEN sum(mv - wv) END')} AS masked_marginal, {sql_r6('CASE WHEN count(mv) = count(*) THEN sum(mv) END')} AS mutant_logp,
      {sql_r6('CASE WHEN count(mv) = count(*) THEN sum(wv) END')} AS wt_logp FROM f GROUP BY 1""",
    "s_saturation": _X + """SELECT context_sha256, a AS mut_aa, count(*) AS n_positions FROM (SELECT DISTINCT context_sha256, chain_position, wt_aa FROM comps),
      (SELECT unnest(string_split('A,C,D,E,F,G,H,I,K,L,M,N,P,Q,R,S,T,V,W,Y', ',')) AS a) WHERE a <> wt_aa GROUP BY 1, 2""",
    "s_stand_in": _POOL + _MUTATED + f"""SELECT sample_id, {sql_r6("list_sum(list_transform(parts, lambda x: (ascii(x.alt) - ascii(x.wt)) / 25.0 - 0.03 * x.pos))")} AS score,
      {sql_r6("list_sum(list_transform(parts, lambda x: (x.pos % 7 - 3) * 0.2 + (ascii(x.alt) % 5) * 0.05))")} AS evolution FROM samples""",
    "s_ensemble": """WITH r AS (SELECT *, CASE WHEN isfinite(masked_marginal) THEN masked_marginal END AS a, CASE WHEN isfinite(mutant_logp) THEN mutant_logp END AS b, lower(trim(status)) = 'ok' AS ok
        FROM shard_rows WHERE candidate_group_id IS NOT NULL AND model_id IS NOT NULL),
      s AS (SELECT candidate_group_id, model_id, avg(a) AS ma, CASE WHEN max(a) > min(a) THEN stddev_samp(a) END AS sa, avg(b) AS mb, CASE WHEN max(b) > min(b) THEN stddev_samp(b) END AS sb FROM r WHERE ok GROUP BY 1, 2)
      SELECT row_id, round(((a - ma) / sa + (b - mb) / sb) / 2 + 1e-7, 4) AS ensemble FROM r LEFT JOIN s ON s.candidate_group_id = r.candidate_group_id AND s.model_id = r.model_id""",
    "s_blend": f"""SELECT row_id, {sql_r6('coalesce(0.2 * mutant_logp + 0.8 * w, mutant_logp)')} AS once, {sql_r6('coalesce(0.2 * (0.2 * mutant_logp + 0.8 * w) + 0.8 * w, mutant_logp)')} AS twice
      FROM (SELECT row_id, mutant_logp, CASE WHEN isfinite(wt_logp) THEN wt_logp END AS w FROM shard_rows WHERE isfinite(mutant_logp))""",
    "s_nll": _CHAINS + f""" SELECT sha256(chain) AS context_sha256, CAST(ceil(length(m) / 100.0) AS INT) AS n_chunks, {sql_r6(f"-0.5 * ({_NLL.format(m='m')} + {_NLL.format(m='r')}) / length(m)")} AS value
      FROM (SELECT chain, '1' || chain || '2' AS m, reverse('1' || chain || '2') AS r FROM seqs)""",
    "s_identity": _CHAINS + """ SELECT h AS context_sha256, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS seed, '1,' || array_to_string(list_transform(range(1, 9), lambda i: ascii(substr(h, CAST(i AS INT), 1)) + 3), ',') || ',2' AS tokens
      FROM (SELECT sha256(chain) AS h FROM seqs)""",
    "s_records": _ALN + f"SELECT doc_id, record_no, header, CAST(length(sequence) AS INT) AS n, CAST(length(aligned) AS INT) AS n_aligned, {sql_r6('gap_fraction')} AS gap_fraction, plain, fits FROM aln",
    "s_depths": _ALN + """SELECT doc_id, count(*) AS n_records, count(*) FILTER (WHERE fits AND gap_fraction <= 0.5) AS n_few_gaps, count(*) FILTER (WHERE fits AND gap_fraction <= 0.5 AND plain) AS n_used,
      CAST(sum(length(regexp_replace(sequence, '[^a-z]', '', 'g'))) AS BIGINT) AS n_inserted, CAST(sum(length(regexp_replace(aligned, '[ACDEFGHIKLMNPQRSTVWY-]', '', 'g'))) AS BIGINT) AS n_unknown FROM aln GROUP BY 1""",
    "s_profile": _ALN + f""", l AS (SELECT doc_id, unnest(range(1, length(aligned) + 1)) AS column_no, unnest(string_split(aligned, '')) AS t FROM aln WHERE fits AND aligned <> ''),
      c AS (SELECT doc_id, column_no, CASE WHEN regexp_full_match(t, '[ACDEFGHIKLMNPQRSTVWY-]') THEN t ELSE 'X' END AS token, count(*) AS n FROM l GROUP BY 1, 2, 3),
      f AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY doc_id, column_no) AS DOUBLE) AS frequency FROM c)
      SELECT doc_id, CAST(column_no AS INT) AS column_no, token, n, {sql_r6('frequency')} AS frequency, {sql_r6('''frequency - ln(sum(exp(frequency)) OVER (PARTITION BY doc_id, column_no)
        + 33 - count(*) OVER (PARTITION BY doc_id, column_no))''')} AS log_value FROM f""",
}
