"""From assays and candidate pools to normalised tables with content-derived ids.

Labels never enter these tables: no function here reads a score except provided_context, which holds what a model may see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import mutation, text

EVALUATION, ANCHOR, SINGLE = "evaluation_candidate", "anchor_context", "visible_single_context"


def proteins(assays: DataFrame) -> DataFrame:
    """One row for each distinct sequence: ids, length, number of chains, chains and boundaries as JSON arrays."""
    seq = F.upper(text.strip(F.col("wildtype_sequence")))
    bounds = mutation.chain_bounds(F.col("wildtype_sequence"))
    rows = assays.select(seq.alias("wildtype_sequence")).filter("wildtype_sequence <> ''").distinct()
    return rows.select(
        F.substring(F.sha2("wildtype_sequence", 256), 1, 16).alias("wt_id"),
        F.sha2("wildtype_sequence", 256).alias("sequence_sha256"),
        "wildtype_sequence",
        F.length(mutation.flat_sequence(F.col("wildtype_sequence"))).alias("sequence_length"),
        F.size(F.split("wildtype_sequence", ":", -1)).alias("n_chains"),
        F.to_json(F.split("wildtype_sequence", ":", -1)).alias("chain_sequences"),
        F.to_json(F.transform(bounds, lambda b: F.array(b["start"], b["end"]))).alias("chain_boundaries"),
    )


def sample_id(dataset: Column, task: Column, query: Column, role: Column, mutant: Column) -> Column:
    """SHA-256 of the identity as JSON with sorted keys and without blanks."""
    return F.sha2(F.to_json(F.struct(dataset.alias("dataset_id"), mutant.alias("mutant"), query.alias("query_id"), role.alias("sample_role"), task.alias("task"))), 256)


def _named(candidates: DataFrame, *more: Column) -> DataFrame:
    named = candidates.select(F.col("candidate_group_id").alias("query_id"), text.nonblank(F.col("mutant")).alias("mutant"), *more)
    return named.dropna(subset=["query_id", "mutant"])


def described(rows: DataFrame) -> DataFrame:
    """Add what follows from wildtype_sequence alone, where it isn't there yet: flat_wt, bounds of its chains, sequence_sha256."""
    made = {"flat_wt": mutation.flat_sequence(F.col("wildtype_sequence")), "bounds": mutation.chain_bounds(F.col("wildtype_sequence")), "sequence_sha256": F.sha2("wildtype_sequence", 256)}
    return rows.withColumns({k: v for k, v in made.items() if k not in rows.columns})


def _seated(rows: DataFrame, queries: DataFrame, assays: DataFrame) -> DataFrame:
    # worked out for each assay, not for each of its candidates
    wild = described(assays.select(F.col("assay_id").alias("source_assay"), F.upper(text.strip(F.col("wildtype_sequence"))).alias("wildtype_sequence")))
    return rows.join(queries.select("task", "query_id", "source_assay"), "query_id").join(F.broadcast(wild), "source_assay")


def pool(candidates: DataFrame, queries: DataFrame, assays: DataFrame) -> DataFrame:
    """Candidates with their query and wild type; rows without group or mutant go. Assays are a fixed list and broadcast."""
    given = F.upper(text.strip(F.col("mutated_sequence"))).alias("given_sequence")
    return _seated(_named(candidates, F.col("row_id"), given), queries, assays)


def distinct_pool(candidates: DataFrame, queries: DataFrame, assays: DataFrame) -> DataFrame:
    """As pool, but one row for each (query, mutant), made distinct before anything long is joined to it."""
    return _seated(_named(candidates).distinct(), queries, assays)


def parsed(rows: DataFrame) -> DataFrame:
    """Add flat wild type, ordered components (null where the mutant is illegal) and the mutated sequence."""
    found = mutation.parts(F.col("mutant"))
    out = described(rows).withColumn("components", F.when(mutation.legal(found, F.col("flat_wt")), mutation.ordered(found)))
    return out.withColumn("mutated_sequence", mutation.rechained(mutation.applied(F.col("flat_wt"), F.col("components")), F.col("bounds")))


def samples(rows: DataFrame, dataset: str, role: str = EVALUATION) -> DataFrame:
    """One sample for each legal row of parsed rows, which have to be distinct in (task, query, mutant)."""
    legal = rows.filter(F.col("components").isNotNull())
    digest = F.col("sequence_sha256")
    return legal.select(
        sample_id(F.lit(dataset), F.col("task"), F.col("query_id"), F.lit(role), F.col("mutant")).alias("sample_id"),
        "task", "query_id", "source_assay", F.lit(role).alias("sample_role"), "mutant", mutation.notation(F.col("components")).alias("model_mutant"),
        F.size("components").alias("mutation_count"), F.substring(digest, 1, 16).alias("wt_id"), digest, "mutated_sequence", "components", "wildtype_sequence", "bounds",
    )


def substitutions(sampled: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row a component with its chain: the interval that holds the position is looked up in the boundaries' array.

    ``keep`` names columns of the sample that its components carry along.
    """
    rows = described(sampled).select("sample_id", *(keep or []), "bounds", F.posexplode("components").alias("i", "c"))
    home = F.filter("bounds", lambda b: (b["start"] <= F.col("c.pos")) & (F.col("c.pos") <= b["end"]))[0]
    return rows.withColumn("home", home).select(
        "sample_id", *(keep or []), (F.col("i") + 1).alias("component_index"), F.col("home.chain_id").alias("chain_id"),
        (F.col("c.pos") - F.col("home.start") + 1).alias("chain_position"), F.col("c.pos").alias("global_position"),
        F.col("c.wt").alias("wt_aa"), F.col("c.alt").alias("mut_aa"),
    )


def msa_contexts(assays: DataFrame) -> DataFrame:
    """One row a distinct chain: its hash, length and the least alignment path given for it (paths follow the chains' order)."""
    seq = F.upper(text.strip(F.col("wildtype_sequence")))
    rows = assays.select(F.arrays_zip(F.split(seq, ":", -1).alias("chain"), F.split(F.coalesce("a3m_relative_path", F.lit("")), ";", -1).alias("path")).alias("z")).select(F.inline("z"))
    return rows.filter("chain <> ''").groupBy("chain").agg(F.min("path").alias("a3m_path"), F.countDistinct("path").alias("n_paths")).select(
        F.sha2("chain", 256).alias("context_sha256"), F.length("chain").alias("sequence_length"), F.col("chain").alias("chain_sequence"), "a3m_path", "n_paths"
    )


def provided_context(queries: DataFrame, assays: DataFrame) -> DataFrame:
    """What T3 queries show a model: the assay's anchor and its score."""
    anchors = assays.filter(F.col("anchor_mutant").isNotNull()).select(
        F.col("assay_id").alias("source_assay"), text.strip(F.col("anchor_mutant")).alias("mutant"), F.col("anchor_dms_score").alias("visible_score")
    )
    return queries.filter("task = 'T3'").join(F.broadcast(anchors), "source_assay").select("task", "query_id", "source_assay", F.lit(ANCHOR).alias("sample_role"), "mutant", "visible_score")


def content_hash(df: DataFrame, keys: list[str]) -> str:
    """Order-free hash of a table: SHA-256 over the row hashes of each of 256 buckets, then over the buckets.

    Only 256 bucket hashes come to the driver; a bucket's row hashes are summed as two 64-bit words, so no list of rows
    is built. Renaming a column changes the hash, reordering rows doesn't.
    """
    import hashlib

    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    word = lambda k: F.conv(F.substring(F.col("h"), k, 15), 16, 10).cast("decimal(38,0)")
    hashed = df.select(row.alias("h"), F.pmod(F.xxhash64(*keys), F.lit(256)).alias("b"))
    sums = hashed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(word(1)).alias("x"), F.sum(word(17)).alias("y"), F.sum(word(33)).alias("z")).collect()
    return hashlib.sha256("\n".join(f"{r['b']} {r['n']} {r['x']} {r['y']} {r['z']}" for r in sorted(sums)).encode()).hexdigest()
