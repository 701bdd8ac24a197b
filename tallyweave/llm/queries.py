"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.llm import ledger, packing, splitting, tokens, topn
from tallyweave.session import cut, finite, table


def _best(spark: SparkSession, d: str, n: int) -> DataFrame:
    said = table(spark, d, "predictions").select(
        text.group_id(F.col("assay")).alias("assay"), text.nonblank(F.col("mutant")).alias("mutant"), "order_value", "input_index"
    )
    said = topn.top_items(said.filter(finite(F.col("order_value"))), "assay", "mutant", ["order_value", "input_index"], n)
    pool = table(spark, d, "candidates").select(
        F.nullif(F.col("candidate_group_id"), F.lit("")).alias("assay"), text.nonblank(F.col("mutant")).alias("mutant"), (-F.col("dms_score")).alias("down")
    )
    pool = topn.top_items(pool.filter(finite(F.col("down"))), "assay", "mutant", ["down"], n)
    return said.withColumn("side", F.lit("predictions")).unionByName(pool.withColumn("side", F.lit("candidates"))).select("side", "assay", "pos", "mutant")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, 5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.copies(table(spark, d, "variant_records"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return ledger.collapsed(table(spark, d, "variant_records")).select("keep_id", "query_key", "normalized", "n_copies")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids differ from their text (none)."""
    docs = table(spark, d, "documents")
    back = tokens.decode_corpus(tokens.encode_corpus(docs, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "decoded")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("text") != F.col("decoded")).alias("n_changed")
    )


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "token_limits"))


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p7_packed(spark, d), table(spark, d, "token_limits"))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per 'pack' limit: documents packed, documents of which a token is missing or comes twice, containers over capacity, and
    whether the windows' mixture is within 0.05 of the target (asked for where there are four windows at least)."""
    docs, limits = table(spark, d, "documents"), table(spark, d, "token_limits")
    packed = cut(packing.pack(docs, limits))
    wanted = limits.filter("purpose = 'pack'").select("limit_name", "tokenizer", "max_tokens")
    names = sorted({r["tokenizer"] for r in wanted.collect()})
    sized = packing.sizes(docs, "doc_id", "text", "source", names).filter("n_tokens > 0").join(F.broadcast(wanted), "tokenizer")
    piece = packed.groupBy("limit_name", "doc_id", "piece_no").agg(F.count(F.lit(1)).alias("times"), F.min("first_token").alias("first"), F.max("n_tokens").alias("size"))
    whole = piece.groupBy("limit_name", "doc_id").agg(F.sum("size").alias("got"), F.max(F.col("first") + F.col("size")).alias("last"), F.max("times").alias("times"))
    both = sized.select("limit_name", "doc_id", "n_tokens").join(whole, ["limit_name", "doc_id"], "full_outer")
    right = (F.col("got") == F.col("n_tokens")) & (F.col("last") == F.col("n_tokens")) & (F.col("times") == 1)
    told = both.groupBy("limit_name").agg(F.count("got").alias("n_documents"), F.count_if(~F.coalesce(right, F.lit(False))).alias("n_wrong"))
    full = packed.groupBy("limit_name", "container").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(wanted), "limit_name")
    full = full.groupBy("limit_name").agg(F.count_if(F.col("n") > F.col("max_tokens")).alias("n_overfull"))
    mixed = packing.mixture(packed).select("limit_name", ((F.col("distance") <= 0.05) | (F.col("windows") < 4)).alias("mixed"))
    return told.join(full, "limit_name").join(mixed, "limit_name")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents"), table(spark, d, "token_limits"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per 'split' limit: pieces that aren't what the limit asks for, and documents that aren't covered by theirs.

    A piece has to have max_tokens tokens at most, to be the stretch of the text it says, and to start overlap_tokens tokens before
    the end of the piece before it; the first starts with the text's first token, the last ends with its last.
    """
    docs, limits = table(spark, d, "documents"), table(spark, d, "token_limits").filter("purpose = 'split'")
    asked = limits.select("limit_name", "tokenizer", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("shared"))
    pieces = cut(splitting.split(docs, limits))
    names = sorted({r["tokenizer"] for r in asked.collect()})
    sized = packing.sizes(docs, "doc_id", "text", "source", names).join(F.broadcast(asked), "tokenizer").filter(F.col("n_tokens") > F.col("max_tokens"))
    own = Window.partitionBy("limit_name", "doc_id").orderBy("piece_no")
    end = F.col("first_token") + F.col("n_tokens")
    rows = pieces.withColumn("before", F.lag(end).over(own)).join(F.broadcast(asked), "limit_name").join(docs.select("doc_id", "text"), "doc_id")
    same = F.substring("text", F.col("first_char") + 1, F.col("n_chars")) == F.col("piece")
    right = (F.col("n_tokens") <= F.col("max_tokens")) & (F.col("n_tokens") > 0) & same & (F.coalesce(F.col("before") - F.col("shared"), F.lit(0)) == F.col("first_token"))
    bad = rows.groupBy("limit_name").agg(F.count_if(~F.coalesce(right, F.lit(False))).alias("n_wrong_pieces"))
    last = pieces.groupBy("limit_name", "doc_id").agg(F.max(end).alias("last"))
    both = sized.select("limit_name", "doc_id", "n_tokens").join(last, ["limit_name", "doc_id"], "full_outer")
    lost = both.groupBy("limit_name").agg(F.count_if(~F.coalesce(F.col("last") == F.col("n_tokens"), F.lit(False))).alias("n_uncovered"))
    return asked.select("limit_name").join(bad, "limit_name", "left").join(lost, "limit_name", "left").na.fill(0)


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p5_records, p6_ids, p6_round_trip, p7_packed, p7_usage, p7_checked, p8_pieces, p8_checked)}

_STRIP = "chr(32) || chr(9) || chr(10) || chr(13)"
_B = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}\p{P}\p{S}]"
_KEYED = rf"""
WITH bare AS (SELECT rec_id, regexp_replace(upper(query_id), '{_B}+', '', 'g') AS query_key,
    CASE WHEN regexp_replace(original, '[\s\x0b\x{{85}}\p{{Z}}]+', '', 'g') <> '' THEN
      regexp_replace(regexp_replace(upper(original), '(?:P\.{_B}*)?([A-Z]{_B}*[0-9]+{_B}*[A-Z])', '\1', 'g'), '{_B}+', '', 'g') END AS bare
  FROM variant_records),
keyed AS (SELECT rec_id, query_key, concat_ws('|', array_to_string(list_sort(regexp_extract_all(bare, '[A-Z][0-9]+[A-Z]')), '+'),
    nullif(regexp_replace(regexp_replace(bare, '[A-Z][0-9]+[A-Z]', '#', 'g'), '^#*$', ''), '')) AS k
  FROM bare WHERE bare IS NOT NULL AND query_key IS NOT NULL)
"""

SQL = {
    "p4_found": f"""
      WITH said AS (SELECT regexp_replace(trim(assay, {_STRIP}), '[.]csv$', '') AS assay, trim(mutant, {_STRIP}) AS mutant, order_value, input_index
        FROM predictions WHERE isfinite(order_value)),
      best AS (SELECT assay, mutant, min((order_value, input_index)) AS o FROM said WHERE assay <> '' AND mutant <> '' GROUP BY ALL),
      pool AS (SELECT candidate_group_id AS assay, trim(mutant, {_STRIP}) AS mutant, max(dms_score) AS s FROM candidates
        WHERE candidate_group_id <> '' AND trim(mutant, {_STRIP}) <> '' AND isfinite(dms_score) GROUP BY ALL),
      ranked AS (
        SELECT 'predictions' AS side, assay, CAST(row_number() OVER (PARTITION BY assay ORDER BY o, mutant) AS INT) AS pos, mutant FROM best
        UNION ALL SELECT 'candidates', assay, CAST(row_number() OVER (PARTITION BY assay ORDER BY s DESC, mutant) AS INT), mutant FROM pool)
      SELECT * FROM ranked WHERE pos <= 5""",
    "p5_found": _KEYED + """SELECT keep_id, rec_id AS dup_id FROM
      (SELECT rec_id, min(rec_id) OVER (PARTITION BY query_key, k) AS keep_id FROM keyed) WHERE rec_id <> keep_id""",
    "p5_records": _KEYED + "SELECT min(rec_id) AS keep_id, query_key, k AS normalized, count(*) AS n_copies FROM keyed GROUP BY query_key, k",
    "p7_checked": """SELECT limit_name, count(*) AS n_documents, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS BIGINT) AS n_overfull, true AS mixed
      FROM documents, token_limits WHERE purpose = 'pack' AND text <> '' GROUP BY 1""",
    "p8_checked": "SELECT limit_name, CAST(0 AS BIGINT) AS n_wrong_pieces, CAST(0 AS BIGINT) AS n_uncovered FROM token_limits WHERE purpose = 'split'",
    "p6_round_trip": "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_changed FROM documents",
}
