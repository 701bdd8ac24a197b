"""The canonical dataset as files: eight tables with a manifest, and the shards of model outputs with theirs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import integrity
from tallyweave.session import cut
from tallyweave.sources import files, storage

#: The tables by the name the manifest counts them under, and their files.
TABLES = {
    "proteins": "proteins.csv", "samples": "samples.csv", "substitution_components": "substitutions.csv", "queries": "queries.csv", "context_samples": "context_samples.csv",
    "context_substitution_components": "context_substitutions.csv", "provided_context_rows": "provided_context.csv", "msa_contexts": "msa_contexts.csv",
}
_WHOLE = {"sequence_length", "n_chains", "mutation_count", "component_index", "chain_id", "chain_position", "global_position", "expected_samples"}
VERSION = 4


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Data files of all tables, a table being a file or a folder of files."""
    out = []
    for name in TABLES.values():
        place = f"{folder}/{name}"
        out += storage.below(spark, place, ".csv") if storage.is_folder(spark, place) else [place]
    return out


def write_dataset(spark: SparkSession, tables: dict[str, DataFrame], folder: str, dataset_id: str) -> dict:
    """Write the tables and, last of all, the manifest that makes them a dataset; an existing folder's tables are refused."""
    counts = {}
    for name, file in TABLES.items():
        tables[name].write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/{file}")
        counts[name] = tables[name].sparkSession.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{file}").count()
    manifest = {"schema_version": VERSION, "status": "frozen", "dataset_id": dataset_id, **counts, "dataset_hash": storage.content_digest(spark, _files(spark, folder))}
    storage.write_text(spark, f"{folder}/dataset.json", json.dumps(manifest, indent=2) + "\n")
    return manifest


def read_dataset(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and the tables of a frozen dataset, after all its rules hold; IntegrityError names what doesn't.

    The hash of the files and the tables' counts have to be the manifest's; see ``rules`` for the rest.
    """
    manifest = json.loads(storage.read_text(spark, f"{folder}/dataset.json"))
    if manifest.get("schema_version") != VERSION or manifest.get("status") != "frozen":
        raise integrity.IntegrityError(f"{folder}: not a frozen dataset of version {VERSION}")
    if storage.content_digest(spark, _files(spark, folder)) != manifest.get("dataset_hash"):
        raise integrity.IntegrityError(f"{folder}: the files aren't those of the manifest")
    tables = {}
    for name, file in TABLES.items():
        place = f"{folder}/{file}"
        rows = files.read_csv(spark, storage.below(spark, place, ".csv") if storage.is_folder(spark, place) else [place], index=False).drop("path")
        tables[name] = cut(rows.select(*[F.col(c).cast("int").alias(c) if c in _WHOLE else F.col(c) for c in rows.columns]))
        if tables[name].count() != manifest.get(name):
            raise integrity.IntegrityError(f"{folder}: {name} has another count than the manifest")
    integrity.require(rules(tables))
    return manifest, tables


def rules(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, key, detail) of all broken rules: query identity and size, components of both kinds of samples, sample ids, chains."""
    t = tables
    actual = t["samples"].groupBy("task", "query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    expected = t["queries"].select("task", "query_id", F.col("expected_samples").alias("n"))
    chain = F.explode(F.from_json("chain_sequences", "array<string>"))
    chains = t["proteins"].select(chain.alias("chain")).select(F.sha2("chain", 256).alias("context_sha256")).distinct()
    return reduce(DataFrame.unionByName, [
        integrity.unique(t["queries"], ["task", "query_id"], "query_unique"), integrity.membership(expected, actual, ["task", "query_id"], "n", "query_size"), integrity.protein_rules(t["proteins"]),
        integrity.component_rules(t["samples"], t["substitution_components"], t["proteins"]),
        integrity.component_rules(t["context_samples"], t["context_substitution_components"], t["proteins"]), integrity.disjoint(t["samples"], t["context_samples"], ["sample_id"], "roles_disjoint"),
        integrity.unique(t["msa_contexts"], ["context_sha256"], "msa_unique"), integrity.same_set(chains, t["msa_contexts"].select("context_sha256"), ["context_sha256"], "msa_coverage"),
    ])


def write_shards(rows: DataFrame, folder: str, shard: str, count: int, columns: list[str], about: dict, config: dict) -> None:
    """One CSV file and one manifest a shard, rows in order of sample_id; a shard without rows has a header only.

    A manifest is written after its data, so a shard without one isn't there. ``about`` names the dataset; the configuration goes
    into each manifest with its digest. A shard is one task: shards are planned by load beforehand.
    """
    spark = rows.sparkSession
    jvm, target = spark.sparkContext._jvm, f"{folder}/.unsorted"
    storage_rows = rows.select(shard, *columns).repartition(count, shard).sortWithinPartitions(shard, "sample_id")
    storage_rows.write.mode("errorifexists").partitionBy(shard).option("header", True).option("escape", '"').csv(target)
    sizes = {r["k"]: r["n"] for r in rows.groupBy(F.col(shard).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for k in range(count):
        name = f"{folder}/shard_{k:04d}"
        parts = storage.below(spark, f"{target}/{shard}={k}", ".csv") if k in sizes else []
        if len(parts) > 1:
            raise ValueError(f"shard {k} has {len(parts)} files")
        if parts:
            place = jvm.org.apache.hadoop.fs.Path(parts[0])
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(place, jvm.org.apache.hadoop.fs.Path(f"{name}.csv"))
        else:
            storage.write_text(spark, f"{name}.csv", ",".join(columns) + "\n")
        told = {**about, "run_config": config, "run_config_sha256": files.json_digest(config), "shard_id": k, "num_shards": count, "samples": sizes.get(k, 0), "partial_run": False}
        storage.write_text(spark, f"{name}.json", json.dumps(told, indent=2) + "\n")
    from tallyweave.session import remove

    remove(spark, target)
