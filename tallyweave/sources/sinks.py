"""Writing results: task-partitioned tables, small files in one piece, sequences as text, wherever the cluster keeps them."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import cut, remove
from tallyweave.sources import storage


def by_task(df: DataFrame, folder: str, order: list, column: str = "task") -> None:
    """One subfolder a task, rows of a file in order. An existing folder is refused."""
    df.repartition(column).sortWithinPartitions(column, *order).write.mode("errorifexists").partitionBy(column).option("header", True).csv(folder)


def csv_by_key(df: DataFrame, folder: str, key: str) -> int:
    """One CSV file a key, <folder>/<key>.csv, with the other columns; returns how many. Keys are usable as names. An existing
    folder is refused.

    In a folder that is mounted everywhere tasks write the files where they stay: Spark's writer makes a folder, a file and
    a checksum a key, all to be moved afterwards. Elsewhere its files are moved.
    """
    spark = df.sparkSession
    if storage.exists(spark, folder):
        raise ValueError(f"{folder} exists")
    storage.make(spark, folder)
    own = [c for c in df.columns if c != key]
    sorted_rows = df.repartition(key).sortWithinPartitions(key)
    local = storage.local_path(spark, folder)
    if local is None:
        sorted_rows.write.partitionBy(key).option("header", True).option("escape", '"').csv(f"{folder}/_raw")
        # Spark's names of folders are encoded where a key holds odd characters, which names don't
        parts = storage.below(spark, f"{folder}/_raw", ".csv")
        for part in parts:
            storage.move(spark, part, f"{folder}/{part.split('/')[-2].partition('=')[2]}.csv")
        remove(spark, f"{folder}/_raw")
        return len(parts)
    lines = sorted_rows.select(F.col(key).alias("name"), F.to_csv(F.struct(*own), {"escape": '"'}).alias("line"))
    head = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\r\n') else c for c in own) + "\n"

    def write(batches):
        # a killed attempt leaves no half of a file behind that has a key's name
        mark, name, out, n = f".{uuid.uuid4().hex}~", None, None, 0
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            runs = pc.run_end_encode(names)
            start = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if value != name:
                    if out:
                        out.close()
                        os.replace(f"{local}/{name}.csv{mark}", f"{local}/{name}.csv")
                    name, n = value, n + 1
                    out = open(f"{local}/{name}.csv{mark}", "w", encoding="utf-8", newline="")
                    out.write(head)
                out.write("\n".join(texts[start:end]) + "\n")
                start = end
        if out:
            out.close()
            os.replace(f"{local}/{name}.csv{mark}", f"{local}/{name}.csv")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return lines.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def one_csv(df: DataFrame, path: str | Path, most: int = 1_000_000) -> None:
    """A small result as one CSV file that appears whole or not at all; beyond ``most`` rows it is refused: write a table."""
    frame = df.limit(most + 1).toPandas()
    if len(frame) > most:
        raise ValueError(f"more than {most} rows: write a table")
    storage.write_text(df.sparkSession, path, frame.to_csv(index=False))


def one_json(df: DataFrame, path: str | Path) -> None:
    """The only row of ``df`` as JSON with sorted keys."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("exactly one row is needed")
    storage.write_text(df.sparkSession, path, json.dumps(rows[0].asDict(True), sort_keys=True, indent=2, default=str) + "\n")


def fasta(df: DataFrame, folder: str, header: str = "header", sequence: str = "sequence") -> None:
    """Records as text files in FASTA form."""
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("errorifexists").text(folder)


def one_fasta(df: DataFrame, path: str | Path, header: str = "header", sequence: str = "sequence", most: int = 100_000) -> None:
    """A small set of records as one FASTA file, in order of header, that appears whole or not at all; beyond ``most`` it is refused."""
    rows = df.select(header, sequence).orderBy(header).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} records: write a folder")
    storage.write_text(df.sparkSession, path, "".join(f">{r[0]}\n{r[1]}\n" for r in rows))


def append_json(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines behind what the log has."""
    df.write.mode("append").json(folder)


def by_key_json(df: DataFrame, folder: str, key: str) -> None:
    """One subfolder of JSON lines a key."""
    df.repartition(key).write.mode("errorifexists").partitionBy(key).json(folder)


def decimals(column: Column, digits: int = 8) -> Column:
    """A double in at most ``digits`` significant digits as text, as C writes ``%.<digits>g``: no zeros at the end of a fraction.

    Fixed notation is used for exponents from -4 to ``digits`` - 1, after rounding. Null gives null; ``nan``, ``inf``, ``-inf``.
    Numbers below 2.3e-308 show the digits of their shortest form only.
    """
    told = F.format_string(f"%.{digits - 1}e", column)
    power = F.substring_index(told, "e", -1).cast("int")
    plain = F.regexp_replace(told, "e.*", "")
    short = lambda c: F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.?0+\z", "")).otherwise(c)
    # of the rounded number no more digits are shown than it has
    places = {k: F.format_string(f"%.{digits - 1 - k}f", told.cast("double")) for k in range(-4, digits)}
    fixed = F.coalesce(*[F.when(power == k, short(v)) for k, v in places.items()])
    sign = F.when(power < 0, "-").otherwise("+")
    science = F.concat(short(plain), F.lit("e"), sign, F.format_string("%02d", F.abs(power)))
    odd = F.when(F.isnan(column), "nan").when(column == float("inf"), "inf").when(column == float("-inf"), "-inf")
    zero = F.when(column == 0, "0")
    return F.when(column.isNotNull(), F.coalesce(odd, zero, fixed, science))


def summary_row(task: str, counts: dict, metrics: dict, quality: dict) -> dict:
    """A nested summary as one flat row: what it is about, how many cases, its metrics, its quality counters."""
    head = {"setting": task, **{k: counts[k] for k in ("num_assays", "num_queries", "num_target_cases", "lenient")}}
    first = {k: quality[k] for k in ("random_replacement_cases", "skipped_cases")}
    return {**head, **first, **metrics, **{k: v for k, v in quality.items() if k not in first}}


def cache_append(df: DataFrame, folder: str, keys: list[str]) -> int:
    """Append the rows whose keys a Parquet cache lacks; returns how many were new. The first call makes the cache."""
    spark = df.sparkSession
    new = df.join(spark.read.parquet(folder).select(*keys), keys, "left_anti") if storage.exists(spark, folder) else df
    new = cut(new)
    new.write.mode("append").parquet(folder)
    return new.count()
