"""Arithmetic of scoring: table look-ups, sums over components, ensembles, alignment profiles, and the scorer interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import mutation
from tallyweave.session import finite


def looked_up(comps: DataFrame, matrix: DataFrame, slots: dict[str, int], keys: list[str] | None = None, missing: str = "null", small: int = 50_000) -> DataFrame:
    """Components with the values of their wild-type and mutant tokens.

    ``matrix`` is (keys, values array), keys being context_sha256 and chain_position unless others are given, each once; ``slots``
    maps residues to places in the array, from 0. A component without matrix row keeps nulls, or with ``missing`` "raise"
    fails the run when it is read. A matrix of at most ``small`` rows is broadcast; a larger one meets in a shuffle.
    """
    place = F.create_map(*[x for a, i in sorted(slots.items()) for x in (F.lit(a), F.lit(i))])
    keys = keys or ["context_sha256", "chain_position"]
    rows = comps.join(F.broadcast(matrix) if matrix.count() <= small else matrix, keys, "left")
    if missing == "raise":
        rows = rows.withColumn("values", F.coalesce("values", F.raise_error(F.concat_ws(" ", F.lit("no matrix row for"), *keys)).cast("array<double>")))
    at = lambda c: F.get(F.col("values"), F.try_element_at(place, F.col(c))).cast("double")
    return rows.withColumn("wt_value", at("wt_aa")).withColumn("mut_value", at("mut_aa")).drop("values")


def summed(found: DataFrame, keys: list[str]) -> DataFrame:
    """Masked marginals: mutant less wild type, summed by ``keys``; null if any component has no value."""
    missing = F.count_if(F.col("mut_value").isNull() | F.col("wt_value").isNull())
    total = lambda c: F.when(missing == 0, F.sum(c))
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_components"), total(F.col("mut_value") - F.col("wt_value")).alias("masked_marginal"), total(F.col("mut_value")).alias("mutant_logp"), total(F.col("wt_value")).alias("wt_logp")
    )


def z_ensemble(rows: DataFrame, group: list[str], columns: list[str], reference: Column, name: str = "ensemble") -> DataFrame:
    """Mean z-score of ``columns``; mean and sample deviation come from the group's ``reference`` rows and serve all its rows.

    Statistics are aggregated map-side and joined back, so a group of any size is never sorted in one task. A group with fewer
    than two reference rows, or a deviation of 0, gives null. Null or non-finite values give null.
    """
    known = {c: F.when(reference & finite(F.col(c)), F.col(c)) for c in columns}
    stats = rows.groupBy(*group).agg(*[f(v).alias(f"_{n}_{c}") for c, v in known.items() for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = [F.when(finite(F.col(c)), (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) for c in columns]
    out = rows.join(stats, group, "left")
    return out.withColumn(name, sum(z[1:], z[0]) / len(z)).drop(*[c for c in stats.columns if c not in group])


def stand_in(found: Column, bonus: float = 0.0) -> Column:
    """A repeatable number from the letters and places of a mutant, where no model is at hand; it says nothing about fitness."""
    return F.aggregate(found, F.lit(float(bonus)), lambda acc, x: acc + (F.ascii(x["alt"]) - F.ascii(x["wt"])) / F.lit(25.0) - F.lit(0.03) * x["pos"])


def stand_in_evolution(found: Column) -> Column:
    return F.aggregate(found, F.lit(0.0), lambda acc, x: acc + (x["pos"] % 7 - 3) * F.lit(0.2) + (F.ascii(x["alt"]) % 5) * F.lit(0.05))


def saturation(comps: DataFrame) -> DataFrame:
    """All nineteen alternatives at each position some component needs: (context_sha256, chain_position, wt_aa, mut_aa)."""
    needed = comps.select("context_sha256", "chain_position", "wt_aa").distinct()
    every = F.explode(F.array(*[F.lit(a) for a in mutation.RESIDUES]))
    return needed.withColumn("mut_aa", every).filter("mut_aa <> wt_aa")


def scored(rows: DataFrame, score: Callable[[str, list[str]], list[float]], wild: str = "wt", mutant: str = "mutant") -> DataFrame:
    """Run a scorer on batches: adds score, valid, error. ``score`` takes a wild type and its mutants.

    If it fails on a batch it is tried mutant by mutant, and a mutant that fails has its error in its row. Null inputs
    are invalid. Rows of one wild type may reach the scorer in several calls.
    """
    columns = rows.columns

    def one(wt: str, mutants: list[str]) -> list[tuple]:
        try:
            return [(float(s), True, None) for s in score(wt, mutants)]
        except Exception as e:  # noqa: BLE001
            if len(mutants) == 1:
                return [(None, False, f"{type(e).__name__}: {e}"[:200])]
            return [one(wt, [m])[0] for m in mutants]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[columns].reset_index(drop=True)
            result: list[tuple] = [(None, False, "empty")] * len(out)
            usable = out[out[wild].notna() & out[mutant].notna()]
            for wt, part in usable.groupby(wild, sort=False):
                for i, r in zip(part.index, one(wt, part[mutant].tolist())):
                    result[i] = r
            frame = pd.DataFrame(result, columns=["score", "valid", "error"])
            yield out.assign(score=pd.to_numeric(frame["score"]), valid=frame["valid"], error=frame["error"])

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("score double, valid boolean, error string").fields]))


# -- alignments ------------------------------------------------------------------------------------------------


def fasta_records(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, record_no, header, sequence) of texts in FASTA form; lines are joined, blanks dropped. Other texts give nothing."""
    good = texts.filter(F.col(column).rlike(r"^\s*>"))
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(column, "\r", "")), "\n\\s*>", -1), lambda x: F.btrim(x, F.lit(" \t\n")) != "")
    rows = good.select(key, F.posexplode(parts).alias("i", "part"))
    return rows.select(
        key, (F.col("i") + 1).alias("record_no"), F.btrim(F.substring_index("part", "\n", 1), F.lit(" \t")).alias("header"),
        F.regexp_replace(F.when(F.instr("part", "\n") > 0, F.substring(F.col("part"), F.instr("part", "\n") + 1, F.lit(2147483647))).otherwise(""), r"\s", "").alias("sequence"),
    )


def aligned(records: DataFrame, key: str) -> DataFrame:
    """Records without insertions (lower case and dots), with the query's length, gap fraction and whether the alphabet is plain."""
    rows = records.withColumn("aligned", F.regexp_replace("sequence", r"[a-z.]", ""))
    query = rows.filter("record_no = 1").select(key, F.length("aligned").alias("query_length"))
    rows = rows.join(query, key)
    gaps = F.length(F.regexp_replace("aligned", "[^-]", ""))
    return rows.withColumn("gap_fraction", gaps / F.nullif(F.col("query_length"), F.lit(0))).withColumn("plain", F.col("aligned").rlike(rf"^[{mutation.RESIDUES}-]*\z")).withColumn(
        "fits", F.length("aligned") == F.col("query_length")
    )


def depths(rows: DataFrame, key: str, most_gaps: float = 0.5) -> DataFrame:
    """Per alignment: records, those with few enough gaps, those of a plain alphabet too; inserted and unknown residues."""
    few = F.col("fits") & (F.col("gap_fraction") <= most_gaps)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(few).alias("n_few_gaps"), F.count_if(few & F.col("plain")).alias("n_used"),
        F.sum(F.length(F.regexp_replace("sequence", "[^a-z]", ""))).alias("n_inserted"), F.sum(F.length(F.regexp_replace("aligned", rf"[{mutation.RESIDUES}-]", ""))).alias("n_unknown"),
    )


def column_profile(rows: DataFrame, key: str, vocabulary: int = 33) -> DataFrame:
    """(key, column_no, token, n, frequency, log_value): frequencies of a column and the log-softmax *of the frequencies*.

    The softmax runs over a vocabulary of ``vocabulary`` tokens, those that don't occur included with frequency 0. Residues
    other than the 20 standard ones and the gap count under X.
    """
    used = rows.filter("fits")
    letters = used.select(key, F.posexplode(F.split("aligned", "")).alias("c", "token")).filter("token <> ''")
    token = F.when(F.col("token").rlike(rf"^[{mutation.RESIDUES}-]\z"), F.col("token")).otherwise("X")
    counts = letters.groupBy(key, "c", token.alias("token")).agg(F.count(F.lit(1)).alias("n"))
    column = Window.partitionBy(key, "c")
    freq = counts.withColumn("frequency", F.col("n") / F.sum("n").over(column))
    places = F.count(F.lit(1)).over(column)
    total = F.sum(F.exp("frequency")).over(column) + (F.lit(vocabulary) - places)
    return freq.select(key, (F.col("c") + 1).alias("column_no"), "token", "n", "frequency", (F.col("frequency") - F.ln(total)).alias("log_value"))
