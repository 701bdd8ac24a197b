"""Caches of model outputs by sequence and position: Parquet rows beside a manifest that says what made them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import integrity
from tallyweave.session import cut
from tallyweave.sources import sinks, storage


class CacheError(ValueError):
    """A cache that was made by something else, or whose rows don't hold together."""


def open_cache(spark: SparkSession, folder: str, about: dict) -> DataFrame | None:
    """Rows of a cache whose manifest says just what ``about`` says (format, configuration, tokens and the like); None if there
    is no cache yet."""
    if not storage.exists(spark, f"{folder}/cache.json"):
        return None
    told = json.loads(storage.read_text(spark, f"{folder}/cache.json"))
    differs = sorted(k for k in about.keys() | told.keys() if about.get(k) != told.get(k))
    if differs:
        raise CacheError(f"{folder}: {', '.join(differs)} differ")
    return spark.read.parquet(f"{folder}/rows") if storage.exists(spark, f"{folder}/rows") else None


def cache_rules(rows: DataFrame, sequences: DataFrame, width: int, zero_at: dict[str, int] | None = None) -> DataFrame:
    """What is wrong with rows (context_sha256, position, values): repeated positions, unknown contexts, positions outside the
    sequence, arrays of another length than ``width``, values that aren't finite.

    ``sequences`` is (context_sha256, sequence). ``zero_at`` maps residues to places in the array: the value of the residue that
    stands at the position has to be exactly 0.
    """
    keyed = rows.join(sequences, "context_sha256").withColumn("_key", F.concat_ws("|", "context_sha256", "position"))
    inside = F.col("position").between(1, F.length("sequence"))
    finite = ~F.exists("values", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    said = [
        integrity.unique(rows, ["context_sha256", "position"], "cache_unique"), integrity.covers(rows.select("context_sha256"), sequences, ["context_sha256"], "cache_context"),
        integrity.holds(keyed, "_key", inside, "cache_position"), integrity.holds(keyed, "_key", F.size("values") == width, "cache_width"), integrity.holds(keyed, "_key", finite, "cache_finite"),
    ]
    if zero_at:
        place = F.create_map(*[x for a, i in sorted(zero_at.items()) for x in (F.lit(a), F.lit(i))])
        own = F.get(F.col("values"), F.try_element_at(place, F.substring("sequence", F.col("position"), F.lit(1))))
        said.append(integrity.holds(keyed, "_key", own == 0, "cache_wild_type"))
    return reduce(DataFrame.unionByName, said)


def extend(spark: SparkSession, folder: str, about: dict, needed: DataFrame, compute, sequences: DataFrame, width: int, zero_at: dict[str, int] | None = None) -> dict[str, int]:
    """Compute what a cache lacks of ``needed`` (context_sha256, position) and append it; returns how many positions were
    required, reused and computed. Old and new rows are checked before anything is written."""
    held = open_cache(spark, folder, about)
    needed = cut(needed.select("context_sha256", "position").distinct())
    if held is not None:
        integrity.require(cache_rules(held, sequences, width, zero_at))
    lacking = needed if held is None else needed.join(held.select("context_sha256", "position"), ["context_sha256", "position"], "left_anti")
    news = cut(compute(lacking).select("context_sha256", "position", "values"))
    integrity.require(cache_rules(news, sequences, width, zero_at))
    if held is None:
        storage.write_text(spark, f"{folder}/cache.json", json.dumps(about, sort_keys=True) + "\n")
    total = needed.count()
    computed = sinks.cache_append(news, f"{folder}/rows", ["context_sha256", "position"])
    return {"required": total, "computed": computed, "reused": total - computed}
