"""Top N items within every group, also where single groups hold millions of items: a hot-cold split.

Items are reduced to their best row map-side first. Exact counts then tell heavy groups from light ones. Light groups go
through an ordinary window, whose limit is applied before the shuffle, too. Heavy groups are sorted by salted ranges: quantiles of
the first order column cut each heavy group into ranges; exact counts of the ranges tell which of them can hold one of the N
best; a hash of the item splits those ranges by the group's size, every (group, salt) keeps its N best, and a last window ranks
those few. A heavy group has at least ``1 / HEAVY_MOST`` of all items, so there are at most HEAVY_MOST of them and what is
broadcast never exceeds that many short rows times the ranges kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import cut

#: Heavy groups at most; ranges of a heavy group; items of a range that one salt takes.
HEAVY_MOST, RANGES, SALT = 20_000, 32, 50_000


def top_items(rows: DataFrame, group: str, item: str, order: list[str], n: int, heavy_from: int = 20_000) -> DataFrame:
    """(group, pos, item) of the n best distinct items of each group.

    An item stands where its best row stands; ``order`` names columns that sort ascending, the item itself breaks what ties
    are left. Rows with a null group or item don't count; null order values sort first. ``heavy_from`` is the least number of
    items that makes a group heavy. An empty table gives no rows.
    """
    # adding zero makes -0.0 the same as 0.0
    kinds = dict(rows.dtypes)
    keys = [(F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c)).alias(f"_o{i}") for i, c in enumerate(order)]
    clean = rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    clean = clean.select(F.col(group).alias("_g"), F.col(item).alias("_m"), *keys)
    names = [f"_o{i}" for i in range(len(order))]
    by = clean.groupBy("_g", "_m")
    if len(order) == 1:
        # of one column the least value and whether there was a null are enough, and are kept in a hash table
        best = by.agg(F.min("_o0").alias("_o0"), F.max(F.col("_o0").isNull()).alias("_n")).select("_g", "_m", F.when(~F.col("_n"), F.col("_o0")).alias("_o0"))
    else:
        best = by.agg(F.min(F.struct(*names)).alias("_o")).select("_g", "_m", "_o.*")
    return _split(cut(best), names, n, heavy_from).select(F.col("_g").alias(group), F.col("_pos").alias("pos"), F.col("_m").alias(item))


def _split(best: DataFrame, names: list[str], n: int, heavy_from: int) -> DataFrame:
    counts = best.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    least = max(heavy_from, best.count() // HEAVY_MOST + 1)
    heavy = cut(counts.filter(F.col("_n") >= least))
    ranked = lambda df, *by: df.withColumn(
        "_pos", F.row_number().over(Window.partitionBy(*by).orderBy(*names, "_m"))
    ).filter(F.col("_pos") <= n)
    if heavy.isEmpty():
        return ranked(best, "_g")
    light = ranked(best.join(F.broadcast(heavy), "_g", "left_anti"), "_g")
    hot = best.join(F.broadcast(heavy), "_g")
    cuts = [i / RANGES for i in range(1, RANGES)]
    first = F.col(names[0]).cast("double")
    bounds = cut(hot.groupBy("_g").agg(F.percentile_approx(first, F.lit(cuts), F.lit(1000)).alias("_b")))
    hot = hot.join(F.broadcast(bounds), "_g", "left")
    # a null comes before all numbers, so in the first range
    hot = hot.withColumn("_r", F.coalesce(F.size(F.filter("_b", lambda b: b < first)), F.lit(0))).drop("_b")
    sizes = hot.groupBy("_g", "_r").agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    kept = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).filter(F.col("_before") < n)
    kept = kept.select("_g", "_r", F.ceil(F.col("_c") / SALT).alias("_salts"))
    near = hot.drop("_n").join(F.broadcast(kept), ["_g", "_r"])
    near = near.withColumn("_salt", F.pmod(F.xxhash64("_m"), F.col("_salts")))
    few = ranked(near, "_g", "_r", "_salt").drop("_pos")
    return light.unionByName(ranked(few, "_g").select(light.columns))
