"""Row numbers and average ranks inside groups of any size.

Where all groups have fewer than ``HEAVY_FROM`` rows a window numbers them. Where one has more, rows are cut into ranges of their
whole order key - group, number and tie-break - numbered inside each range, and shifted by how many rows of their group lie
in the ranges before. A group of any size, and a number that most of its rows share, is then spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import cut

HEAVY_FROM = 2_000_000


def has_heavy(df: DataFrame, group: str, heavy_from: int = HEAVY_FROM) -> bool:
    """Whether a group has at least ``heavy_from`` rows. Counted map-side first."""
    return not df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= heavy_from).isEmpty()


def numbered(df: DataFrame, group: str, by: Column, then: list[Column], name: str, heavy: bool = False) -> DataFrame:
    """Add ``name``: 1, 2, ... inside each group, ascending by the number ``by``, then by ``then``. Null numbers come first.

    The order has to be total for a repeatable result. Without ``heavy`` it is one window. With it there are as many ranges as
    shuffle partitions; at most one group reaches from each range into the next, so fewer shifts than ranges are broadcast.
    Rows equal in group, number and tie-break stay in one range.
    """
    row_number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(by, *then))
    if not heavy:
        return df.withColumn(name, row_number(group))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # which range a row is in has to stay the same whenever it is read
    ranged = cut(df.repartitionByRange(ranges, F.col(group), by, *then).withColumn("_s", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(group, "_s", F.sum("_c").over(before).alias("_before")).filter("_before > 0")
    out = ranged.withColumn(name, row_number(group, "_s")).join(F.broadcast(shifts), [group, "_s"], "left")
    return out.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("int")).select(*df.columns, name)


def average_rank(df: DataFrame, group: str, value: str, number: str, name: str, heavy: bool = False) -> DataFrame:
    """Add ``name``: the mean of ``number`` among rows of equal ``value``, given row numbers in that value's order.

    With ``heavy`` a value may have too many rows for a window; means are then aggregated and joined back.
    """
    if not heavy:
        return df.withColumn(name, F.avg(number).over(Window.partitionBy(group, value)))
    return df.join(df.groupBy(group, value).agg(F.avg(number).alias(name)), [group, value])
