"""Points: neighbours within a radius, nearest neighbours, voxels, scatter by index, dense renumbering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AXES = ["x", "y", "z"]


def _cell(radius: float) -> list[Column]:
    return [F.floor(F.col(a) / radius).cast("bigint").alias(f"c{a}") for a in _AXES]


def within(points: DataFrame, group: str, radius: float) -> DataFrame:
    """(group, id, other, distance) of different points of a group closer than ``radius``.

    Points meet in grid cells as wide as the radius: each is looked for in its own and the 26 cells around, by an equi-join, so
    no pair further than two cells apart is formed. Rows with a null coordinate have no neighbours.
    """
    seated = points.dropna(subset=[group, *_AXES]).select(group, "id", *_AXES, *_cell(radius))
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    around = seated
    for a in _AXES:
        around = around.withColumn(f"_{a}", F.explode(steps)).withColumn(f"c{a}", F.col(f"c{a}") + F.col(f"_{a}")).drop(f"_{a}")
    other = seated.select(group, F.col("id").alias("other"), *[F.col(a).alias(f"o{a}") for a in _AXES], *[f"c{a}" for a in _AXES])
    apart = F.sqrt(sum(((F.col(a) - F.col(f"o{a}")) ** 2 for a in _AXES[1:]), (F.col("x") - F.col("ox")) ** 2))
    met = around.join(other, [group, *[f"c{a}" for a in _AXES]]).filter(F.col("id") != F.col("other"))
    return met.select(group, "id", "other", apart.alias("distance")).filter(F.col("distance") < radius)


def _closest(a: np.ndarray, me: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest of ``b`` to each of ``a``, itself left out. Products of all with all only choose
    whom to measure: everyone within rounding of the k-th."""
    square = (b * b).sum(1)
    said, found, far = [], [], []
    for start in range(0, len(a), 256):
        q, own = a[start : start + 256], me[start : start + 256]
        rough = (q * q).sum(1)[:, None] + square - 2 * (q @ b.T)
        rough[own[:, None] == ids] = np.inf
        slack = 1e-9 * ((q * q).sum(1) + square.max())
        least = min(k, len(b)) - 1
        edge = np.partition(rough, least, 1)[:, least] + slack
        row, col = np.nonzero((rough <= edge[:, None]) & np.isfinite(rough))
        apart = np.sqrt(((b[col] - q[row]) ** 2).sum(1))
        order = np.lexsort((ids[col], apart, row))
        row, col, apart = row[order], col[order], apart[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = nth < k
        said.append(own[row[kept]])
        found.append(ids[col[kept]])
        far.append(apart[kept])
    return np.concatenate(said), np.concatenate(found), np.concatenate(far)


def nearest(queries: DataFrame, rows: DataFrame, k: int, group: str | None = None, block: int = 8192, part: int = 50_000) -> DataFrame:
    """(query_id, rank, id, distance), with ``group`` that in front: the k nearest rows of each query, exactly, itself left out;
    smaller ids win ties.

    Both tables are (id, vector), with ``group`` (id, group, vector): then rows of the same group are looked at only. Queries are a
    stated set; blocks of about ``block`` of them meet hashed parts of about ``part`` rows, so a row is copied once for every
    ``block`` queries. Each meeting keeps k rows a query, and a window over those few ranks them. Null vectors take no part.
    """
    keys = [group] if group else []
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (rows, part)))
    hashed = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.dropna().select("id", "vector", *keys, hashed(blocks, 0).alias("block")).withColumn("part", every(parts))
    r = rows.dropna().select("id", "vector", *keys, hashed(parts, 1).alias("part")).withColumn("block", every(blocks))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            said, found, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            a, b = np.stack(left["vector"]).astype(np.float64), np.stack(right["vector"]).astype(np.float64)
            said, found, far = _closest(a, left["id"].to_numpy(), b, right["id"].to_numpy(), k)
        out = pd.DataFrame({"query_id": said, "id": found, "distance": far})
        return out.assign(**{group: left[group].iloc[0] if len(left) else None})[[*keys, *out.columns]] if group else out

    types = "".join(f"`{g}` {dict(queries.dtypes)[g]}, " for g in keys)
    by = [*keys, "block", "part"]
    met = q.groupBy(*by).cogroup(r.groupBy(*by)).applyInPandas(meet, f"{types}query_id bigint, id bigint, distance double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "query_id").orderBy("distance", "id")))
    return ranked.filter(F.col("rank") <= k).select(*keys, "query_id", "rank", "id", "distance")


def radial(distance: Column, least: float, most: float, count: int) -> Column:
    """Gaussian bumps of a distance: ``count`` centres from ``least`` to ``most``, each as wide as the step between them."""
    step = (most - least) / max(count - 1, 1)
    centres = [least + i * step for i in range(count)]
    return F.array(*[F.exp(-(((distance - c) / (step or 1.0)) ** 2)) for c in centres])


def positional(offset: Column, size: int) -> Column:
    """Cosines, then sines, of an offset at ``size`` / 2 frequencies from 1 down to 1 / 10000."""
    turns = [offset * 10000.0 ** (-2 * i / size) for i in range(size // 2)]
    return F.array(*[F.cos(t) for t in turns], *[F.sin(t) for t in turns])


def voxels(points: DataFrame, group: str, width: float) -> DataFrame:
    """Mean point of each occupied grid cell."""
    return points.dropna(subset=[group, *_AXES]).groupBy(group, *_cell(width)).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in _AXES])


def scattered(values: DataFrame, slots: DataFrame, index: str, value: str) -> DataFrame:
    """Sum, mean and maximum of ``value`` by ``index`` for every slot; empty slots have sum and mean 0 and maximum -inf."""
    sums = values.groupBy(index).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.max(value).alias("top"))
    out = slots.select(index).distinct().join(sums, index, "left")
    total, n = F.coalesce("total", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return out.select(index, total.alias("total"), (total / F.greatest(n, F.lit(1))).alias("mean"), F.coalesce("top", F.lit(float("-inf"))).alias("top"))


def restricted(points: DataFrame, referenced: DataFrame, group: str) -> DataFrame:
    """Points that are referenced, renumbered from 0 inside each group by id."""
    kept = points.join(referenced.select("id").distinct(), "id", "left_semi")
    return kept.withColumn("new_id", F.dense_rank().over(Window.partitionBy(group).orderBy("id")) - 1)
