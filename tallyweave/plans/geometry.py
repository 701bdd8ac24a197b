"""Queries over points (the first three values of each embedding) and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import geometry
from tallyweave.plans.common import r6, sql_r6
from tallyweave.session import table

_RADIUS = 0.05


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")])


def g_within(spark: SparkSession, d: str) -> DataFrame:
    return geometry.within(_points(spark, d), "grp", _RADIUS).groupBy("grp", "id").agg(F.count(F.lit(1)).alias("n_neighbours"), r6(F.min("distance")).alias("closest"))


def g_nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return geometry.nearest(rows.filter("id % 20 = 0"), rows, 3).select("query_id", "rank", "id", r6(F.col("distance")).alias("distance"))


def g_nearest_of_label(spark: SparkSession, d: str) -> DataFrame:
    """As g_nearest, among embeddings of the same label, in small blocks and parts."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vector"))
    return geometry.nearest(rows.filter("id % 20 = 0"), rows, 3, "grp", 64, 500).select("grp", "query_id", "rank", "id", r6(F.col("distance")).alias("distance"))


def g_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Radial and positional encodings of neighbours within the radius, summed by point."""
    met = geometry.within(_points(spark, d), "grp", _RADIUS).withColumn("r", geometry.radial(F.col("distance"), 0.0, _RADIUS, 4)).withColumn("t", geometry.positional(F.col("id") - F.col("other"), 4))
    return met.groupBy("grp", "id").agg(*[r6(F.sum(F.col("r")[i])).alias(f"r{i}") for i in range(4)], *[r6(F.sum(F.col("t")[i])).alias(f"t{i}") for i in range(4)])


def g_voxels(spark: SparkSession, d: str) -> DataFrame:
    return geometry.voxels(_points(spark, d), "grp", 0.1).select("grp", "cx", "cy", "cz", "n", *[r6(F.col(f"mean_{a}")).alias(f"mean_{a}") for a in "xyz"])


def g_scattered(spark: SparkSession, d: str) -> DataFrame:
    """All points by id over 37 slots, and three more slots that no point falls into."""
    values = _points(spark, d).select((F.col("id") % 37).alias("slot"), "x")
    slots = spark.range(40).select(F.col("id").alias("slot"))
    return geometry.scattered(values, slots, "slot", "x").select("slot", r6(F.col("total")).alias("total"), r6(F.col("mean")).alias("mean"), F.when(F.col("top") > -1e300, r6(F.col("top"))).alias("top"))


def g_restricted(spark: SparkSession, d: str) -> DataFrame:
    pts = _points(spark, d)
    return geometry.restricted(pts, geometry.within(pts, "grp", _RADIUS).select("id"), "grp").select("grp", "id", "new_id")


QUERIES = {f.__name__: f for f in (g_within, g_nearest, g_nearest_of_label, g_encoded, g_voxels, g_scattered, g_restricted)}

_P = "WITH p AS (SELECT vec_id AS id, label AS grp, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_NEAR = _P + f""", near AS (SELECT a.grp, a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM p a JOIN p b ON a.grp = b.grp AND a.id <> b.id
  AND abs(a.x - b.x) < {_RADIUS} AND abs(a.y - b.y) < {_RADIUS} AND abs(a.z - b.z) < {_RADIUS})"""

SQL = {
    "g_within": _NEAR + f" SELECT grp, id, count(*) AS n_neighbours, {sql_r6('min(d)')} AS closest FROM near WHERE d < {_RADIUS} GROUP BY 1, 2",
    "g_nearest": f"""SELECT query_id, CAST(rank AS INT) AS rank, id, {sql_r6('d')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM
      (SELECT q.vec_id AS query_id, e.vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) ** 2))) AS d
       FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= 3""",
    "g_nearest_of_label": f"""SELECT grp, query_id, CAST(rank AS INT) AS rank, id, {sql_r6('d')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM
      (SELECT q.label AS grp, q.vec_id AS query_id, e.vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) ** 2))) AS d
       FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= 3""",
    "g_encoded": _P + f""", m AS (SELECT a.grp, a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM p a JOIN p b ON a.grp = b.grp AND a.id <> b.id
      AND abs(a.x - b.x) < {_RADIUS} AND abs(a.y - b.y) < {_RADIUS} AND abs(a.z - b.z) < {_RADIUS})
      SELECT grp, id, {', '.join(f"{sql_r6(f'sum(exp(-power((d - {i} * {_RADIUS} / 3) / ({_RADIUS} / 3), 2)))')} AS r{i}" for i in range(4))},
        {sql_r6('sum(cos(id - other))')} AS t0, {sql_r6('sum(cos((id - other) * 0.01))')} AS t1, {sql_r6('sum(sin(id - other))')} AS t2, {sql_r6('sum(sin((id - other) * 0.01))')} AS t3 FROM m WHERE d < {_RADIUS} GROUP BY 1, 2""",
    "g_voxels": _P + f""" SELECT grp, CAST(floor(x / 0.1) AS BIGINT) AS cx, CAST(floor(y / 0.1) AS BIGINT) AS cy, CAST(floor(z / 0.1) AS BIGINT) AS cz, count(*) AS n, {', '.join(f"{sql_r6(f'avg({a})')} AS mean_{a}" for a in 'xyz')}
      FROM p GROUP BY 1, 2, 3, 4""",
    "g_scattered": _P + f""", s AS (SELECT unnest(range(40)) AS slot), v AS (SELECT id % 37 AS slot, x FROM p)
      SELECT s.slot, {sql_r6('coalesce(sum(x), 0.0)')} AS total, {sql_r6('coalesce(avg(x), 0.0)')} AS mean, {sql_r6('max(x)')} AS top FROM s LEFT JOIN v ON v.slot = s.slot GROUP BY 1""",
    "g_restricted": _NEAR + f", k AS (SELECT DISTINCT grp, id FROM near WHERE d < {_RADIUS}) SELECT grp, id, CAST(dense_rank() OVER (PARTITION BY grp ORDER BY id) - 1 AS INT) AS new_id FROM k",
}
