"""Ranking metrics against a plain walk over random groups with ties, repeats, strangers and gaps; policies; large groups."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import policy, ranking
from tallyweave.operators.ordering import has_heavy, numbered


def _ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def _walk(group, truth, preds, k):
    lo, hi, n = min(truth.values()), max(truth.values()), len(truth)
    order = sorted(preds, key=lambda p: (p[1], p[2], p[0]))
    gain = lambda v: 1.0 if hi <= lo else (v - lo) / (hi - lo)
    head = {i for i, *_ in order[:k] if i in truth}
    best = max((truth[i] for i in head), default=lo)
    den = min(k, n)
    least = sorted(truth.values(), reverse=True)[den - 1]
    seen, dcg = {}, 0.0
    for pos, (item, value, _) in enumerate(order, 1):
        if item in truth and item not in seen:
            seen[item] = value
            dcg += gain(truth[item]) / math.log2(pos + 1) if pos <= n else 0.0
    ideal = sum(g / math.log2(p + 1) for p, g in enumerate(sorted(map(gain, truth.values()), reverse=True), 1))
    items = list(truth)
    given = dict(zip(seen, _ranks(list(seen.values()))))
    rest = sorted((i for i in items if i not in seen), key=lambda i: hashlib.sha256(f"{group}\0{i}".encode()).hexdigest())
    given |= {i: len(seen) + r for r, i in enumerate(rest, 1)}
    a, b = _ranks([-truth[i] for i in items]), [given[i] for i in items]
    ma, mb = sum(a) / n, sum(b) / n
    va, vb = sum((x - ma) ** 2 for x in a), sum((y - mb) ** 2 for y in b)
    rho = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(va * vb) if va > 1e-12 and vb > 1e-12 else 0.0
    return {
        "nms": 1.0 if hi <= lo else (best - lo) / (hi - lo), "recall": min(1.0, sum(truth[i] >= least for i in head) / den),
        "ndcg": dcg / ideal if ideal > 0 else 0.0, "spearman": rho,
        "illegal_in_budget": sum(i not in truth for i, *_ in order[:k]), "selected_rows": len(order[:k]),
    }


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(11)
    out = {}
    for g in range(40):
        n = rng.randrange(1, 14)
        truth = {f"m{i}": float(rng.randrange(5)) if g % 7 else 1.0 for i in range(n)}
        preds = [(f"m{rng.randrange(n + 3)}", float(rng.randrange(6)), i) for i in range(rng.randrange(1, 18))]
        out[f"g{g}"] = (truth, preds)
    return out


@pytest.mark.parametrize("heavy_from", [None, 3])
def test_metrics(spark, groups, heavy_from):
    truth = spark.createDataFrame([(g, i, v) for g, (t, _) in groups.items() for i, v in t.items()], "grp string, item string, score double")
    preds = spark.createDataFrame([(g, *p) for g, (_, ps) in groups.items() for p in ps], "grp string, item string, order_value double, input_index bigint")
    heavy = bool(heavy_from) and has_heavy(preds, "grp", heavy_from)
    places = ranking.truth_places(truth, heavy)
    ranked = ranking.joined(places, preds, heavy)
    per = truth.select("grp").distinct().withColumn("k", F.lit(5))
    head = {r["grp"]: r.asDict() for r in ranking.head_metrics(places, ranked, per).collect()}
    rho = {r["grp"]: r["spearman"] for r in ranking.spearman(ranking.prediction_ranks(places, ranked, heavy)).collect()}
    for g, (t, p) in groups.items():
        want = _walk(g, t, p, 5)
        got = head[g] | {"spearman": rho[g]}
        for name, value in want.items():
            assert got[name] == pytest.approx(value, abs=1e-9), (g, name)


def test_reading_counts_bad_rows(spark):
    nan = float("nan")
    rows = [("g.csv", " a ", 1.0), ("g", "a", 2.0), ("g", "", 1.0), ("g", None, nan), ("g", "b", float("inf")), (" ", "c", 1.0), (None, "c", 1.0)]
    df = ranking.read_truth(spark.createDataFrame(rows, "grp string, item string, score double"))
    assert [tuple(r) for r in ranking.collapse(df).collect()] == [("g", "a", 2.0)]
    q = ranking.truth_quality(df).first()
    assert (q["raw_rows"], q["invalid_mutant_rows"], q["invalid_score_rows"], q["num_truth"], q["duplicate_mutants_collapsed"]) == (5, 2, 2, 1, 1)
    assert ranking.truth_quality(df.limit(0)).count() == 0


def test_policies(spark):
    truth = spark.createDataFrame([(g, f"m{i}", float(i)) for g in ("none", "short", "full", "t1short") for i in range(6)], "grp string, item string, score double")
    preds = [("short", "m0", 1.0, 0), ("t1short", "m0", 1.0, 0), ("alien", "m0", 1.0, 0), *(("full", f"m{i}", float(-i), i) for i in range(6))]
    preds = spark.createDataFrame(preds, "grp string, item string, order_value double, input_index bigint")
    tasks = spark.createDataFrame([("none", "T2"), ("short", "T2"), ("full", "T3"), ("t1short", "T1")], "grp string, task string")
    flags = policy.group_flags(truth, preds, tasks)
    status = lambda mode: {r["grp"]: r["status"] for r in policy.decide(flags, mode).collect()}
    assert status(1) == {"none": "random_replacement", "short": "provided", "full": "provided", "t1short": "random_replacement"}
    assert status(2) == {"none": "skipped", "short": "skipped", "full": "provided", "t1short": "skipped"}
    with pytest.raises(policy.StrictnessError, match="missing: 1.*unknown: 1"):
        policy.decide(flags, 0)
    with pytest.raises(ValueError):
        policy.decide(flags, 3)
    out = {r["grp"]: r for r in policy.evaluate(truth, preds, policy.decide(flags, 1)).collect()}
    assert out["full"]["nms"] == out["full"]["ndcg"] == out["full"]["spearman"] == 1.0
    assert out["t1short"]["spearman"] is None and out["t1short"]["selected_rows"] == 6
    good = policy.group_flags(truth.filter("grp = 'full'"), preds.filter("grp = 'full'"), tasks)
    assert policy.decide(good, 0).first()["status"] == "provided"


def test_order_of_rows_does_not_matter(spark, groups):
    preds = [(g, *p) for g, (_, ps) in groups.items() for p in ps]
    schema = "grp string, item string, order_value double, input_index bigint"
    a = ranking.placed(spark.createDataFrame(preds, schema)).collect()
    b = ranking.placed(spark.createDataFrame(preds[::-1], schema).repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_numbering_by_ranges(spark):
    df = spark.range(5000).select(F.lit("g").alias("grp"), (F.col("id") % 13).cast("double").alias("v"), "id")
    heavy = has_heavy(df, "grp", 1000)
    got = numbered(df, "grp", F.col("v"), [F.col("id")], "n", heavy).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: (r["v"], r["id"]))] == list(range(1, 5001))


def test_a_value_that_all_rows_share_is_spread(spark):
    """Rows that tie in the number are cut into ranges by what breaks the tie."""
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        df = spark.range(6000).select(F.lit("g").alias("grp"), F.lit(1.0).alias("v"), "id").union(spark.createDataFrame([("h", None, 1), ("h", 2.0, 0)], "grp string, v double, id bigint"))
        got = numbered(df, "grp", F.col("v"), [F.col("id")], "n", True)
        rows = got.collect()
        pieces = df.repartitionByRange(6, "grp", "v", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert [r["n"] for r in sorted(rows, key=lambda r: r["id"]) if r["grp"] == "g"] == list(range(1, 6001))
    assert sorted((r["n"], r["v"]) for r in rows if r["grp"] == "h") == [(1, None), (2, 2.0)] and max(r["count"] for r in pieces) < 2500
