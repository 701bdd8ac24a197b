"""Rejected rows, packed fields, dominant keys on hand-written cases."""

import random
import re

import pyarrow as pa
import pytest

from tallyweave.operators import balance, packed, rejects

LINES = "line_id bigint, source_csv string, source_assay string, line_no int, raw_line string, extra string"


def _lines(spark, rows):
    return spark.createDataFrame([(i, "f", "a", n, raw, "x") for i, n, raw in rows], LINES)


@pytest.fixture
def assays(spark):
    return spark.createDataFrame([("a", "ACD:EF", 1), ("b", None, 2)], "assay_id string, wildtype_sequence string, line_id int")


CASES = {
    2: ("A1V,1", ""), 3: ('"A1V",".5"\r', ""), 4: ('"A1V,1', "quoting"), 5: ('A"1V,1', "quoting"), 6: ('"A1V"x,1', "quoting"), 7: ("A1V", "column_count"),
    8: ("", "column_count"), 9: (None, "column_count"), 10: ("A1V,1,", "column_count"), 11: (" ,1", "blank_mutant"), 12: ("A1A,1", "bad_mutant"),
    13: ("A2V,1", "bad_mutant"), 14: ("A1V+A1G,1", "bad_mutant"), 15: (" a1v+e4f ,1e3", ""), 16: ("A1V,nan", "bad_score"), 17: ("A1V,1e999", "bad_score"),
    18: ("A1V++E4F,+.", "bad_mutant,bad_score"), 19: ('"",""', "bad_score,blank_mutant"), 20: ('"A1V","1""2"', "bad_score"), 21: ('"A1V",""""', "bad_score"),
    22: ("A99999999999999999999V,1", "bad_mutant"), 23: ("A1V,1_0", "bad_score"), 24: ('"A1V\n",1', ""), 25: ("A0V,1", "bad_mutant"),
    26: ("A1V," + "9" * 200_000, "bad_score"), 27: ('"' + '""' * 100_000 + '",1', "bad_mutant"), 28: ("A1V,\x0b1", "bad_score"),
}


def test_reasons(spark, assays):
    lines = _lines(spark, [(1, 1, '﻿"mutant",DMS_score\r'), *((i, i, raw) for i, (raw, _) in CASES.items()), (99, None, "A1V,1")])
    found = {r["line_id"]: r["reasons"] for r in rejects.rejected(lines, assays).collect()}
    assert found == {i: why for i, (_, why) in CASES.items() if why}
    clean = {r["line_id"]: (r["mutant"], r["dms_score"]) for r in rejects.clean_rows(lines, assays).collect()}
    assert set(clean) == {i for i, (_, why) in CASES.items() if not why}
    assert clean[15] == ("A1V+E4F", 1000.0)


def test_no_header_no_assay_no_rows(spark, assays):
    lines = _lines(spark, [(2, 2, "A1V,1")])
    assert [r["reason"] for r in rejects.violations(lines, assays).collect()] == ["column_count"]
    assert rejects.violations(lines.limit(0), assays).count() == 0
    lines = spark.createDataFrame([(1, "f", "b", 1, "mutant,DMS_score", ""), (2, "f", "b", 2, "A1V,1", "")], LINES)
    assert [r["reason"] for r in rejects.violations(lines, assays).collect()] == ["bad_mutant"]


def _reference(text):
    """Substitutions by a plain left-to-right walk."""
    one = r"[A-Za-z][0-9]+[A-Za-z]"
    quoted = "|".join(f"{re.escape(a)}[^{re.escape(b)}]*{re.escape(b)}" for a, b in packed.QUOTES.items())
    item, out = 0, []
    for m in re.finditer(f"{quoted}|{one}(?: *[+:] *{one})*", text or ""):
        subs = re.findall(one, m.group())
        item += bool(subs)
        out += [(item, k, s.upper()) for k, s in enumerate(subs, 1)]
    return out


def test_packed_against_walk():
    rng = random.Random(5)
    bits = ["A1V", "b22c", "D3E4F5G", "+", ":", " + ", " ", "\n", ",", '"', "'", "`", "“", "”", "«", "»", "1", "é", "x", "", ";", "‘", "’", "„"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)] + [None, "", "+", '"A1V B2C', "A1V" * 5000]
    array = pa.array(["drop me", *texts]).slice(1)
    row, item, sub, found = packed.split_packed(array)
    got = {}
    for r, i, s, t in zip(row, item, sub, found.to_pylist()):
        got.setdefault(int(r), []).append((int(i), int(s), t))
    for n, text in enumerate(texts):
        assert got.get(n, []) == _reference(text), ascii(text)


def test_packed_frame(spark):
    df = spark.createDataFrame([(1, 'A1V + B2C;"D3E F4G"', "x"), (1, None, "y"), (None, "H5I", "z")], "task_no bigint, mutants string, item_pos string")
    rows = sorted((tuple(r) for r in packed.flatten_packed(df, "task_no", "mutants").collect()), key=str)
    assert rows == [(1, 1, 1, "A1V"), (1, 1, 2, "B2C"), (1, 2, 1, "D3E"), (1, 2, 2, "F4G"), (None, 1, 1, "H5I")]
    assert packed.flatten_packed(df.limit(0), "task_no", "mutants").count() == 0


def test_plan_covers_shards_and_balances():
    plan = balance.plan_shards([("f", "hot", 500), ("f", "warm", 100), ("f", "cool", 20)], 1000, 8)
    shards = {k: sorted(s for f, k2, _, s, _ in plan if k2 == k) for k in ("hot", "warm", "cool")}
    assert shards == {"hot": list(range(8)), "warm": [0, 1], "cool": [0]}
    loads = [0.0] * 8
    for _, k, n, _, task in plan:
        loads[task] += {"hot": 500, "warm": 100, "cool": 20}[k] / n
    assert max(loads) <= 2 * sum(loads) / 8


def test_balanced_results_with_hot_key(spark):
    nan = float("nan")
    rows = [(i, "hot" if i % 3 else f"k{i % 40}", "" if i % 5 == 0 else "c", f"s{i % 211}" if i % 7 else None, nan if i % 11 == 0 else float(i), i) for i in range(3000)]
    rows += [(5000, None, None, None, None, 1), (5000, None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "row_id bigint, a string, b string, sample_id string, v double, task int")
    got = {(r["field"], r["key_val"]): r for r in balance.balanced_results(df, ["a", "b"], "sample_id", "v", "row_id", tasks=7).collect()}
    for field, at in (("a", 1), ("b", 2)):
        for key in {r[at] for r in rows} - {None, ""}:
            mine = [r for r in rows if r[at] == key]
            values = [r[4] for r in mine if r[4] is not None and r[4] == r[4]]
            out = got.pop((field, key))
            assert (out["n_rows"], out["n_samples"]) == (len(mine), len({r[3] for r in mine} - {None}))
            assert out["mean_measure"] == pytest.approx(sum(values) / len(values))
            assert out["tasks_used"] > 3 or key not in ("hot", "c")
    assert not got
    assert balance.balanced_results(df.limit(0), ["a", "b"], "sample_id", "v", "row_id").count() == 0


def test_replicated_join_is_a_left_join(spark):
    left = spark.createDataFrame([(i, None if i == 3 else "h" if i % 2 else f"k{i}", "l") for i in range(200)], "row_id bigint, key string, name string")
    side = spark.createDataFrame([("h", 1, "r"), ("h", 2, "r"), ("k4", 3, "r")], "key string, value int, name string")
    got = sorted((tuple(r) for r in balance.replicated_join(left, side, "key", "row_id", tasks=5).collect()), key=str)
    want = sorted((tuple(r) for r in left.join(side.drop("name"), "key", "left").select("row_id", "key", "name", "value").collect()), key=str)
    assert got == want


def test_replicated_join_with_a_side_that_is_not_small(spark):
    """Neither side is broadcast, and no shard of the hot key holds much more than a task's share."""
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", i) for i in range(3000)]
    left = spark.createDataFrame(rows, "row_id bigint, key string, clash int")
    side = spark.createDataFrame([("hot", 1, 0), *((f"k{i}", i, 0) for i in range(0, 50, 2))], "key string, value int, clash int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = balance.replicated_join(left, side, "key", "row_id", tasks=6)
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["row_id"], r["key"], r["value"], r["clash"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    known = {"hot": 1} | {f"k{i}": i for i in range(0, 50, 2)}
    assert got == [(i, k, known.get(k), c) for i, k, c in rows]


def test_packed_slices_are_read_in_place():
    import pyarrow as pa

    values = pa.array(["A1B", None, "C2D+E3F; G4H", "", "I5K"])
    whole, part = packed.split_packed(values), packed.split_packed(values.slice(2, 2))
    assert part[3].to_pylist() == ["C2D", "E3F", "G4H"] and part[0].tolist() == [0, 0, 0] and whole[3].to_pylist() == ["A1B", "C2D", "E3F", "G4H", "I5K"]
    assert packed.split_packed(values.slice(1, 0))[3].to_pylist() == []
