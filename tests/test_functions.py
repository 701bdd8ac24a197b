"""Notations, windows, vectors, responses, integrity rules."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import arrays, csvline, mutation, text, windows
from tallyweave.operators import canonical, contexts, finalize, integrity, responses, scoring


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("mutant, good", [("A1V:A1G", False), ("D1V", False), ("A9V", False), ("A1A", False), ("D3A:A1G", True), ("A1V", True), ("", False), (None, None)])
def test_legal(spark, mutant, good):
    got = spark.createDataFrame([(mutant, "ACDE")], "m string, w string").select(mutation.legal(mutation.parts(F.col("m")), F.col("w")).alias("x")).first()["x"]
    assert got is good or (good is None and not got)


def test_ordered_and_applied(spark):
    rows = spark.createDataFrame([("D3A:A1G", "AC:DE")], "m string, w string")
    found = mutation.ordered(mutation.parts(F.col("m")))
    flat = mutation.applied(mutation.flat_sequence(F.col("w")), found)
    out = rows.select(mutation.notation(found).alias("n"), mutation.rechained(flat, mutation.chain_bounds(F.col("w"))).alias("s")).first()
    assert tuple(out) == ("A1G:D3A", "GC:AE")


def test_dialects(spark):
    cases = {("prefixed", "p.A1V,p.a1v"): "A1V", ("prefixed", ""): "WT", ("mixed", "D3A; A1G"): "A1G:D3A", ("colon", "A1A"): "A1A", ("strict", "A1A"): "synonymous", ("colon", "A1V+D3A"): "format", ("strict", "A1V+A1G"): "position", ("strict", "A7V"): "range", ("strict", "C1V"): "residue", ("strict", ""): "empty"}
    for (name, mutant), want in cases.items():
        r = spark.createDataFrame([(mutant, "ACDE")], "m string, w string").select(mutation.dialect(F.col("m"), F.col("w"), name).alias("x")).first()["x"]
        assert (r["normalized"] if r["valid"] else r["error"]) == want, (name, mutant)


@pytest.mark.parametrize("position, length, want", [(0, 100, (0, 100)), (0, 1187, (0, 1022)), (1186, 1187, (165, 1187))])
def test_half_open_windows(spark, position, length, want):
    assert tuple(_one(spark, windows.half_open(F.col("n"), F.col("p"), 1022), n=length, p=position)) == want


def test_required_window(spark):
    assert tuple(_one(spark, windows.required(F.col("n"), F.col("a"), F.col("b"), 100), n=300, a=290, b=295)) == (201, 300)
    assert _one(spark, windows.required(F.col("n"), F.col("a"), F.col("b"), 100), n=300, a=1, b=150) is None


def test_numbers_and_names(spark):
    cases = [("1", 1.0), (" -.5e1\t", -5.0), ("1d", None), ("1f", None), ("nan", None), ("inf", None), ("", None), (None, None), ("1e400", None), ("1.", 1.0), (".", None), ("0x1", None)]
    df = spark.createDataFrame(cases, "a string, b double")
    assert [r["x"] for r in df.select(text.finite_number(F.col("a")).alias("x")).collect()] == [b for _, b in cases]
    assert _one(spark, text.group_id(F.col("a")), a=" x.csv\n") == "x"
    told = {
        "abcd api_key=zz sk-1234567890123": "[REDACTED] api_key=[REDACTED] [REDACTED]", "Authorization: Bearer x.y-z end": "Authorization: [REDACTED] end",
        "API  key : q": "API  key : [REDACTED]", "bearer token=t": "bearer token=[REDACTED]", "Access Token: Bearer t u": "Access Token: [REDACTED] u",
        "xai-a.b_c-0123456789": "[REDACTED]", "sk-short": "sk-short", "MY_API_KEY=zz": "MY_API_KEY=[REDACTED]",
    }
    for said, want in told.items():
        assert _one(spark, text.redact(F.col("a"), ["abc", "abcd"]), a=said) == want
    for value, want in ((" \xa0 1_000.5e-1\u2003", 100.05), ("1__0", None), ("_1", None), ("inf", None), ("1d", None), (".5", 0.5), ("1e400", None), ("", None), (None, None)):
        assert _one(spark, text.python_float(F.col("a")), a=value) == want
    for value, want in (("a b/c.csv", "a_b_c.csv"), ("..", "unknown"), ("", "unknown"), ("__x-._", "x-"), (None, None)):
        assert _one(spark, text.safe_component(F.col("a")), a=value) == want
    assert _one(spark, text.safe_component(F.col("a"), 20), a="abcdefghijklmnopqrstuvwxyz") == "abcdefghi_" + hashlib.sha1(b"abcdefghijklmnopqrstuvwxyz").hexdigest()[:10]
    assert _one(spark, text.residues_only(F.col("a")), a=" ac-xB:D1 ") == "ACD" and _one(spark, text.residues_only(F.col("a")), a=" NaN ") == ""
    assert _one(spark, text.joined_sequence(F.col("a")), a=">h x\nac d\r\n-e\n >i\nf") == "ACD-EF" and _one(spark, text.joined_sequence(F.col("a"), False), a="a-\tc") == "AC"
    assert [_one(spark, text.service_url(F.col("a")), a=x) for x in ("h/", "h/v1//", "", None)] == ["h/v1", "h/v1", None, None]


def test_csv_fields(spark):
    cases = ['a,b', '"a,b",c', '"a""b"', '""', ',', '"\x01a,\x01b",x', "", 'a,"b\nc"', '"""",""']
    want = [["a", "b"], ["a,b", "c"], ['a"b'], [""], ["", ""], ["\x01a,\x01b", "x"], [""], ["a", "b\nc"], ['"', ""]]
    for line, fields in zip(cases, want):
        assert _one(spark, csvline.fields(csvline.quote_pieces(F.col("a"))), a=line) == fields


def test_log_softmax(spark):
    got = spark.createDataFrame([([1.0, 2.0, 700.0],), (None,), ([],)], "a array<double>").select(arrays.log_softmax(F.col("a")).alias("x")).collect()
    assert got[0]["x"] == pytest.approx([-699.0, -698.0, 0.0])
    assert got[1]["x"] is None and got[2]["x"] in (None, [])
    assert _one(spark, arrays.structure_tokens(F.array(F.lit(0), F.lit(5)))) == [1, 3, 8, 2]
    assert _one(spark, arrays.structure_tokens(F.array(F.lit(-1)))) is None


RESPONSES = {
    'x ```json\n{"ranking": [" A1V ", 3, null]}\n``` y': ["A1V", "3", "None"], '{"a": 1} {"ranking": ["B"]}': None, 'so {bad} then {"ranking": ["B", ""]}': ["B", ""],
    "": None, "no": None, '{"ranking": {}}': None, '{"ranking": ["a}b"]}': ["a}b"], "[1]": None, "```{broken}``` {\"ranking\": []}": [],
}


def test_responses(spark):
    for said, want in RESPONSES.items():
        assert responses._ranking(said) == want, said
    df = spark.createDataFrame([(k,) for k in [*RESPONSES, None]], "t string")
    assert [r["x"] for r in df.select(responses.extracted_ranking(F.col("t")).alias("x")).collect()] == [*RESPONSES.values(), None]
    assert _one(spark, responses.greedy_ranking(F.col("t")), t='go {"ranking": ["a", " ", "b "]} end') == ["a", "b"]
    assert _one(spark, responses.filled('{a} {{"x"}} {b}', {"a": F.lit(1), "b": F.lit(None)})) == '1 {"x"} '


def test_closed_set_and_generation(spark):
    named = spark.createDataFrame([(1, "g", i, m) for i, m in enumerate(["a", "x", "a", "b"], 1)], "doc_id int, grp string, rank int, mutant string")
    pool = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "x")], "grp string, mutant string")
    got = {r["rank"]: (r["verdict"], r["new_rank"]) for r in responses.closed_set(named, pool, "doc_id", "grp").collect()}
    assert got == {1: ("kept", 1), 2: ("outside", None), 3: ("duplicate", None), 4: ("kept", 2)}
    named = spark.createDataFrame([(1, i, m, "ACDE") for i, m in enumerate(["A1V", "A1V", "Z1V", "C2A", "D3A"], 1)], "doc_id int, rank int, mutant string, wt string")
    assert tuple(responses.generated(named, "doc_id", 2).first()) == (1, 2, 1, 1, 0)
    told = named.withColumn("measured", F.col("mutant") != "A1V")
    assert tuple(responses.generated(told, "doc_id", 2).first()) == (1, 2, 1, 0, 2)


def test_scorer_isolates_failures(spark):
    def score(wt, mutants):
        if "bad" in mutants:
            raise ValueError("no")
        return [len(m) for m in mutants]

    rows = spark.createDataFrame([("w", "a"), ("w", "bad"), (None, "c"), ("w", None)], "wt string, mutant string")
    got = {(r["wt"], r["mutant"]): (r["score"], r["valid"], r["error"]) for r in scoring.scored(rows, score).collect()}
    assert got[("w", "a")] == (1.0, True, None) and got[("w", "bad")] == (None, False, "ValueError: no") and not got[(None, "c")][1]


def test_shard_plan():
    assert contexts.plan_shards([("a", 5), ("b", 5), ("c", 3), ("d", 1)], 2) == [("a", 5, 0), ("b", 5, 1), ("c", 3, 0), ("d", 1, 1)]


def test_ensemble_needs_spread(spark):
    rows = spark.createDataFrame([("g", 1.0, 2.0, True), ("g", 3.0, 6.0, True), ("g", 9.0, 9.0, False), ("h", 1.0, 1.0, True)], "g string, a double, b double, ok boolean")
    got = {(r["g"], r["a"]): r["e"] for r in scoring.z_ensemble(rows, ["g"], ["a", "b"], F.col("ok"), "e").collect()}
    assert got[("g", 1.0)] == pytest.approx(-math.sqrt(0.5)) and got[("h", 1.0)] is None


def test_integrity_rules(spark):
    wild = spark.createDataFrame([("q1", "AC:DE")], "assay_id string, wildtype_sequence string")
    proteins = canonical.proteins(wild)
    row = proteins.first()
    assert json.loads(row["chain_boundaries"]) == [[1, 2], [3, 4]] and row["sequence_length"] == 4
    assert integrity.protein_rules(proteins).isEmpty()
    broken = integrity.protein_rules(proteins.withColumn("sequence_length", F.lit(5)).withColumn("n_chains", F.lit(1)))
    assert {r["rule"] for r in broken.collect()} == {"wt_length", "wt_chains"}
    pool = spark.createDataFrame([(1, "T2", "q", "q1", "D3A+A1G", None, "AC:DE")], "row_id int, task string, query_id string, source_assay string, mutant string, given_sequence string, wildtype_sequence string")
    sampled = canonical.samples(canonical.parsed(pool), "d")
    subs = canonical.substitutions(sampled)
    assert [(r["chain_id"], r["chain_position"], r["global_position"]) for r in subs.orderBy("component_index").collect()] == [(1, 1, 1), (2, 1, 3)]
    assert integrity.component_rules(sampled, subs, proteins).isEmpty()
    said = integrity.component_rules(sampled, subs.withColumn("chain_position", F.lit(2)), proteins)
    assert {r["rule"] for r in said.collect()} == {"component_residue"}
    said = integrity.component_rules(sampled, subs.filter("component_index = 2"), proteins)
    assert {r["rule"] for r in said.collect()} == {"component_count", "component_order"}
    with pytest.raises(integrity.IntegrityError, match="component_count"):
        integrity.require(said)
    integrity.require(said.limit(0))
    twice = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "c")], "k int, v string")
    assert [r["key"] for r in integrity.one_value(twice, ["k"], ["v"], "r").collect()] == ["2"]
    assert integrity.same_set(twice, twice, ["k"], "r").isEmpty() and not integrity.disjoint(twice, twice, ["k"], "r").isEmpty()


def test_labels_stay_out(spark):
    names = "row_id bigint, candidate_group_id string, mutant string, mutated_sequence string, dms_score double"
    queries = spark.createDataFrame([("T2", "q", "a")], "task string, query_id string, source_assay string")
    wild = spark.createDataFrame([("a", "ACDE")], "assay_id string, wildtype_sequence string")
    make = lambda score: canonical.samples(canonical.parsed(canonical.pool(spark.createDataFrame([(1, "q", "A1V", "VCDE", score)], names), queries, wild)), "d")
    hashes = {canonical.content_hash(make(s).drop("components"), ["sample_id"]) for s in (1.0, 2.0)}
    assert len(hashes) == 1 and not {"dms_score", "score"} & set(make(1.0).columns)
    assert canonical.content_hash(make(1.0).select("sample_id"), ["sample_id"]) not in hashes


def test_long_form_and_coverage(spark):
    a = spark.createDataFrame([("m", 1.0, None)], "model string, x double, y double")
    assert {(r["metric"], r["value"]) for r in finalize.long_form(a, ["model"], ["x", "y"]).collect()} == {("x", 1.0), ("y", None)}
    e, r = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(x["k"], x["found"]) for x in finalize.coverage(e, r, ["k"]).collect()} == {(1, "expected_only"), (2, "both"), (3, "result_only")}
