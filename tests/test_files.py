"""File sources, sinks and the resumable stream in temporary folders."""

import csv
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tallyweave.sources import files, sinks
from tallyweave.streaming import resume


def _write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return path


def test_truth_tree(spark, tmp_path):
    _write(tmp_path / "T2/norm_data/a_random_multi.csv", "mutant,DMS_score\n A1V ,1\n,2\nA1G,nan\n")
    _write(tmp_path / "T2/norm_data/b.csv", "﻿DMS_score,mutant,note\n3,C2D,\"x\ny\"\n")
    rows = files.truth(spark, tmp_path, "T2")
    typed = sorted((tuple(r) for r in files.typed_truth(rows).collect()), key=str)
    assert typed == [("a_random_multi", "A1G", None), ("a_random_multi", "A1V", 1.0), ("a_random_multi", None, 2.0), ("b", "C2D", 3.0)]
    _write(tmp_path / "T3/norm_data/x/anchor_1.csv", "candidate_group_id,mutant,DMS_score\ng1,A1V,1\n")
    assert files.truth(spark, tmp_path, "T3").first()["grp"] == "g1"
    _write(tmp_path / "T1/norm_data/c.csv", "mutant\nA1V\n")
    with pytest.raises(files.SourceError, match="DMS_score"):
        files.truth(spark, tmp_path, "T1")
    with pytest.raises(files.SourceError):
        files.truth_root(spark, tmp_path / "nowhere", "T1")


@pytest.mark.parametrize("content, why", [
    ("candidate_group_id,mutant,DMS_score\ng1,A1V,1\ng2,A1G,1\n", "several"), ("candidate_group_id,mutant,DMS_score\ng1,,1\ng1,A1G,x\n", "no valid"),
    ("candidate_group_id,mutant,DMS_score\ng0,A1V,1\n", "files of one group"), ("candidate_group_id,mutant,DMS_score\n", "without rows"), ("candidate_group_id,mutant\ng,A1V\n", "no column"),
])
def test_truth_trees_that_are_refused(spark, tmp_path, content, why):
    _write(tmp_path / "T3/norm_data/a/anchor_1.csv", "candidate_group_id,mutant,DMS_score\ng0,A1V,1\n")
    _write(tmp_path / "T3/norm_data/b/anchor_2.csv", content)
    with pytest.raises(files.SourceError, match=why):
        files.truth(spark, tmp_path, "T3")


def _tasks(spark, group):
    status = spark.sparkContext.statusTracker()
    return sum(s.numTasks for j in status.getJobIdsForGroup(group) for i in status.getJobInfo(j).stageIds if (s := status.getStageInfo(i)))


def test_a_tree_of_many_files(spark, tmp_path):
    """A folder is listed once, its small files are put into few tasks, and it's read whole whatever the names are."""
    names = [f"g {i}+%41é" for i in range(150)]
    for i, name in enumerate(names):
        _write(tmp_path / f"T2/norm_data/{name}.csv", f"mutant,DMS_score\nA{i}V,{i}\n")
    (tmp_path / "T2/norm_data/folder.csv").mkdir()
    spark.sparkContext.setJobGroup("many", "many")
    try:
        rows = files.truth(spark, tmp_path, "T2")
        assert sorted((r["grp"], r["item"], r["score"]) for r in rows.collect()) == sorted((n, f"A{i}V", str(i)) for i, n in enumerate(names))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert 0 < _tasks(spark, "many") < 100
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(files.SMALL_FILE)
    # a file that a scan of the folder would pass over, and one with other columns
    _write(tmp_path / "T2/norm_data/h.csv", "DMS_score,x,mutant\n7,,C1D\n")
    assert {r["item"]: r["score"] for r in files.truth(spark, tmp_path, "T2").collect()} == {f"A{i}V": str(i) for i in range(150)} | {"C1D": "7"}
    kept = [str(p) for p in sorted((tmp_path / "T2/norm_data").glob("g*.csv"))[:40]]
    assert files.read_csv(spark, kept, index=False).count() == 40


@pytest.mark.parametrize("everywhere", [True, False])
def test_one_file_a_key(spark, tmp_path, monkeypatch, everywhere):
    if not everywhere:
        monkeypatch.setattr(sinks.storage, "local_path", lambda *_: None)
    rows = [(f"k{i % 7}", f"A{i}V", i / 8, 'a "b", c\nd') for i in range(100)]
    place = tmp_path / "by key"
    assert sinks.csv_by_key(spark.createDataFrame(rows, "key string, mutant string, DMS_score double, note string"), str(place), "key") == 7
    assert sorted(p.name for p in place.iterdir() if not p.name.startswith(".")) == [f"k{i}.csv" for i in range(7)]
    for k in range(7):
        with (place / f"k{k}.csv").open(newline="") as f:
            got = list(csv.reader(f))
        assert got[0] == ["mutant", "DMS_score", "note"] and sorted(got[1:]) == sorted([m, str(x), n] for g, m, x, n in rows if g == f"k{k}")
    with pytest.raises(ValueError, match="exists"):
        sinks.csv_by_key(spark.createDataFrame(rows, "key string, mutant string, DMS_score double, note string"), str(place), "key")


def test_predictions(spark, tmp_path):
    one = _write(tmp_path / "one.csv", "assay_id,annots,score\ng.csv,A1V,0.5\ng,C2D,0.7\n")
    got = files.predictions(spark, one, "T2").orderBy("input_index").collect()
    assert [(r["grp"], r["item"], r["order_value"], r["source"]) for r in got] == [("g", "A1V", -0.5, "one.csv:2"), ("g", "C2D", -0.7, "one.csv:3")]
    _write(tmp_path / "d/x.csv", "mutation,rank\nA1V,2\n,1\n")
    _write(tmp_path / "d/sub/y__z.csv", "mutant\nC2D\nA1V\n")
    got = sorted((r["grp"], r["item"], r["order_value"]) for r in files.predictions(spark, tmp_path / "d", "T2").collect())
    assert got == [("x", "A1V", 2.0), ("y|z", "A1V", 2.0), ("y|z", "C2D", 1.0)]
    # files further down stand for their group whatever columns they have, as do _random_multi files of T2
    _write(tmp_path / "e/p/q.csv", "assay,mutant\nother,A1V\n")
    _write(tmp_path / "e/r_random_multi.csv", "assay,mutant\nother,A1V\n")
    _write(tmp_path / "e/s.csv", "assay,mutant\n , A1V\nother,A1V\nother, \n")
    groups = lambda task, group=None: sorted(r["grp"] for r in files.predictions(spark, tmp_path / "e", task, group).collect())
    assert groups("T2") == ["other", "p|q", "r_random_multi"] and groups("T3") == ["other", "other", "p_T3"] and groups("T2", "assay") == ["other", "other", "p|q"]
    # a blank group is left out before its score is looked at
    blank = _write(tmp_path / "blank.csv", "assay,mutant,score\n ,A1V,oops\ng,A1V,1_0\n")
    assert [(r["grp"], r["order_value"], r["input_index"]) for r in files.predictions(spark, blank, "T2").collect()] == [("g", -10.0, 1)]
    assert [files.top_k(t, k) for t, k in (("T1", None), ("T2", 40), ("T2", 7), ("T1", 3))] == [40, 5, 7, 3]
    bad = _write(tmp_path / "bad.csv", "assay,mutant,score\ng,A1V,oops\n")
    with pytest.raises(Exception, match="bad score"):
        files.predictions(spark, bad, "T2").collect()
    with pytest.raises(files.SourceError, match="group"):
        files.predictions(spark, _write(tmp_path / "n.csv", "mutant\nA\n"), "T2")
    assert files.choose(["a", "b"], ["b", "a"]) == "b" and files.choose(["a"], ["a"], "z") is None


def test_assays_candidates_context(spark, tmp_path):
    path = _write(tmp_path / "assay.csv", "assay_id,fitness_type,wildtype_sequence\na,,AC\n,x,AC\na,NA,AD\n")
    assert [tuple(r) for r in files.assays(spark, path).collect()] == [("a", "NA", "AD")]
    assert [r["mutant"] for r in files.candidates(spark, _write(tmp_path / "c.csv", "mutant\nB\n \nA\n")).collect()] == ["B", "A"]
    with pytest.raises(files.SourceError):
        files.candidates(spark, _write(tmp_path / "e.csv", "mutant\n \n"))
    assert tuple(files.visible_context(spark, _write(tmp_path / "v.csv", "mutant,DMS_score\nA,1\nB,x\n")).first()) == ("A", 1.0)
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write("a,b\n1,\n")
    assert files.read_csv(spark, [tmp_path / "p.csv.gz"]).select("a", "b", "input_index").first() == ("1", "", 0)
    rows = files.read_csv(spark, [_write(tmp_path / "w +x.csv", 'a,b\n1,2,3\n\n"x\n""y""",\n4\n')]).orderBy("input_index").collect()
    assert [(r["a"], r["b"], r["input_index"]) for r in rows] == [("1", "2", 0), ('x\n"y"', "", 1), ("4", "", 2)] and rows[0]["path"].endswith("/w +x.csv")
    with pytest.raises(files.SourceError, match="header"):
        files.read_csv(spark, [_write(tmp_path / "none.csv", "")])


def test_groups_of_the_agent(spark, tmp_path):
    """Windows of assays and groups, exactly one group id, the visible anchor, the context's place."""
    data = tmp_path / "T3"
    _write(data / "norm_data/a/anchor_1.csv", "candidate_group_id,mutant,anchor_mutant,anchor_DMS_score\ng1, A1V ,,\ng1,,C2D,0.5\n")
    _write(data / "norm_data/a/anchor_2.csv", "candidate_group_id,mutant,anchor_mutant,anchor_DMS_score,model_visible_anchor_DMS_score\ng2,A1G,C2D,0.5,0.7\n")
    _write(data / "norm_data/b/anchor_1.csv", "candidate_group_id,mutant,anchor_mutant,anchor_DMS_score\ng3,A1V,C2D,1\n")
    records = spark.createDataFrame([("a", 0), ("b", 1)], "assay_id string, assay_no int")
    groups, items = files.group_files(spark, data, "T3", records)
    assert sorted((r["source_assay"], r["grp"], r["anchor_score"]) for r in groups.collect()) == [("a", "g1", "0.5"), ("a", "g2", "0.7"), ("b", "g3", "1")]
    assert sorted(r["item"] for r in items.collect()) == ["A1G", "A1V", "A1V"]
    grp = lambda **k: sorted(r["grp"] for r in files.group_files(spark, data, "T3", records, **k)[0].collect())
    assert grp(most_groups=1, groups_from=1) == ["g2"] and grp(assays_from=1) == ["g3"] and grp(most_assays=1) == ["g1", "g2"]
    four = tmp_path / "T4"
    _write(four / "norm_data/a/single_context_combo_1.csv", "candidate_group_id,mutant\ng,A1V:C2D\n")
    _write(four / "norm_data/b/single_context_combo_1.csv", "candidate_group_id,mutant,single_mutant_context_path\nh,A1V:C2D,T4/c.csv\n")
    places = {r["grp"]: r["context_path"] for r in files.group_files(spark, four, "T4", records)[0].collect()}
    assert places["g"].endswith("/norm_data/a/single_mutant_context.csv") and places["h"] == f"file://{tmp_path}/T4/c.csv"
    _write(four / "norm_data/b/single_context_combo_2.csv", "candidate_group_id,mutant\nh,A1V\ni,A1V\n")
    with pytest.raises(files.SourceError, match="exactly one"):
        files.group_files(spark, four, "T4", records)
    two = tmp_path / "T2"
    _write(two / "norm_data/a_random_multi.csv", "mutant\nA1V\n")
    _write(two / "norm_data/a.csv", "mutant\nA1V\n")
    assert [(r["source_assay"], r["grp"]) for r in files.group_files(spark, two, "T2", records)[0].collect()] == [("a", "a_random_multi")]


def test_small_readers(spark, tmp_path):
    t = _write(tmp_path / "theta.csv", "key,theta\na,0.2\nb,0.01\n")
    assert files.thetas(spark, t, "key").count() == 2
    for bad in ("a,0.2\na,0.3\n", "a,1\n", ",0.5\n", "a,x\n"):
        with pytest.raises(files.SourceError):
            files.thetas(spark, _write(tmp_path / "bad.csv", "key,theta\n" + bad), "key")
    assert files.line_count(spark, t) == 3 and files.line_count(spark, tmp_path / "nothing") == 0
    assert files.first_existing(spark, [tmp_path / "no", t]) == str(t) and files.first_existing(spark, []) is None
    paths = spark.createDataFrame([("b", "AC"), ("a", "AC"), ("c", "D")], "path string, query string")
    got = files.context_index(paths, spark.createDataFrame([("AC",), ("E",)], "sequence string"))
    assert sorted((r["sequence"], r["path"]) for r in got.collect()) == [("AC", "a"), ("E", None)]
    records = spark.createDataFrame([("x", "/d/./p.csv"), ("y", ""), ("z", None)], "assay_id string, candidate_path string")
    found = files.candidate_index(spark.createDataFrame([("file:///d/p.csv",), ("file:///d/q.csv",)], "path string"), records)
    assert sorted((r["path"], r["assay_id"]) for r in found.collect()) == [("file:///d/p.csv", "x"), ("file:///d/q.csv", None)]
    row = spark.createDataFrame([(" ", "b ", None)], "a string, b string, c string").select(files.first_filled(["a", "b"]).alias("x"), files.first_filled(["a", "c"]).alias("y")).first()
    assert tuple(row) == ("b", "unknown")


def test_numbers_as_c_writes_them(spark):
    values = [0.5, 1.0, 1e-5, 123456789.0, 0.1 + 0.2, -2.5e-4, 12345678.9, 99999999.9, 1e300, -1.0 / 3, 0.0, 1e-300, 1234567.891, float("inf"), float("nan"), 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(sinks.decimals(F.col("v"))).collect()] == ["%.8g" % v for v in values]


def _shards(folder, **change):
    config = {"model_id": "m", "output_schema_sha256": "s"}
    for n in range(2):
        _write(folder / f"shard_{n:04d}.json", json.dumps({"shard_id": n, "num_shards": 2, "samples": 1, "dataset_id": "d", "dataset_hash": "h", "run_config": config, "run_config_sha256": files.json_digest(config)} | change))
        _write(folder / f"shard_{n:04d}.csv", f"sample_id,x\ns{n},1\n")


def test_shards(spark, tmp_path):
    _shards(tmp_path / "ok")
    assert files.shards(spark, tmp_path / "ok", ["sample_id", "x"], "s", {"dataset_id": "d", "dataset_hash": "h"}).count() == 2
    for asked, why in ((dict(columns=["x", "sample_id"]), "columns"), (dict(schema_digest="t"), "provenance"), (dict(dataset={"dataset_id": "d", "dataset_hash": "i"}), "another")):
        with pytest.raises(files.SourceError, match=why):
            files.shards(spark, tmp_path / "ok", **asked)
    for change, why in (({"num_shards": 3}, "incomplete"), ({"samples": 2}, "rows"), ({"partial_run": True}, "partial"), ({"run_config_sha256": "no"}, "provenance")):
        _shards(tmp_path / why, **change)
        with pytest.raises(files.SourceError, match=why):
            files.shards(spark, tmp_path / why)


def _atom(serial, name, residue, number, chain="A", alt=" "):
    return f"ATOM  {serial:5d}  {name:<3s}{alt}{residue} {chain}{number:4d}    {1.0:8.3f}{2.0:8.3f}{3.0:8.3f}  1.00  0.00"


def test_structures_and_alignments(spark, tmp_path):
    good = [_atom(i, a, r, n) for i, (a, r, n) in enumerate([("N", "ALA", 1), ("CA", "ALA", 1), ("C", "ALA", 1), ("O", "ALA", 1), ("CA", "CYS", 2)], 1)]
    p = _write(tmp_path / "a.pdb", "\n".join(good))
    assert tuple(files.pdb_sequence(spark, [str(p)]).select("sequence", "sound").first()) == ("AC", True)
    q = _write(tmp_path / "b.pdb", "\n".join([*good, _atom(9, "CA", "ASP", 4)]))
    assert tuple(files.pdb_sequence(spark, [str(q)]).select("sequence", "sound").first()) == ("ACD", False)
    assert [r["number"] for r in files.backbone(spark, [str(p)]).collect()] == [1]
    m = _write(tmp_path / "m.a3m", ">query x\nAC-aa\nDE.\n>hit\nAAAA\n")
    assert files.alignment_query(spark, [str(m)]).first()["query"] == "ACDE"
    assert files.parse_settings("top: 1 # note\nmodels:\n  first: '/x'\n  list:\n    - a\n    - b\n") == {"": {"top": "1"}, "models": {"first": "/x", "list": ["a", "b"]}}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("T1", 2, 0.1), ("T2", 1, 0.2)], "task string, n int, x double")
    sinks.by_task(df, str(tmp_path / "t"), ["n"])
    assert sorted(p.name for p in (tmp_path / "t").glob("task=*")) == ["task=T1", "task=T2"]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.by_task(df, str(tmp_path / "t"), ["n"])
    sinks.one_csv(df, tmp_path / "o.csv")
    assert (tmp_path / "o.csv").read_text().splitlines()[0] == "task,n,x"
    with pytest.raises(ValueError):
        sinks.one_csv(df, tmp_path / "o2.csv", most=1)
    sinks.one_json(df.limit(1), tmp_path / "o.json")
    assert list(json.loads((tmp_path / "o.json").read_text())) == ["n", "task", "x"]
    sinks.fasta(spark.createDataFrame([("h", "AC")], "header string, sequence string"), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 2
    sinks.one_fasta(spark.createDataFrame([("i", "D"), ("h", "AC")], "header string, sequence string"), tmp_path / "f.fasta")
    assert (tmp_path / "f.fasta").read_text() == ">h\nAC\n>i\nD\n"
    # an empty result still has its header, and a file that is there is replaced as a whole
    sinks.one_csv(df.limit(0), tmp_path / "o.csv")
    assert (tmp_path / "o.csv").read_text() == "task,n,x\n" and not [p for p in tmp_path.iterdir() if p.name.startswith(".o.csv.") and not p.name.endswith(".crc")]
    cache = str(tmp_path / "cache")
    assert sinks.cache_append(df, cache, ["task"]) == 2 and spark.read.parquet(cache).count() == 2
    assert sinks.cache_append(df.unionByName(df.withColumn("task", F.lit("T3")).limit(1)), cache, ["task"]) == 1
    for _ in range(2):
        sinks.append_json(df, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4
    sinks.by_key_json(df, str(tmp_path / "keyed"), "task")
    assert sorted(p.name for p in (tmp_path / "keyed").glob("task=*")) == ["task=T1", "task=T2"]
    assert spark.read.parquet(cache).count() == 3


def test_resume(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "mark")
    work = lambda df: df.withColumn("answer", F.length("text"))
    run = lambda: resume.run_available(spark, str(source), "id bigint, text string", out, mark, ["id"], work)
    _write(source / "1.json", '{"id": 1, "text": "ab"}\n{"id": 1, "text": "ab"}\n')
    assert run() == 1
    _write(source / "2.json", '{"id": 1, "text": "ab"}\n{"id": 2, "text": null}\n')
    run()
    assert sorted((r["id"], r["answer"]) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, None)]


def test_rounds(spark, tmp_path):
    tasks = spark.range(5)
    log = str(tmp_path / "log")
    assert resume.rounds(tasks, log, ["id"], lambda t: t.orderBy("id").limit(2)) == 0
    assert spark.read.parquet(log).count() == 5
    assert resume.rounds(spark.range(9), log, ["id"], lambda t: t.filter("id < 7"), most=5) == 2
