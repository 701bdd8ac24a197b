"""Confidence fallback, structure and combined blends, multi-FASTA and variants files."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import arrays
from tallyweave.sources import files


def test_confidence_fallback(spark):
    rows = spark.createDataFrame([(69.9,), (70.0,), (None,)], "b double").select(arrays.confident(F.col("b"), F.lit("own"), F.lit("sequence")).alias("x"))
    assert [r["x"] for r in rows.collect()] == ["sequence", "own", "own"]
    off = spark.createDataFrame([(1.0,)], "b double").select(arrays.confident(F.col("b"), F.lit("own"), F.lit("sequence"), None).alias("x"))
    assert off.first()["x"] == "own"


def test_combined_blend(spark):
    cases = [(-1.0, -2.0, -3.0), (-1.0, None, -3.0), (-1.0, -2.0, None)]
    rows = spark.createDataFrame(cases, "logits double, structure double, residue double")
    both = arrays.blend_both(F.col("logits"), F.col("structure"), F.col("residue"), 0.8)
    got = [r["x"] for r in rows.select(both.alias("x")).collect()]
    assert got == pytest.approx([0.2 * (0.2 * -1 + 0.8 * -2) + 0.8 * -3, 0.2 * -1 + 0.8 * -3, -1.0])
    assert [r["x"] for r in rows.select(arrays.blend_both(F.col("logits"), F.col("structure"), F.col("residue"), 0.0).alias("x")).collect()] == [-1.0] * 3


def test_multi_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"stray\n>x one\r\nac-\r\n d.e \r\n\r\n>y\n>x one\nA.\n>z\nQ")
    (tmp_path / "b.fa").write_text("no record\n")
    got = sorted(tuple(r)[1:] for r in files.multi_fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")]).collect())
    assert got == [(0, ">x one", "A<pad>"), (1, ">y", ""), (3, ">z", "Q")]
    (tmp_path / "c.fa").write_text(">x\n ac-\nd.e \n")
    assert files.multi_fasta(spark, [str(tmp_path / "c.fa")]).first()["sequence"] == "AC<pad>D<pad>E"


def test_variants(spark, tmp_path):
    def read(content):
        (tmp_path / "v.csv").write_text(content)
        return [tuple(r) for r in files.variants(spark, tmp_path / "v.csv").orderBy("input_index").collect()]

    assert read("mutation,eve_score\nA1V,0.5\nA1G:C2D, -1e1\n") == [(0, "A1V", 0.5), (1, "A1G:C2D", -10.0)]
    assert read("mutation\nA1V\n") == read("eve_score,mutation\n,A1V\n") == [(0, "A1V", None)]
    for bad in ("mutant\nA1V\n", "mutation,eve_score\nA1V,1\nA1G,\n", "mutation,eve_score\nA1V,1d\n"):
        with pytest.raises(files.SourceError):
            read(bad)
