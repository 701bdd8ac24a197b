"""Queries on inputs where leaving rows out would show."""

import os

import duckdb
import pytest

from tallyweave.functions import mutation
from tallyweave.plans import geometry, scoring

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_lookup_beyond_the_smallest_ids(spark, tmp_path):
    """A mutant at position 600 of a chain has its value in embedding 600."""
    for folder, name in ((SMALL, "assays"), (LARGE, "queries"), (LARGE, "embeddings")):
        os.symlink(f"{folder}/{name}.parquet", tmp_path / f"{name}.parquet")
    con = duckdb.connect()
    query, wt = con.execute(f"""SELECT query_id, substr(trim(wildtype_sequence), 600, 1) FROM '{LARGE}/queries.parquet' q JOIN '{SMALL}/assays.parquet' a ON a.assay_id = q.source_assay
        WHERE length(wildtype_sequence) > 600 AND NOT contains(wildtype_sequence, ':') ORDER BY 1""").fetchone()
    alt = "A" if wt != "A" else "C"
    con.execute(f"COPY (SELECT * REPLACE ('{query}' AS candidate_group_id, '{wt}600{alt}' AS mutant, NULL AS mutated_sequence) FROM '{SMALL}/candidates.parquet' LIMIT 1) TO '{tmp_path}/candidates.parquet'")
    e = con.execute(f"SELECT embedding FROM '{LARGE}/embeddings.parquet' WHERE vec_id = 600").fetchone()[0]
    rows = scoring.s_lookup(spark, str(tmp_path)).collect()
    assert rows and all(r["n_components"] == 1 for r in rows)
    for r in rows:
        assert r["masked_marginal"] == pytest.approx(e[mutation.RESIDUES.index(alt)] - e[mutation.RESIDUES.index(wt)], abs=2e-6)
        assert r["mutant_logp"] < 0 and r["wt_logp"] < 0


def test_scatter_leaves_no_point_out(spark):
    got = {r["slot"]: (r["total"], r["mean"], r["top"]) for r in geometry.g_scattered(spark, SMALL).collect()}
    points = duckdb.sql(f"SELECT vec_id % 37, CAST(embedding[1] AS DOUBLE) FROM '{SMALL}/embeddings.parquet'").fetchall()
    assert set(got) == set(range(40))
    for slot in range(40):
        x = [v for s, v in points if s == slot]
        want = (sum(x), sum(x) / len(x), max(x)) if x else (0.0, 0.0, None)
        assert got[slot] == pytest.approx(want, abs=2e-6), slot
    assert [s for s, v in got.items() if v[2] is None] == [37, 38, 39]
