"""The training-data queries against their SQL, or for their shape, on the smallest tables."""

import oracle
import pytest

from tallyweave.llm import queries, tokens

DATA = "/root/testdata/sf0.001"


def _ids(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    core = tokens.load("byte_bpe_50k").core
    want = sorted((r["doc_id"], core.encode_ordinary(r["text"] or "")) for r in texts)
    assert sorted((r["doc_id"], r["ids"]) for r in queries.p6_ids(spark, DATA).collect()) == want


def _usage(spark):
    """Figures of usage against the containers themselves, and how much is left unused."""
    fill = {}
    for r in queries.p7_packed(spark, DATA).collect():
        fill.setdefault(r["limit_name"], {}).setdefault(r["container"], []).append(r["n_tokens"])
    most = {r["limit_name"]: r["max_tokens"] for r in spark.read.parquet(f"{DATA}/token_limits.parquet").collect()}
    for r in queries.p7_usage(spark, DATA).collect():
        sums = [sum(x) for x in fill.pop(r["limit_name"]).values()]
        assert (r["containers"], r["tokens"], r["fullest"]) == (len(sums), sum(sums), max(sums))
        # a container more than the tokens need, or 2 %
        assert r["containers"] <= max(1.02 * sum(sums) / most[r["limit_name"]], sum(sums) / most[r["limit_name"]] + 2)
    assert not fill


#: Checks of the queries that have no SQL; p7_packed and p8_pieces are held by p7_checked and p8_checked.
PLAIN = {"p6_ids": _ids, "p7_usage": _usage, "p7_packed": _usage, "p8_pieces": lambda spark: None}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        assert oracle.compare(spark, name, queries.QUERIES[name], queries.SQL[name], DATA) == ""
    else:
        PLAIN[name](spark)
