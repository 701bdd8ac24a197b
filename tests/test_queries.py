"""Every registered query of the core against its SQL on the smallest tables."""

import json
import re

import oracle
import pytest

from tallyweave.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def _rankings(spark):
    """Every response's ranking, found by a plain walk."""
    texts = spark.read.parquet(f"{DATA}/documents.parquet").filter("source = 'llm_response'").select("doc_id", "text").collect()

    def walk(text):
        spans, depth = [], 0
        fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text or "", re.I | re.S)
        for i, c in enumerate(text or ""):
            if c == "{":
                depth += 1
                start = i if depth == 1 else start
            elif c == "}" and depth:
                depth -= 1
                spans += [text[start : i + 1]] if not depth else []
        for part in [*([fenced.group(1)] if fenced else []), *spans, text or ""]:
            try:
                value = json.loads(part)
            except ValueError:
                continue
            ranking = value.get("ranking") if isinstance(value, dict) else None
            return [str(x).strip() for x in ranking] if isinstance(ranking, list) else []
        return []

    want = sorted((r["doc_id"], i, m) for r in texts for i, m in enumerate(walk(r["text"]), 1))
    assert want and sorted(map(tuple, QUERIES["r_rankings"](spark, DATA).collect())) == want


#: Checks of the queries that have no SQL.
PLAIN = {"r_rankings": _rankings}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert oracle.compare(spark, name, QUERIES[name], SQL[name], DATA) == ""
    else:
        PLAIN[name](spark)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
