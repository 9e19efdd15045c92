"""Registered queries on the driver's tables against DuckDB, and that every operator has one of its own."""

import os
import re

import pytest

from symdex.plans import driver_queries, operator_queries, registry, store_queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_rows_as_duckdb(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    known = driver_queries.QUERIES | operator_queries.QUERIES | store_queries.QUERIES
    texts = driver_queries.ORACLE_SQL | operator_queries.ORACLE_SQL | store_queries.ORACLE_SQL
    assert set(known) == set(texts)
    different = []
    for name, q in known.items():
        df = q(spark, SF)
        columns = sorted(df.columns)
        got = [tuple(r[c] for c in columns) for r in df.collect()]
        con.execute(texts[name])
        kinds = {d[0]: str(d[1]) for d in con.description}
        at = [list(kinds).index(c) for c in columns if c in kinds]
        want = [tuple(r[i] for i in at) for r in con.fetchall()]
        if set(kinds) != set(columns) or sorted(map(str, rounded(got))) != sorted(map(str, rounded(want))) or any(KINDS.get(k, k) != kinds[c] for c, k in df.dtypes):
            different.append(name)
    assert not different


def rounded(rows):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]


def test_every_operator_is_asked():
    """Each name of the registry is run by a query; those whose result is no set of rows have tests of their own."""
    with open(operator_queries.__file__) as f:
        text = f.read()
    asked = set(re.findall(r'ask\(\s*\S+, "([^"]+)"', text)) | {"find_callers", "find_references", "grep_source"}
    own_tests = {"refactor", "lint", "foldingRange", "semanticTokens", "semanticTokens/range", "semanticTokens/delta", "inlayHint/parameters"}
    assert {*registry.TOOLS, *registry.EDITOR, *registry.ADMIN} - asked - own_tests == set()
