"""Every query that has SQL against DuckDB on the smallest tables, where they are at hand."""

import math
import os

import duckdb
import pytest

from graphloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings documents".split()


def value(x):
    return float(x) if isinstance(x, (int, float)) or x.__class__.__name__ == "Decimal" else x


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) or a != a and b != b)


def rounded(row):
    return tuple("%.6g" % x if isinstance(x, float) else str(x) for x in row)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted((tuple(map(value, r)) for r in found.select(*columns).collect()), key=rounded)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(map(value, r)) for r in con.sql(f"SELECT {quoted} FROM ({registry.ORACLE_SQL[name]})").fetchall()), key=rounded)
    assert len(got) == len(want) > 0
    assert all(near(a, b) for x, y in zip(got, want) for a, b in zip(x, y))
