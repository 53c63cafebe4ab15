"""Registered queries against their SQL on a small table."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tidelog.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return int(x) if isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iub" else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), sql.execute(catalog.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: Counter(tuple(map(plain, r)) for r in d[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"], cwd=root, capture_output=True, text=True)
    assert out.stdout.strip() == "True", out.stderr
