"""Every query against its SQL, on the smallest test tables."""

import glob
import os
from decimal import Decimal

import pytest

from corpusgraph.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return str(value)


def agree(spark, name, run, sql):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted([plain(r[i]) for i in order] for r in found.fetchall())
    df = run(spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    got = sorted([plain(x) for x in r] for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())
    assert got == want, name


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    agree(spark, name, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
