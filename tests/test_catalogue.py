"""Every query with an SQL equivalent gives DuckDB's rows at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quillforge.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, DIR)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, cur.fetchall())


def test_css_query(spark):
    out = catalogue.queries()["css_minify"](spark, DIR).first().css
    assert out.endswith("color:#abc!important}@media screen and (width:1px){p{top:0}}")
