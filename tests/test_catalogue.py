"""Every registered query of the engine against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from docloom import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in rows)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert mine == theirs


def test_whole_queries_use_every_order(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    got = {n: catalogue.QUERIES[n](spark, SF) for n in ("write_status", "project_fields", "occ_conflicts")}
    assert got["write_status"].count() == got["project_fields"].count() == orders
    kinds = {(r.op, r.status) for r in got["write_status"].select("op", "status").distinct().collect()}
    assert kinds == {("insert", "OK"), ("insert", "ALREADY_EXISTS"), ("update", "OK"), ("update", "NOT_FOUND"), ("delete", "OK"), ("delete", "FAILED_PRECONDITION"), ("upsert", "OK"), ("upsert", "CONFLICT")}
    assert {r.current_version for r in got["occ_conflicts"].collect()} == {None, 3, 4, 5}
