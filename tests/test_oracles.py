"""Every query with an oracle, compared row by row on the small tables."""

import math
import os

import duckdb
import pytest

from streetloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.7g}")
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    frame = catalog.queries()[name](spark, SF)
    result = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(norm(r[c]) for c in order) for r in frame.collect()), key=repr)
    want = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert got == want


def test_every_query_builds_and_has_rows(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        frame = catalog.queries()[name](spark, SF)
        assert frame.columns, name
        frame.limit(3).collect()
