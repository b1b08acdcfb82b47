"""Every registered query of the engine against its DuckDB counterpart."""

import math

import duckdb
import pytest

from quire.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    frame = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = [[r[c] for c in columns] for r in frame.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert rows_of(found) == rows_of([[r[names.index(c)] for c in columns] for r in rel.fetchall()])
