"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillspark.plans import catalogue, structure  # noqa: F401  both register queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def canonical(rows, columns):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    expected = duck.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(expected.fetchall(), columns)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)
