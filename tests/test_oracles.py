"""Every registered query of the library against its SQL, on whole small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quernstone.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def flat(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([flat(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds.get(k, k) for c, k in got.dtypes} == {c: str(k) for c, k in zip(want.columns, want.types, strict=True)}
    found, wanted = rows_of(got.columns, got.collect()), rows_of(want.columns, want.fetchall())
    assert len(found) == len(wanted)
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0  # their values are held against brute force in the unit tests
