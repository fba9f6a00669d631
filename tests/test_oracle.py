"""Every query that has SQL, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from condist.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 8) + 0.0
    return value


def kind(name):
    return {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}.get(str(name), str(name))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert {c: t for c, t in df.dtypes} == {c: kind(t) for c, t in zip(want.columns, want.types, strict=True)}
    key = lambda row: tuple(("" if v is None else str(type(v)), str(v)) for v in row)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    ref = sorted((tuple(plain(v) for v in row) for row in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    assert len(ref) > 0
    assert got == ref
