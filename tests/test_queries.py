"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from sparkmat.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE_SQL[name])
    columns, rows = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, rows)
