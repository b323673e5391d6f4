"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from matchloom import plans


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return int(value) if isinstance(value, float) and value == int(value) else value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in records)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, folder, duck, name):
    df = plans.QUERIES[name](spark, folder)
    rel = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
