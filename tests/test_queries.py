"""Every library query with an oracle against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

from parleylake.plans import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"contam_l3_char5", "contamination_queue", "contam_probe_word8", "contam_l4_edit"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    made = duckdb.connect()
    for table in TABLES:
        made.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return made


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (bool, str)):
        return value
    try:
        return float(f"{float(value):.9g}")
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - SLOW))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[p]) for p in places) for r in want.fetchall()), key=str)


def test_entry_without_llm_names():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
