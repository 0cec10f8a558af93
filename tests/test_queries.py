"""Queries with a twin give the same rows as the twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillpair.plans.queries import ORACLE_SQL


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "-"
        if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "item") and not isinstance(v, (str, bool)) and type(v).__name__ != "bool":
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(small_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, small_dir, duck, name):
    got, want = entry.queries()[name](spark, small_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 650
