"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest
from conftest import SF

from veclattice.plans import catalogue


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def values(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v.item() if hasattr(v, "item") else v

    return sorted(repr([plain(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.SQL:
        assert len(got)
        return
    want = db.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
