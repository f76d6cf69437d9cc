"""Registered queries against their SQL, and the pipeline."""

from __future__ import annotations

import glob
import os

import corpus_pipeline
import duckdb
import pytest
from conftest import SF

from veclattice.llm import queries
from veclattice.llm.common import table


def values(frame):
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr([plain(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = (queries.QUERIES | queries.FURTHER)[name](spark, SF).toPandas(), db.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, SF).cache()
        assert docs.columns[: len(columns)] == columns, name
        assert 0 < docs.count() <= before, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert docs.where("copies not in (1, 2)").count() == 0


def test_pipeline_odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", "en", None, None), (3, "some words here", "en", "b", 15), (3, "some words here", "en", "b", 15), (4, "...", "fr", "b", 3), (5, "token=abcdef123456 is secret", "en", "b", 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.where("false")):
        d = start
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF).cache()
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        assert set(texts) <= {3, 5} and "abcdef123456" not in str(texts)
