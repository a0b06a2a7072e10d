import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the supplied tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.sql(catalog.ORACLES[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert ours == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"predict_batch", "fused_keywords", "kmeans_sweep", "responses"}))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_embeddings_are_whole_vectors(spark):
    rows = catalog.QUERIES["text_embeddings"](spark, DIR).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], {})[r["i"]] = r["x"]
    assert all(abs(sum(x * x for x in v.values()) - 1) < 1e-3 for v in by.values()) and max(max(v) for v in by.values()) > 350


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
