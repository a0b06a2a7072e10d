"""Repeated rows, keys and files; orders; searches in blocks; terms against a plain count."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.operators import dedup, evaluation, keywords, learning, reporting, retrieval
from weftline.sources import html, seeds, sinks


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "A  b", "a"), (2, "a b", "x"), (2, "c", "x"), (1, "c d", "x"), (None, "c", "n"), (5, None, "x"), (6, None, "y"), (7, "", "z"), (8, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _row string")
    got = sorted(map(str, dedup.exact_dedup(df).collect()))
    want = {}
    for i, t, r in rows:
        key = None if t is None else " ".join(t.lower().split())
        rank = (i is not None, i or 0, f'{{"doc_id":{i},"text":"{t}","_row":"{r}"}}')
        if key not in want or rank < want[key][0]:
            want[key] = rank, (i, t, r)
    assert len(got) == len(want) == 5 and {str(r) for r in got} == {str(spark.createDataFrame([v], df.schema).first()) for _, v in want.values()}
    assert dedup.exact_dedup(df.limit(0)).count() == 0


def test_upsert_keeps_the_last_of_a_key(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    row = "doc_id string, titulo string, turn int"
    store.upsert("documentos", spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1), (None, "n", 1)], row), order="turn")
    assert sorted((r["doc_id"] or "", r["titulo"]) for r in store.read("documentos").collect()) == [("", "n"), ("a", "2"), ("b", "1")]
    store.upsert("documentos", spark.createDataFrame([("a", "x", 9), ("a", "x", 9), ("c", "y", 1)], row))
    assert sorted((r["doc_id"] or "", r["titulo"]) for r in store.read("documentos").collect()) == [("", "n"), ("a", "x"), ("b", "1"), ("c", "y")]


def test_a_batch_that_is_written_twice_counts_once(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a", "k", 1)], "doc_id string, keyword string, rango int")
    assert store.read("keywords_documento").count() == 0
    for batch in ("1", "1", "2", None, None):
        store.append("keywords_documento", rows, batch)
    assert store.read("keywords_documento").count() == 4
    store.replace("keywords_documento", rows)
    store.append("keywords_documento", rows, "1")
    assert store.read("keywords_documento").count() == 2


def test_seeds_of_several_files_have_places_of_their_own(spark, tmp_path):
    for name, text in (("a", "categoria,titulo,url\nA,t1,http://x/1\nA,t2,http://x/2\n"), ("b", "categoria,fuente,titulo_wikipedia\nB,wikipedia,W\n")):
        (tmp_path / name).write_text(text)
    got = seeds.read_seeds(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b").orderBy("seq").collect()
    assert len({r["seq"] for r in got}) == 3 and [r["category"] for r in got] == ["A", "A", "B"] and got[2]["wiki_title"] == "W"


@pytest.mark.parametrize(("n", "queries", "rows"), [(40, 7, 3), (300, 64, 5), (6, 6, 9)])
def test_search_equals_a_plain_search(spark, monkeypatch, n, queries, rows):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 20)
    monkeypatch.setattr(retrieval, "SCORE_BYTES", 16 * 20 * 7)
    rng = np.random.default_rng(n)
    # few directions, so that many similarities are equal
    v = rng.integers(-1, 2, (n, 3)).astype(float)
    v[0] = 0
    items = spark.createDataFrame([(int(i), v[i].tolist()) for i in rng.permutation(n)], "doc_id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", v[i].tolist()) for i in range(min(queries, n))] + [("none", None)], "query_id string, vector array<double>")
    got = {}
    for r in retrieval.search(q, items, rows).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], r["similarity"])
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    assert len(got) == min(queries, n)
    for i in range(min(queries, n)):
        s = np.round(unit @ unit[i], 4) + 0.0
        want = sorted(range(n), key=lambda k: (-s[k], k))[:rows]
        assert [got[f"q{i}"][k + 1] for k in range(len(want))] == [(k, s[k]) for k in want]
    assert retrieval.search(q.limit(0), items, rows).count() == 0 and retrieval.search(q, items.limit(0), rows).count() == 0


def test_centroids_beyond_a_broadcast_are_searched(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, i % 7, rng.normal(size=4).tolist()) for i in range(60)], "doc_id int, label int, vector array<double>")
    centres = retrieval.centroids(items)
    unit = items.withColumn("vector", F.transform("vector", lambda x: x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, y: s + y * y))))
    few = sorted(map(str, retrieval.nearest_centroids(unit, centres).collect()))
    monkeypatch.setattr(retrieval, "CENTRES", 3)
    assert sorted(map(str, retrieval.nearest_centroids(unit, centres).collect())) == few


@pytest.mark.parametrize("most", [10, 60, 100_000])
def test_vocabulary_equals_a_plain_count(spark, most):
    from dataclasses import replace

    rng = random.Random(most)
    docs = [(i, " ".join(rng.choice("sol mar luz rio a1 de que la casa".split()) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    cfg = replace(DEFAULT, tfidf=replace(DEFAULT.tfidf, max_features=most))
    got = {r["term"]: (r["df"], r["idf"]) for r in keywords.vocabulary(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", 1, 3, cfg).collect()}
    total, df = Counter(), Counter()
    for _, t in docs:
        w = t.split()
        grams = Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        total.update(grams)
        df.update(set(grams))
    want = sorted((g for g in total if 2 <= df[g] <= 0.85 * len(docs)), key=lambda g: (-total[g], g))[:most]
    assert set(got) == set(want)
    assert all(got[g][0] == df[g] and math.isclose(got[g][1], math.log((1 + len(docs)) / (1 + df[g])) + 1) for g in want)


def test_sparse_features_hold_the_weights(spark):
    w = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.25), (2, "c", 1.0), (3, "unknown", 1.0)], "doc_id int, term string, weight double")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "term string, index int")
    got = {r["doc_id"]: r["features"] for r in learning.sparse_features(w, vocab).collect()}
    assert set(got) == {1, 2} and got[1].toArray().tolist() == [0.25, 0.5, 0, 0] and got[2].toArray().tolist() == [0, 0, 1, 0]


def test_order_and_dataset_hash(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "o int, v int").repartition(7)
    r = evaluation.in_order(df, "o", "v").first()
    assert (r["n"], r["breaks"], r["ordered"]) == (500, sum(a[1] > b[1] for a, b in zip(rows, rows[1:], strict=False)), False)
    assert evaluation.in_order(df, "o", "o").first()["ordered"] and evaluation.in_order(df.limit(0), "o", "v").first()["n"] == 0
    h = reporting.dataset_hash(df, "o").first()["digest"]
    assert h == reporting.dataset_hash(df.repartition(3).select("v", "o"), "o").first()["digest"] != reporting.dataset_hash(df.withColumn("v", F.lit(None)), "o").first()["digest"]


def test_principal_components_equal_the_eigenvectors(spark):
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(5).normal(size=(80, 4)) @ np.diag([5, 2, 1, 0.1])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").select(array_to_vector("v").alias("features"))
    out, shares = learning.project(df)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(shares, values[::-1][:2] / values.sum())
    got, want = np.array([r["pca"].toArray() for r in out.collect()]), (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want))


def test_the_largest_container_of_nested_ones():
    page = "<div>" * 4000 + "<div><p>uno dos</p></div><div>x</div>" + "</div>" * 4000
    assert html.page_text("<body><div>corto</div><div><div><p>el más largo de todos</p></div></div></body>") == "el más largo de todos"
    tree = html.Tree(True)
    tree.feed("<div> a <b>b c</b><div></div> d</div><div><p>x</p> y </div>")
    size = html.text_lengths(tree.root)
    assert all(size[id(n)] == len(n.text()) for n in tree.root.walk())
    import time

    began = time.perf_counter()
    assert html.page_text(page).startswith("uno dos") and time.perf_counter() - began < 5


def test_large_groups_are_ranked_by_ranges(spark, monkeypatch):
    from weftline import session
    from weftline.operators import sections

    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id int, label string, v int").repartition(6)
    by = lambda: [
        sorted(map(str, f.collect()))
        for f in (sections.round_robin(df, "label", "doc_id"), evaluation.stratified_split(df), evaluation.folds(df), session.ranked(df, "label", -F.col("v"), "doc_id").withColumn("_n", F.col("_n").cast("long")))
    ]
    want = by()
    monkeypatch.setattr(session, "WINDOW_ROWS", 10)
    assert by() == want and session.ranked(df.limit(0), "label", "doc_id").count() == 0


def test_a_batch_retried_after_an_upsert_is_not_doubled(spark, tmp_path):
    from weftline.sources.sinks import Store

    store = Store(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([("a", "x-1")], "doc_id string, keyword string")
    store.append("keywords_documento", one, "run-7")
    store.append("keywords_documento", one, "run-7")
    assert store.read("keywords_documento").count() == 1
    store.upsert("keywords_documento", spark.createDataFrame([("b", "y")], "doc_id string, keyword string"))
    store.append("keywords_documento", one, "run-7")
    assert store.read("keywords_documento").count() == 2
    store.append("keywords_documento", one, "7")
    assert store.read("keywords_documento").count() == 3
