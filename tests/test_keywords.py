import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.operators import keywords, reporting, retrieval


def test_frequency_keywords(spark):
    df = spark.createDataFrame([(1, "Spring para APIs", "Spring con Java y spring con Docker C# C++ para las APIs")], "doc_id int, title string, body string")
    got = [(r["rank"], r["keyword"], r["n"]) for r in keywords.frequency_keywords(df).orderBy("rank").collect()]
    assert got[:2] == [(1, "Spring", 4), (2, "APIs", 3)] and len(got) <= 5 and "para" not in {k for _, k, _ in got}


def test_tfidf_matches_the_formula(spark):
    docs = {1: "gato perro gato", 2: "perro pez", 3: "gato pez pez", 4: "otro"}
    cfg = replace(DEFAULT, tfidf=replace(DEFAULT.tfidf, ngram_max=1))
    w = {(r["doc_id"], r["term"]): r["weight"] for r in keywords.tfidf(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), cfg=cfg).collect()}
    idf = math.log(5 / 3) + 1
    a, b = (1 + math.log(2)) * idf, idf
    assert w[1, "gato"] == pytest.approx(a / math.hypot(a, b)) and (4, "otro") not in w


def test_fusion_and_overlap(spark):
    rows = [(1, "semantic", 1, "Spring Boot"), (1, "local", 1, "boot"), (1, "entities", 1, "Spring Boot"), (1, "entities", 2, "x"), (1, "local", 2, "servidor"), (1, "semantic", 2, "presentando")]
    s = spark.createDataFrame(rows, "doc_id int, signal string, rank int, term string")
    f = {r["term"]: r["score"] for r in keywords.fuse(s).collect()}
    assert f["spring boot"] == pytest.approx(1 / 61 + 2.5 / 61) and "x" not in f
    got = keywords.select_keywords(keywords.fuse(s), s.filter("signal = 'entities'").select("doc_id", "term")).first()["keywords"]
    assert got == ["Spring Boot", "servidor"]
    assert keywords.select_keywords(keywords.fuse(s), k=1).first()["keywords"] == ["Spring Boot"]


def test_entities(spark):
    df = spark.createDataFrame([("Usa Spring Boot, Java y API REST; no Javanés. ASP.NET C++",), (None,)], "t string")
    got = [r[0] for r in df.select(keywords.entities(F.col("t"))).collect()]
    assert got == [["API REST", "ASP.NET", "C++", "Java", "Spring Boot"], []]


def test_dictionary_extension(spark):
    old, new = (spark.createDataFrame([(t,) for t in x], "term string") for x in (["a", "b"], ["b", "c", "c"]))
    assert sorted(r[0] for r in keywords.extend_dictionary(old, new).collect()) == ["a", "b", "c"]


def test_preprocess_and_phrases(spark):
    p = keywords.preprocess(spark.createDataFrame([("Los sistemas distribuidos usan bases de datos 2024 rápidamente",)], "clean_text string")).first()
    assert "bases" in p["tokens"] and "los" not in p["tokens"] and "2024" not in p["tokens"] and p["n_tokens"] == len(p["tokens"]) and "rápidamente" not in p["lemmas_pos"]
    df = spark.createDataFrame([("base datos",), ("rápidamente",), ("de base",)], "t string")
    assert [r[0] for r in df.select(keywords.valid_phrase(F.col("t"))).collect()] == [True, False, False]


def test_local_and_semantic_keywords(spark):
    df = spark.createDataFrame([(1, "El servidor web atiende. El servidor web responde siempre. La memoria falla."), (2, "")], "doc_id int, text string")
    got = keywords.local_keywords(df).orderBy("rank").collect()
    assert got and all(r["doc_id"] == 1 for r in got) and any("servidor" in r["term"] for r in got)
    cand = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.99, 0.1]), (1, "c", [0.0, 1.0])], "doc_id int, term string, vector array<double>")
    doc = spark.createDataFrame([(1, [1.0, 0.2])], "doc_id int, vector array<double>")
    order = [r["term"] for r in keywords.semantic_keywords(cand, doc).orderBy("rank").collect()]
    assert order == ["b", "c", "a"]


def test_keywords_are_chosen_from_all_candidates(spark):
    near = [f"alfabetizacion{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    far = "roble cumbre violín pizarra jungla mezquita fósforo tigre hueco nube desván kilo".split()
    df = spark.createDataFrame([(1, ". ".join(near + far) + ".")], "doc_id int, text string")
    assert [r["rank"] for r in keywords.local_keywords(df).orderBy("rank").collect()] == list(range(1, 11))
    cand = spark.createDataFrame([*[(1, f"a{i}", [1.0, i / 1000]) for i in range(60)], (1, "z", [0.0, 1.0])], "doc_id int, term string, vector array<double>")
    doc = spark.createDataFrame([(1, [1.0, 0.2])], "doc_id int, vector array<double>")
    assert "z" in [r["term"] for r in keywords.semantic_keywords(cand, doc).filter("rank <= 2").collect()]


def test_index_and_comparison(spark):
    k = spark.createDataFrame([(2, "Java"), (1, "java"), (1, "go")], "doc_id int, keyword string")
    assert {r["term"]: r["ids"] for r in reporting.inverted_index(k).collect()} == {"java": [1, 2], "go": [1]}
    a, b = (spark.createDataFrame(x, "doc_id int, rank int, term string") for x in ([(1, 1, "x"), (1, 2, "y")], [(1, 1, "z")]))
    rows = keywords.compare_keywords("doc_id", one=a, two=b).orderBy("rank").collect()
    assert [(r["one"], r["two"]) for r in rows] == [("x", "z"), ("y", None)]


def test_diverse_keywords_equal_a_plain_choice(spark):
    import numpy as np

    from weftline.config import DEFAULT

    rng, lam = np.random.default_rng(6), DEFAULT.keywords.diversity
    docs = {i: rng.normal(size=4) for i in range(6)}
    cand = {i: {f"t{k}": rng.normal(size=4) for k in range(int(rng.integers(1, 25)))} for i in docs}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    got = keywords.semantic_keywords(
        spark.createDataFrame([(i, t, v.tolist()) for i, c in cand.items() for t, v in c.items()], "doc_id int, term string, vector array<double>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in docs.items()], "doc_id int, vector array<double>"),
    ).collect()
    for i, c in cand.items():
        picked = []
        while len(picked) < min(DEFAULT.keywords.candidates, len(c)):
            worth = lambda t: (1 - lam) * cos(c[t], docs[i]) - lam * max((cos(c[t], c[p]) for p in picked), default=0.0)  # noqa: B023, E731
            picked.append(max((t for t in c if t not in picked), key=worth))
        rows = sorted((r["rank"], r["term"], r["score"]) for r in got if r["doc_id"] == i)
        assert [t for _, t, _ in rows] == picked and all(abs(s - cos(c[t], docs[i])) < 1e-9 for _, t, s in rows)


def test_local_keywords_shuffle_nothing_and_keep_to_their_rows(spark):
    rows = [(1, "Apache Spark runs jobs. Spark runs jobs fast!"), (2, None), (None, "Apache Spark"), (3, "the of and")]
    got = keywords.local_keywords(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"] for r in got.collect()} == {1}


def test_distances_equal_plain_ones():
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abñ ") for _ in range(rng.randint(1, 70))) for _ in range(2))
        assert keywords._distance(a, b) == plain(a, b)


def test_diverse_keywords_leave_no_interpreted_choice_in_the_plan(spark):
    cand = spark.createDataFrame([(1, "b", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (1, "z", [0.0, 0.0])], "doc_id int, term string, vector array<double>")
    got = keywords.semantic_keywords(cand, spark.createDataFrame([(1, [1.0, 0.0])], "doc_id int, vector array<double>"))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["term"], r["score"]) for r in got.orderBy("rank").collect()] == [("a", 1.0), ("z", 0.0), ("b", 1.0)]


def test_terms_of_a_document_are_counted_where_it_lies(spark):
    rows = [(1, "Sol mar sol. El mar", "a"), (2, None, None), (3, "mar sol luz mar sol", "b"), (None, "sol mar", "c")]
    df = spark.createDataFrame(rows, "doc_id int, body string, title string")
    lists = keywords.tfidf_lists(df, "doc_id", "body")
    for got in (keywords.frequency_keywords(df), keywords.tfidf_keywords(lists), retrieval.embed(lists)):
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"] for r in lists.collect()} == {1, 3, None}


def test_rows_that_share_a_key_are_one_document(spark):
    df = spark.createDataFrame([(1, "luna dos", "", "x"), (1, "tres Luna dos", "", "y"), (2, "luna dos tres", "", "z"), (None, "cinco", "", "x"), (None, "cinco seis", "", "x")], "doc_id int, body string, title string, t string")
    got = [(r["doc_id"], r["rank"], r["keyword"].lower(), r["n"]) for r in keywords.frequency_keywords(df).collect()]
    assert sorted(x[1:] for x in got if x[0] == 1) == [(1, "luna", 2), (2, "dos", 2), (3, "tres", 1)]
    assert sorted(x[1:] for x in got if x[0] is None) == [(1, "cinco", 2), (2, "seis", 1)]
    cfg = replace(DEFAULT, tfidf=replace(DEFAULT.tfidf, min_df=1, max_df=1.0))
    terms = {(r["doc_id"], r["term"]) for r in keywords.tfidf(df.drop("t"), text_col="body", cfg=cfg).collect()}
    assert (1, "dos tres") not in terms and (1, "tres luna") in terms and (2, "dos tres") in terms and (None, "cinco cinco") not in terms
    v = {r["term"]: r["df"] for r in keywords.vocabulary(df, "doc_id", "body", 1, 3, cfg).collect()}
    assert v["luna"] == 2 and v["luna dos"] == 2 and v["cinco"] == 1


def test_terms_beyond_what_tasks_are_sent_are_joined(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("sol mar luz rio a1 de que la casa".split()) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    few = sorted((r["doc_id"], r["term"], round(r["weight"], 9)) for r in keywords.tfidf(df).collect())
    for most in (3, 20):  # words, then phrases
        monkeypatch.setattr(keywords, "BROADCAST_ROWS", most)
        assert sorted((r["doc_id"], r["term"], round(r["weight"], 9)) for r in keywords.tfidf(df).collect()) == few
