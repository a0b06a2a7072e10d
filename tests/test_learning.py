import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.operators import evaluation, latent, learning, reporting, retrieval
from weftline.operators.language_id import LanguageId, Registry
from weftline.operators.predict import Analyzer


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = {"Backend": "servidor api java spring petición".split(), "DevOps": "docker kubernetes despliegue contenedor tubería".split(), "Datos": "modelo pandas tabla entrenamiento numpy".split()}
    filler = "el la de que en los para con una por se del las un es".split()
    rows = []
    for i in range(60):
        label = list(words)[i % 3]
        rows.append((i, " ".join(rng.choice(words[label]) if rng.random() < 0.5 else rng.choice(filler) for _ in range(40)) + ".", label))
    return spark.createDataFrame(rows, "doc_id int, text string, label string").cache()


@pytest.fixture(scope="module")
def analyzer(docs):
    return Analyzer.fit(docs)


def test_predict_batch_isolates_bad_rows(spark, analyzer):
    good = "El servidor de la api en java con spring que responde la petición para los usuarios con una api por el servidor."
    rows = [(1, "Servicio", good), (2, None, good), (3, "Título", "corto"), (4, "English", "This is the text of the server and it was with the data that is in the house on the hill.")]
    got = {r["doc_id"]: r for r in analyzer.predict(spark.createDataFrame(rows, "doc_id int, title string, body string"), 2).collect()}
    assert got[1]["category"] == "Backend" and got[1]["error"] is None and len(got[1]["keywords"]) <= 2 and sum(got[1]["distribution"].values()) == pytest.approx(1, abs=0.01)
    assert [got[i]["error"] for i in (2, 3, 4)] == ["campo_faltante", "longitud_insuficiente", "idioma_no_soportado"] and got[2]["category"] is None


def test_explanation(spark, analyzer):
    df = spark.createDataFrame([(1, "docker y kubernetes en el despliegue de contenedor docker", ["docker", "ausente"])], "doc_id int, text string, keywords array<string>")
    terms, near = analyzer.explain(df)
    r = terms.first()
    assert r["term"] == "docker" and r["sign"] == "for" and r["contribution"] > 0
    assert near.orderBy("rank").first()["label"] == "DevOps"
    assert {r["category"] for r in analyzer.related(df.select("doc_id", "text")).collect()} == {"DevOps"}
    assert analyzer.health()["categories"] == ["Backend", "Datos", "DevOps"]


def test_whole_response_before_and_after_reload(spark, docs, analyzer, tmp_path):
    analyzer.fit_topics(least=8, samples=3)
    good = "El servidor de la api en java con spring que responde la petición para los usuarios con una api por el servidor."
    rows = [(1, "Servicio", good, "abc-123"), (2, "Servicio", good, None), (3, "Título", "corto", "x"), (4, "Contenedores", "El despliegue de docker en kubernetes con el contenedor para la tubería de los que se despliegan una por una.", None)]
    df = spark.createDataFrame(rows, "doc_id int, title string, body string, external_id string")
    got = {r["doc_id"]: r for r in analyzer.respond(df).collect()}
    assert got[1]["response_id"] == "abc-123" and got[2]["response_id"] == got[2]["short_id"] and got[3]["error"] == "longitud_insuficiente"
    assert [x["category"] for x in got[1]["related"]] == ["Backend"] * 3 and [x["similarity"] for x in got[1]["related"]] == sorted((x["similarity"] for x in got[1]["related"]), reverse=True)
    assert got[1]["explanation"]["centroids"][0]["label"] == "Backend" and got[4]["explanation"]["centroids"][0]["label"] == "DevOps"
    assert got[3]["explanation"] is None and got[3]["related"] is None and got[3]["topic"] is None
    signs = [t["sign"] for t in got[1]["explanation"]["terms"]]
    assert signs == sorted(signs, key=lambda s: s != "for")
    topics = {r["topic"]: r["label"] for r in analyzer.topic_labels.collect()}
    assert len([t for t in topics if t >= 0]) == 3 and got[1]["topic"]["id"] >= 0 and got[1]["topic"]["label"] == topics[got[1]["topic"]["id"]] != got[4]["topic"]["label"]
    own = {r["query_id"]: r["topic"] for r in analyzer.topics.assign(analyzer.items.withColumnRenamed("doc_id", "query_id")).collect()}
    assert own == {r["id"]: r["topic"] for r in analyzer.topics.labels.collect()}
    analyzer.save(f"file://{tmp_path}/engine")
    again = Analyzer.load(spark, f"file://{tmp_path}/engine")
    assert again.cfg == analyzer.cfg and again.health() == analyzer.health()
    assert {r["doc_id"]: r for r in again.respond(df).collect()} == got
    analyzer.topics = analyzer.topic_labels = None
    plain = {r["doc_id"]: r for r in analyzer.respond(df, explain=False, related=False).collect()}
    assert plain[1]["topic"]["id"] == -1 and plain[1]["explanation"] is None and plain[1]["related"] is None


def test_learned_vectors_against_an_exact_decomposition(spark):
    rng = np.random.default_rng(5)
    a = (rng.random((150, 70)) < 0.15) * rng.random((150, 70)) + np.outer(np.arange(150) % 3 == 0, np.arange(70) < 20) * 0.5 + np.outer(np.arange(150) % 3 == 1, np.arange(70) > 50) * 0.4
    w = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "doc_id bigint, index int, weight double").repartition(4)
    rows = latent.weight_rows(w).cache()
    v, s = latent.factorise(rows, 70, 12)
    exact = np.linalg.svd(a, compute_uv=False)[:12]
    assert np.abs(s / exact - 1).max() < 0.01 and np.abs(v.T @ v - np.eye(12)).max() < 1e-6
    got = {r["doc_id"]: np.array(r["vector"]) for r in latent.project(rows, v).collect()}
    for i in got:
        want = a[i] @ v
        assert np.abs(got[i] - want / np.linalg.norm(want)).max() < 1e-9
    full, all_values = latent.factorise(rows, 70, 384)
    assert full.shape[1] <= 70 and np.abs(all_values[:5] / np.linalg.svd(a, compute_uv=False)[:5] - 1).max() < 1e-6
    assert latent.factorise(rows.limit(0), 70, 5)[0].shape[1] == 0

    def plain(doc, k, diversity, candidates):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = {int(j): round(float(unit[j] @ got[doc]), 10) for j in sorted(np.flatnonzero(a[doc]), key=lambda j: (-a[doc, j], j))[:candidates]}
        picked = []
        while near and len(picked) < k:
            worth = {j: round((1 - diversity) * x - diversity * max(float(unit[j] @ unit[p]) for p in picked), 10) if picked else x for j, x in near.items()}
            j = min(worth, key=lambda j: (-worth[j], j))
            picked.append(j)
            del near[j]
        return picked

    found = {}
    for r in latent.key_terms(rows, v, 6, 0.5, 9).orderBy("rank").collect():
        found.setdefault(r["doc_id"], []).append(r["index"])
    assert all(found[i] == plain(i, 6, 0.5, 9) for i in list(got)[:40])


def test_learned_neighbours_share_labels_oftener_than_hashed_ones(docs, analyzer):
    words = analyzer._weights(docs.withColumn("text", F.regexp_replace("text", "[.]", "")), analyzer.vocab, DEFAULT)
    label = {r["doc_id"]: r["label"] for r in docs.collect()}
    share = lambda df: np.mean([label[r["query_id"]] == label[r["doc_id"]] for r in retrieval.related(df, n=5).collect()])
    learned, hashed = share(latent.project(latent.weight_rows(words), analyzer.terms[:, :8])), share(retrieval.embed(words))
    assert learned >= hashed and learned > 0.9


def test_calibration_and_folds(spark, docs, analyzer):
    feats = Analyzer._features(docs, analyzer.vocab, DEFAULT)
    cfg = replace(DEFAULT, classification=replace(DEFAULT.classification, folds=2))
    df = evaluation.folds(evaluation.encode_labels(docs, "label").join(feats, "doc_id"), "label", "doc_id", cfg).cache()
    assert all(s > 0.8 for s in learning.cross_validate(df, analyzer.labels, cfg))
    held = learning.out_of_fold(df, analyzer.labels, cfg).cache()
    after = learning.calibrated(held, learning.calibrate(held))
    assert after.groupBy("doc_id").agg(F.sum("score").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-6).count() == 0
    assert learning.adopt_calibration(held, after) in (True, False)
    assert learning.select_model(0.5, 0.5) == "semantic" and learning.select_model(0.6, 0.5) == "lexical"
    assert learning.global_explanation(analyzer.model, analyzer.vocab, analyzer.labels, 3).count() == 9


def test_clusters_topics_and_projection(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(5 * (i % 3), 0.3), rng.gauss(-4 * (i % 3), 0.3), rng.gauss(0, 0.1), 0.0, 1.0, rng.gauss(0, 0.1)]) for i in range(90)]
    v = spark.createDataFrame(rows, "doc_id int, x array<double>").withColumn("features", array_to_vector("x")).cache()
    cfg = replace(DEFAULT, clustering=replace(DEFAULT.clustering, k_max=4, n_init=5))
    assert learning.kmeans_sweep(v, cfg=cfg)[1] == 3
    _, shares = learning.project(v)
    assert shares[0] > 0.9
    empty = learning.kmeans_sweep(v.limit(2))
    assert empty[0].count() == 0 and empty[1] == 0
    t = learning.cluster(v, 3).drop("features").join(learning.topics(v).select("doc_id", "topic"), "doc_id")
    assert reporting.rescue_outliers(t).filter("topic_final = -1").count() <= t.filter("topic = -1").count()


def test_search(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], "ab"[i % 2], f"t{i}", "texto") for i in range(60)]
    e = spark.createDataFrame(rows, "doc_id int, vector array<double>, category string, title string, text string")
    q = e.filter("doc_id = 3").select(F.col("doc_id").alias("query_id"), "vector")
    got = retrieval.search(q, e, 4).orderBy("rank").collect()
    assert got[0]["similarity"] == 1.0 and [r["rank"] for r in got] == [1, 2, 3, 4]
    assert {r["category"] for r in retrieval.semantic_search(q, e, 3, "b").collect()} == {"b"}
    assert retrieval.related(e, [3], 3).filter("query_id = doc_id").count() == 0
    with pytest.raises(ValueError):
        retrieval.related(e, [1000])
    assert retrieval.search(q.limit(0), e).count() == 0


def test_measures(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "actual string, predicted string")
    r = {x["label"]: x for x in evaluation.class_report(df).collect()}
    assert r["c"]["f1"] == 0 and r["b"]["precision"] == pytest.approx(1 / 3) and r["a"]["recall"] == 0.5
    assert evaluation.metrics(df).first()["accuracy"] == 0.5
    assert evaluation.confused_pairs(df).first()["actual"] == "c"
    same = spark.createDataFrame([(i % 3, (i % 3) + 5) for i in range(9)], "a int, b int")
    assert evaluation.clustering_agreement(same).first()["ari"] == pytest.approx(1) and evaluation.clustering_agreement(same).first()["nmi"] == pytest.approx(1)
    s = spark.createDataFrame([(1, "a", "a", 0.6), (1, "a", "b", 0.4)], "doc_id int, actual string, label string, score double")
    assert evaluation.top_k_accuracy(s, 2).first()["top_k"] is None
    assert evaluation.drift_alert(0.5, [0.8, 0.8], 100)["alert"]


def test_language_id_and_registry(spark):
    es, en = "el perro de la casa come en el campo", "the dog of the house eats in the field"
    df = spark.createDataFrame([(es, "es"), (en, "en")] * 5, "text string, lang string")
    model = LanguageId.fit(df)
    rows = model.detect(spark.createDataFrame([("la casa del campo",), ("the house in the field",), ("12",), (None,)], "text string")).collect()
    assert [r["language"] for r in rows] == ["es", "en", "und", "und"] and rows[2]["language_method"] == "stop_words"
    r = Registry()
    assert "de" in r.get("es") and r.loaded == ["es"]
    with pytest.raises(ValueError):
        r.get("xx")


def test_the_sweep_fits_every_seed_of_every_k(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    from weftline.plans import catalog

    rng = random.Random(7)
    rows = [(i, [4.0 * (i % 10 % 4) + rng.gauss(0, 0.2), 5.0 * (i % 10 // 4) + rng.gauss(0, 0.2)]) for i in range(200)]
    v = spark.createDataFrame(rows, "doc_id int, x array<double>").withColumn("features", array_to_vector("x")).cache()
    table, best = learning.kmeans_sweep(v)
    got = {r["k"]: r for r in table.collect()}
    assert sorted(got) == list(range(2, 17)) and best == 10
    m = KMeans(k=10, seed=1, initSteps=9).fit(v)
    assert got[10]["inertia"] <= m.summary.trainingCost * 1.000001
    if m.summary.trainingCost < got[10]["inertia"] * 1.000001:
        assert got[10]["silhouette"] == pytest.approx(ClusteringEvaluator().evaluate(m.transform(v)), abs=1e-6)
    assert [r["k"] for r in catalog.QUERIES["kmeans_sweep"](spark, "/root/testdata/sf0.001").orderBy("k").collect()] == list(range(2, 17))


def test_training_has_the_configured_iterations(spark):
    v = spark.createDataFrame([(i % 2, [float(i), 1.0]) for i in range(20)], "label_index int, x array<double>").withColumn("features", array_to_vector("x"))
    assert learning.train(v).getMaxIter() == DEFAULT.classification.max_iter == 2000


def test_fit_cleans_texts_once(spark, monkeypatch):
    from weftline.operators import keywords
    from weftline.operators.predict import Analyzer

    class Seen(Exception):
        pass

    def vocabulary(df, *_):
        raise Seen("regexp_replace" in df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(keywords, "vocabulary", vocabulary)
    with pytest.raises(Seen, match="False"):
        Analyzer.fit(spark.createDataFrame([(1, "<b>uno</b> dos", "a"), (2, "tres", "b")], "doc_id bigint, text string, label string"))


def test_sums_of_tasks_are_added_before_the_driver(spark, monkeypatch):
    x = spark.range(64).repartition(8).selectExpr("array(double(id), 1D) AS x", "id AS h")
    seen, collect = [], type(x).collect
    monkeypatch.setattr(type(x), "collect", lambda df: seen.append(collect(df)) or seen[-1])
    got = learning._added(x, lambda b, h: [b.sum(0), np.array([len(h)])])
    assert [len(r) for r in seen] == [2] and got[0].tolist() == [2016.0, 64.0] and got[1].tolist() == [64]


def test_search_holds_ids_not_vectors():
    import io
    import tracemalloc

    import pyarrow as pa

    rng, sink = np.random.default_rng(1), io.BytesIO()
    kind = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))])
    with pa.ipc.new_stream(sink, kind) as w:
        for k in range(20):
            v = pa.ListArray.from_arrays(pa.array(np.arange(501) * 256, pa.int32()), pa.array(rng.normal(size=500 * 256)))
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(np.arange(500) + 500 * k), v], schema=kind))
    del v
    sink.seek(0)
    held = []

    def batches():
        for b in pa.ipc.open_stream(sink):
            held.append(tracemalloc.get_traced_memory()[0])
            yield b

    q = rng.normal(size=(4, 256))
    tracemalloc.start()
    got = pa.Table.from_batches(list(retrieval._best(pa.array([1, 2, 3, 4]), q / np.linalg.norm(q, axis=1, keepdims=True), 3, ["q", "id", "s"])(batches())))
    tracemalloc.stop()
    assert got.num_rows == 12
    # a batch is about 1 MB; twenty of them would be 20
    assert max(held) < 5 << 20, held


def test_text_without_a_known_term_has_a_category(spark, analyzer):
    body = "Zxq lo que wvk como las hjp entre los brt y porque qqz esta vvk pero sus mmx para una zzk por la del ttx."
    df = spark.createDataFrame([(1, "Zxq", body), (2, "Zxq", "corto")], "doc_id int, title string, body string")
    none = spark.createDataFrame([(1, "zxq wvk"), (2, None)], "doc_id int, text string")
    assert [list(r["i"]) for r in analyzer._rows(none, analyzer.vocab, DEFAULT).collect()] == [[], []] and not analyzer.vectors(none).count()
    assert {r["doc_id"] for r in analyzer.scores(none).collect()} == {1, 2}
    bare = Analyzer(analyzer.vocab.withColumn("term", F.concat("term", F.lit("0"))), analyzer.model, analyzer.labels, analyzer.centres, analyzer.terms, analyzer.items, DEFAULT)
    got = {r["doc_id"]: r for r in bare.predict(df).collect()}
    assert got[1]["error"] is None and got[1]["category"] in analyzer.labels and got[2]["category"] is None


def test_known_weights_move_no_rows_and_agree_with_plain_counts(spark):
    from weftline.operators import keywords

    vocab = spark.createDataFrame([("aa", 0, 1.5), ("aa bb", 1, 2.0), ("cc dd ee", 2, 3.0), ("dd ee ff", 3, 1.0), ("ff", 4, 0.5)], "term string, index int, idf double")
    texts = ["aa bb aa bb, cc dd ee ff", "bb cc", "", None, "Cc dd EE aa"]
    rows = keywords.known_weights(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", "text", 1, 3, vocab)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    tf = [{0: 2, 1: 2, 2: 1, 3: 1, 4: 1}, {}, {}, {}, {0: 1, 2: 1}]
    idf = [1.5, 2.0, 3.0, 1.0, 0.5]
    for r in rows.collect():
        want = {i: (1 + np.log(n)) * idf[i] for i, n in tf[r["doc_id"]].items()}
        assert r["i"] == sorted(want) and np.allclose(r["x"], np.array([want[i] for i in sorted(want)]) / np.linalg.norm(list(want.values())))


def test_classifier_alone_is_that_of_the_whole_fit(docs, analyzer):
    alone = Analyzer.fit(docs, vectors=False)
    assert alone.items is None and alone.labels == analyzer.labels
    assert sorted(map(tuple, alone.vocab.collect())) == sorted(map(tuple, analyzer.vocab.collect()))
    assert np.allclose(alone.model.coefficientMatrix.toArray(), analyzer.model.coefficientMatrix.toArray())
