from pyspark.sql import functions as F

from weftline import schemas
from weftline.config import DEFAULT
from weftline.operators import reporting
from weftline.sources import corpus, html, reports, seeds, sinks


def test_seed_files_of_both_shapes(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("categoria,titulo,url,fuente,idioma,selector\nWeb,,https://x.org/a/mi-pagina/,html,es,\nWeb,T,,html,es,\n", encoding="utf-8")
    b.write_text("categoria,fuente,titulo_wikipedia,idioma\nDatos,wikipedia,Base de datos,es\nDatos,wikipedia,,es\n", encoding="utf-8")
    df = seeds.read_seeds(spark, str(a), str(b))
    assert df.count() == 4
    assert sorted(r["problem"] for r in seeds.problems(df).collect()) == ["html without url", "wikipedia without title or /wiki/ address"]
    got = df.select(seeds.readable_title(df).alias("t"), seeds.extractor(df).alias("e")).collect()
    assert {(r["t"], r["e"]) for r in got} == {("mi pagina", "html"), ("T", "html"), ("Base de datos", "wikipedia"), ("", "wikipedia")}
    assert seeds.problems(spark.createDataFrame([(1,)], "x int")).first()["seq"] == -1


def test_wiki_titles(spark):
    df = spark.createDataFrame([("https://es.wikipedia.org/wiki/Aprendizaje_autom%C3%A1tico",), ("https://x.org/a",), ("https://x.org/wiki/C++",)], "url string")
    assert [r[0] for r in df.select(seeds.wiki_title_of_url(F.col("url"))).collect()] == ["Aprendizaje automático", "", "C++"]


def test_pages():
    page = "<body><nav>n</nav><article><h1>T &amp; x</h1><p>uso <code>useState</code> aquí</p><pre>code</pre><ul><li>uno</li></ul></article><div>otro</div></body>"
    assert html.page_text(page) == "== T & x ==\n\nuso useState aquí\nuno"
    assert html.page_text("<div>a</div><div class='content'><p>b</p></div>") == "b"
    assert html.page_text("<div><p>corto</p></div><div><p>mucho más largo</p></div>") == "mucho más largo"
    assert html.page_text("<div id=q><p>z</p></div><article><p>b</p></article>", "#q") == "z"
    assert html.page_text("") == "" and html.page_text("<p>suelto") == "suelto"


def test_collection(spark):
    s = spark.createDataFrame([(1, "Web", "u1", "html"), (2, "Web", "u2", "html"), (3, "Datos", "u3", "wikipedia")], "seq bigint, category string, url string, source string")
    para = "palabra " * 40
    pages = spark.createDataFrame([("u1", f"<article><h2>Uno</h2><p>{para}</p></article>"), ("u3", f"== Dos ==\n{para}")], "url string, content string")
    got = corpus.collect(s, pages).orderBy("seq").collect()
    assert [(r["seq"], r["turn"], r["title"], r["source"]) for r in got] == [(1, 0, "u1 — Uno", "html"), (3, 0, "u3 — Dos", "wikipedia")]


def test_probe_and_fallback(spark):
    es = "este es un texto de la base que se usa para los datos y con la red en el lugar. " * 8
    p = spark.createDataFrame([(1, "a", "t", es), (2, "b", "t", ""), (3, "c", "t", "breve"), (4, "d", "t", "the house of the king is in the city and it was big " * 10)], "seq int, category string, title string, body string")
    assert {r["category"]: r["verdict"] for r in corpus.probe(p).collect()} == {"a": "OK", "b": "SIN CONTENIDO", "c": "MUY POCO (¿SPA?)", "d": "IDIOMA EN"}
    small = spark.createDataFrame([(1, "a")], "doc_id int, category string")
    big = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "doc_id int, category string")
    assert corpus.or_fallback(small, big).count() == 60 and corpus.or_fallback(big, small).count() == 60


def test_store(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/store")
    assert store.read("documentos").count() == 0
    row = lambda i, c: (str(i), "t", c, "es", 10, 20, "html")
    store.replace("documentos", spark.createDataFrame([row(1, "a"), row(2, "a")], schemas.DOCUMENTS))
    store.upsert("documentos", spark.createDataFrame([row(2, "b"), row(3, "b")], schemas.DOCUMENTS))
    store.append("documentos", spark.createDataFrame([row(4, "c")], schemas.DOCUMENTS))
    store.register_views()
    assert spark.sql("SELECT count(*) FROM documentos").first()[0] == 4
    assert [(r["categoria"], r["documentos"]) for r in reports.documents_by_category(store).collect()] == [("b", 2), ("a", 1), ("c", 1)]
    for report in reports.REPORTS.values():
        report(store).collect()


def test_confident_errors_of_a_store(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/store")
    store.replace("documentos", spark.createDataFrame([(str(i), f"t{i}") for i in range(9)], "doc_id string, titulo string"))
    rows = [(str(i), "a", "b", p, hit) for i, (p, hit) in enumerate([(0.9, 0), (0.95, 1), (0.6, 0), (0.61, 0), (0.9, 0), (None, 0), (0.99, None), (0.7, 0), (0.8, 0)])] + [("77", "a", "b", 0.99, 0)]
    store.replace("resultados_clasificacion", spark.createDataFrame(rows, "doc_id string, categoria_real string, categoria_pred string, probabilidad double, acierto int"))
    assert [(r["doc_id"], r["titulo"]) for r in reports.confident_errors(store).collect()] == [(i, f"t{i}") for i in "04873"]


def test_versions_manifest_and_logs(spark, tmp_path):
    v = sinks.version_row(spark, DEFAULT, "lexical", "d", "h", 3, {"f1_macro": 0.8}, "2024-01-02T03:04:05")
    assert sinks.version_scores(v).first()["f1"] == 0.8
    sinks.append_jsonl(v, f"{tmp_path}/log")
    sinks.append_jsonl(v, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    m = sinks.manifest(spark, f"{tmp_path}/m")
    assert m.first()["bytes"] == 3 and sinks.to_fetch(m, m).count() == 0
    assert sinks.to_fetch(m, m.withColumn("sha256", F.lit("0"))).count() == 1
    assert sinks.metadata(spark, DEFAULT, {}, {}, {}, "now").count() == 1
    t = sinks.Timings()
    with t.step("[total]"):
        pass
    assert reporting.timing(t.to_df(spark)).first()["calls"] == 1
    a, b = (reporting.dataset_hash(spark.createDataFrame(x, "doc_id int, t string").repartition(3)).first()[0] for x in ([(1, "a"), (2, "b")], [(2, "b"), (1, "a")]))
    assert a == b


def test_reference_without_semicolon():
    from weftline.sources.html import page_text

    assert page_text("<article><h1>a&amp;&amp</h1><p>b &lt; c</p></article>") == "== a&& ==\n\nb < c"


def test_first_pages_come_from_minima(spark):
    rows = [("a", 2, "t2", "x" * 900), ("a", 1, "t1", "corto"), ("b", None, "n", None), ("b", 5, "t5", "y"), (None, 3, "t3", "")]
    pages = spark.createDataFrame(rows, "category string, seq int, title string, body string")
    got = corpus.probe(pages)
    assert sorted((str(r["category"]), r["title"], r["chars"]) for r in got.collect()) == [("None", "t3", 0), ("a", "t1", 5), ("b", "n", None)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
