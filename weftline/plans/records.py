"""Registered queries of stores, sources, validation and explanation, through the operators that users call."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..config import DEFAULT
from ..functions import language, text, vectors
from ..operators import dedup, evaluation, keywords, learning, postings, reporting, retrieval, validation
from ..operators.vector_index import VectorIndex, recall
from ..session import stored, workspace
from ..sources import corpus as collection
from ..sources import reports, seeds, sinks
from .catalog import BODY, CLEAN, FREQUENCY, NON_ALPHA, SCORES, SHINGLES, TFIDF, UPPER, WHITE, class_scores, corpus, lang_sql, query, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared workspace."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


# --- validation --------------------------------------------------------------------------------------------------

# One case of the rules for each remainder of doc_id by 13; the expressions read alike in both dialects.
TITLE = "CASE doc_id % 13 WHEN 1 THEN NULL WHEN 2 THEN '  ' WHEN 3 THEN 'ab' WHEN 4 THEN repeat('t', 301) WHEN 5 THEN concat('T', chr(195), chr(169), ' mal') ELSE concat(source, ' título') END"
BODY_CASE = """CASE doc_id % 13 WHEN 6 THEN NULL WHEN 7 THEN '' WHEN 8 THEN 'muy corto' WHEN 9 THEN repeat('palabra ', 7000) WHEN 10 THEN concat(text, '��')
  WHEN 11 THEN concat('x', chr(1), text) WHEN 12 THEN concat('%%% 123 ', repeat('#$! ', 40)) ELSE text END"""
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


@query(
    f"""WITH r AS (SELECT doc_id, {TITLE} AS title, {BODY_CASE} AS body FROM documents),
    v AS (SELECT doc_id, title, body, {WHITE.format(c=f"regexp_replace(coalesce(title, ''), '{CONTROL}', ' ', 'g')")} AS t, {BODY.format(c="coalesce(body, '')")} AS b FROM r),
    f AS (SELECT doc_id, CASE WHEN title IS NULL OR body IS NULL THEN list_filter([CASE WHEN title IS NULL THEN 'campo_faltante' END, CASE WHEN body IS NULL THEN 'campo_faltante' END], lambda x: x IS NOT NULL)
      WHEN t = '' OR b = '' THEN list_filter([CASE WHEN t = '' THEN 'campo_vacio' END, CASE WHEN b = '' THEN 'campo_vacio' END], lambda x: x IS NOT NULL)
      ELSE list_filter([CASE WHEN regexp_matches(t, '{fixed.MOJIBAKE}') OR contains(t, '�') OR regexp_matches(t, '{CONTROL}') THEN 'texto_corrupto' END,
        CASE WHEN regexp_matches(b, '{fixed.MOJIBAKE}') OR contains(b, '�') OR regexp_matches(b, '{CONTROL}') THEN 'texto_corrupto' END, CASE WHEN length(t) < 3 THEN 'longitud_insuficiente' END,
        CASE WHEN length(t) > 300 THEN 'longitud_excesiva' END, CASE WHEN length(b) < 20 THEN 'longitud_insuficiente' END, CASE WHEN length(b) > 50000 THEN 'longitud_excesiva' END,
        CASE WHEN {NON_ALPHA.format(c='b')} > 0.45 THEN 'contenido_degenerado' END], lambda x: x IS NOT NULL) END AS codes,
      title IS NOT NULL AND body IS NOT NULL AND t <> '' AND b <> '' AND {UPPER.format(c='b')} > 0.8 AS warned FROM v)
    SELECT doc_id, codes[1] AS reason, array_to_string(codes, ',') AS codes, len(codes) = 0 AS valid, warned FROM f"""
)
def validation_battery(spark, d):
    """Every kind of fault, with the list of all errors of a row."""
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{TITLE} AS title", f"{BODY_CASE} AS body")
    v = validation.validate(rows)
    return v.select("doc_id", "reason", F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"), "valid", (F.size("warnings") > 0).alias("warned"))


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 7 IN (1, 2) THEN 'codificacion_invalida' WHEN text IS NULL THEN 'campo_faltante' WHEN {BODY.format(c='text')} = '' THEN 'campo_vacio' END AS fault FROM documents"""
)
def undecodable_bodies(spark, d):
    """Bodies as bytes: some end within a character, some begin with a byte that no character has; the others decode."""
    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    body = F.when(F.col("doc_id") % 7 == 1, F.concat(whole, F.lit(b"\xc3"))).when(F.col("doc_id") % 7 == 2, F.concat(F.lit(b"\xff"), whole)).otherwise(F.encode("text", "UTF-8"))
    v = validation.validate(table(spark, d, "documents").select("doc_id", F.lit("Un título").alias("title"), body.alias("body")))
    told = F.col("reason").isin(fixed.ENCODING, fixed.MISSING, fixed.EMPTY)
    return v.select("doc_id", F.when(told, F.col("reason")).alias("fault"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'campo_faltante' END, CASE WHEN text IS NULL THEN 'campo_faltante' END, CASE WHEN doc_id % 5 <> 0 THEN 'tipo_invalido' END) AS codes FROM documents"""
)
def numbers_as_titles(spark, d):
    """Titles of the wrong type, or missing; every error of the first group of checks is told."""
    title = F.when(F.col("doc_id") % 5 != 0, F.length(F.coalesce("text", F.lit(""))))
    v = validation.validate(table(spark, d, "documents").select("doc_id", title.alias("title"), F.col("text").alias("body")))
    return v.select("doc_id", F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


@query("SELECT doc_id, coalesce(s, '') AS cell FROM (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN NULL WHEN 2 THEN '' ELSE regexp_replace(concat('  ', source, chr(9)), '^\\s+|\\s+$', '', 'g') END AS s FROM documents)")
def safe_cells(spark, d):
    cell = F.when(F.col("doc_id") % 4 == 1, F.lit(None)).when(F.col("doc_id") % 4 == 2, "NaN").otherwise(F.concat(F.lit("  "), F.col("source"), F.lit("\t")))
    return table(spark, d, "documents").select("doc_id", text.safe_cell(cell).alias("cell"))


@query("SELECT doc_id, concat(source, '. ', text) AS analysis, text AS model FROM documents")
def composed_texts(spark, d):
    c = corpus(spark, d)
    return c.select("doc_id", text.analysis_text(F.col("title"), F.col("body")).alias("analysis"), text.model_text(F.col("title"), F.col("body")).alias("model"))


NORMAL = f"""(SELECT doc_id, b, CASE WHEN length(b) = 0 THEN 'campo_vacio' WHEN length(b) < 250 THEN 'longitud_insuficiente' WHEN length(b) > 50000 THEN 'longitud_excesiva'
  WHEN {NON_ALPHA.format(c='b')} > 0.45 THEN 'contenido_degenerado' WHEN l.code <> 'es' THEN 'idioma_no_soportado' END AS reason, l.confidence
  FROM (SELECT doc_id, {CLEAN.format(c='text')} AS b FROM documents) JOIN {lang_sql(CLEAN.format(c='text'))} l USING (doc_id))"""


@query(
    f"""SELECT doc_id, b AS clean_text, confidence AS language_confidence, confidence < 0.7 AS language_doubtful, length(b)::INTEGER AS n_chars,
    len(list_filter(string_split(b, ' '), lambda w: w <> ''))::INTEGER AS n_words, round({NON_ALPHA.format(c='b')}, 4) AS ratio_non_alpha FROM {NORMAL} WHERE reason IS NULL"""
)
def accepted_documents(spark, d):
    good, _ = validation.normalise_corpus(corpus(spark, d))
    return good.select("doc_id", "clean_text", "language_confidence", "language_doubtful", "n_chars", "n_words", "ratio_non_alpha")


@query(f"SELECT doc_id, reason FROM {NORMAL} WHERE reason IS NOT NULL")
def rejected_documents(spark, d):
    return validation.normalise_corpus(corpus(spark, d))[1].select("doc_id", "reason")


# --- deduplication -----------------------------------------------------------------------------------------------

GREEDY = f"""e AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256({WHITE.format(c='lower(text)')})),
  s AS (SELECT doc_id, g, len(g) AS n FROM {SHINGLES} JOIN e USING (doc_id)), x AS (SELECT doc_id, n, unnest(g) AS gram FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND least(a.n, b.n) > 0.6 * greatest(a.n, b.n) GROUP BY ALL),
  l AS (SELECT a, list(b) AS near FROM p WHERE common::DOUBLE / (na + nb - common) > 0.6 GROUP BY 1),
  o AS (SELECT a, near, row_number() OVER (ORDER BY length(text) DESC, a) AS r FROM l JOIN documents ON doc_id = a),
  k AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT o.r, CASE WHEN list_has_any(o.near, k.kept) THEN k.kept ELSE list_append(k.kept, o.a) END FROM k JOIN o ON o.r = k.r + 1),
  gone AS (SELECT a FROM o WHERE NOT list_contains((SELECT kept FROM k ORDER BY r DESC LIMIT 1), a))"""


@query(f"WITH RECURSIVE {GREEDY} SELECT doc_id FROM e WHERE doc_id NOT IN (SELECT a FROM gone)")
def near_dup_survivors(spark, d):
    return dedup.deduplicate(table(spark, d, "documents").select("doc_id", "text"))[0].select("doc_id")


@query(
    f"""WITH RECURSIVE {GREEDY} SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) - (SELECT count(*) FROM e) AS exact_removed,
    (SELECT count(*) FROM gone) AS near_removed, (SELECT count(*) FROM e) - (SELECT count(*) FROM gone) AS kept"""
)
def dedup_report(spark, d):
    return dedup.deduplicate(table(spark, d, "documents").select("doc_id", "text"))[1]


# --- seeds and collection ------------------------------------------------------------------------------------------


def seed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as seeds: a third by title, a third by address, the others of no named source."""
    m = F.col("doc_id") % 3
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("category"), F.when(m == 0, "wikipedia").when(m == 1, "WIKIPEDIA").alias("source"), F.when(m == 0, F.concat("source", F.lit(" libre"))).alias("wiki_title"),
        F.concat(F.lit("https://es.ejemplo.org/wiki/P%C3%A1gina_"), F.col("doc_id").cast("string")).alias("url"), "text",
    )


@query(
    """SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 2 THEN 'html' ELSE 'wikipedia' END AS extractor, CASE WHEN doc_id % 3 = 0 THEN source || ' libre' ELSE 'Página ' || doc_id END AS wiki_title,
    CASE WHEN doc_id % 3 = 0 THEN source || ' libre' ELSE 'P%C3%A1gina ' || doc_id END AS title, 'es.ejemplo.org' AS host FROM documents"""
)
def seed_routes(spark, d):
    s = seed_rows(spark, d).drop("text")
    routed = collection.seeds_with_routes(s)
    return routed.select("seq", "extractor", seeds.wiki_title(routed).alias("wiki_title"), F.col("readable").alias("title"), "host")


@query(
    r"""WITH s AS (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn FROM documents WHERE doc_id % 3 < 2),
    l AS (SELECT doc_id, source, lang, turn, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM (SELECT doc_id, source, lang, turn, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM (SELECT doc_id, source, lang, turn, string_split(text, chr(10)) AS a FROM s))),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l WHERE length(x) >= 250 AND x NOT LIKE '==%')
    SELECT doc_id AS seq, turn::INTEGER AS turn, part::INTEGER AS part, CASE WHEN doc_id % 3 = 0 THEN source || ' libre' ELSE 'P%C3%A1gina ' || doc_id END AS title, x AS body, lang AS category, 'wikipedia' AS source FROM k WHERE part <= 6"""
)
def collected_corpus(spark, d):
    s = seed_rows(spark, d).filter("source IS NOT NULL")
    return collection.collect(s.drop("text"), s.select("url", F.col("text").alias("content"))).select("seq", "turn", "part", "title", "body", "category", "source")


@query(
    f"""SELECT lang AS category, source AS title, n AS chars, CASE WHEN n = 0 THEN 'SIN CONTENIDO' WHEN n < 400 THEN 'MUY POCO (¿SPA?)' WHEN code <> 'es' THEN 'IDIOMA ' || upper(code) ELSE 'OK' END AS verdict
    FROM (SELECT lang, source, length(text)::INTEGER AS n, l.code, row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) AS r FROM documents d JOIN {lang_sql('text')} l ON l.doc_id = d.doc_id) WHERE r = 1"""
)
def seed_probe(spark, d):
    return collection.probe(corpus(spark, d), "category", "doc_id")


@query("SELECT doc_id, lang AS category FROM documents WHERE doc_id % 2 = 0")
def fallback_corpus(spark, d):
    """Spanish documents alone are not fit for training, so the fallback, here every other document, is taken."""
    c = corpus(spark, d).select("doc_id", "category")
    return collection.or_fallback(c.filter("category = 'es'"), c.filter("doc_id % 2 = 0"))


@query("SELECT lang AS category, source AS title, NULL::VARCHAR AS wiki_title FROM documents UNION ALL SELECT lang, NULL, source FROM documents")
def seed_files(spark, d):
    """Both shapes of seed files, written and read as one table; places are unique."""
    docs, root = table(spark, d, "documents"), folder(spark, "seeds")
    sinks.write_csv(docs.select(F.col("lang").alias("categoria"), F.col("source").alias("titulo"), F.concat(F.lit("https://e.org/"), F.col("doc_id").cast("string")).alias("url")), f"{root}/a")
    sinks.write_csv(docs.select(F.col("lang").alias("categoria"), F.lit("wikipedia").alias("fuente"), F.col("source").alias("titulo_wikipedia")), f"{root}/b")
    read = seeds.read_seeds(spark, f"{root}/a", f"{root}/b")
    return read.groupBy("seq").agg(F.max("category").alias("category"), F.max("title").alias("title"), F.max("wiki_title").alias("wiki_title")).drop("seq")


# --- stores ------------------------------------------------------------------------------------------------------


def filled_store(spark: SparkSession, d: str) -> sinks.Store:
    """The six tables from the corpus: documents, frequent words as keywords, label by source as predictions."""
    store, docs = sinks.Store(spark, folder(spark, "store")), table(spark, d, "documents")
    store.replace("documentos", docs.select("doc_id", F.col("source").alias("titulo"), F.col("lang").alias("categoria"), F.size(text.words(F.col("text"))).alias("n_tokens"), "n_chars"))
    store.replace("keywords_documento", keywords.frequency_keywords(corpus(spark, d)).select("doc_id", "keyword", F.col("rank").alias("rango")))
    labelled = docs.join(table(spark, d, "labels"), "doc_id")
    store.replace("resultados_clasificacion", labelled.select("doc_id", F.col("lang").alias("categoria_real"), F.col("source").alias("categoria_pred"), ((F.col("doc_id") % 100) / 100).alias("probabilidad"), F.col("quality").alias("acierto")))
    return store


@query(
    f"""SELECT lang AS categoria, count(*) AS documentos, round(sum(len(list_filter(string_split({WHITE.format(c='text')}, ' '), lambda w: w <> '')))::DOUBLE / count(*), 1) AS tokens_medios
    FROM documents GROUP BY lang"""
)
def report_documents_by_category(spark, d):
    return reports.documents_by_category(filled_store(spark, d))


@query(f"SELECT keyword, documentos FROM (SELECT keyword, count(*) AS documentos, row_number() OVER (ORDER BY count(*) DESC, keyword) AS place FROM {FREQUENCY} GROUP BY keyword) WHERE place <= 10")
def report_frequent_keywords(spark, d):
    return reports.frequent_keywords(filled_store(spark, d))


@query(
    """SELECT lang AS categoria_real, count(*) AS total, (count(*) FILTER (quality = 1))::BIGINT AS aciertos, round(100 * (count(*) FILTER (quality = 1))::DOUBLE / count(*), 1) AS pct_acierto
    FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def report_hit_rate(spark, d):
    return reports.hit_rate_by_category(filled_store(spark, d))


@query(
    """SELECT doc_id::VARCHAR AS doc_id, source AS titulo, lang AS categoria_real, source AS categoria_pred, (doc_id % 100)::DOUBLE / 100 AS probabilidad FROM labels JOIN documents USING (doc_id)
    WHERE quality = 0 AND doc_id % 100 > 60 QUALIFY row_number() OVER (ORDER BY doc_id % 100 DESC, doc_id::VARCHAR) <= 5"""
)
def report_confident_errors(spark, d):
    return reports.confident_errors(filled_store(spark, d))


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new 2' ELSE source END AS titulo FROM documents UNION ALL SELECT '-1', 'b'")
def store_upsert(spark, d):
    """Rows of labelled documents replace theirs, the last of two each; a new one is added, others stay."""
    store, docs = sinks.Store(spark, folder(spark, "store")), table(spark, d, "documents")
    store.upsert("documentos", docs.select(F.col("doc_id").cast("string"), F.col("source").alias("titulo")))
    new = table(spark, d, "labels").select(F.col("doc_id").cast("string")).distinct().crossJoin(spark.createDataFrame([("new 1", 1), ("new 2", 2)], "titulo string, turn int"))
    store.upsert("documentos", new.unionByName(spark.createDataFrame([("-1", "b", 9), ("-1", "z", 3)], "doc_id string, titulo string, turn int")), order="turn")
    return store.read("documentos").select("doc_id", "titulo")


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS fecha, event_type AS titulo, 'c' || event_id % 3 AS categoria, value AS probabilidad, (value < 0.25)::INTEGER AS confianza_baja, 'es' AS idioma, 'a, b' AS keywords, value * 2 AS latencia_ms, '1.0' AS version_modelo
    FROM events WHERE event_type <> 'error'"""
)
def prediction_log(spark, d):
    """Responses through the audit log: those with an error are left out; a batch that is written twice counts once."""
    e = table(spark, d, "events")
    r = e.select(
        F.when(F.col("event_type") == "error", "longitud_excesiva").alias("error"), F.col("event_type").alias("title"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("category"), F.col("value").alias("probability"),
        (F.col("value") < DEFAULT.classification.low_confidence).alias("low_confidence"), F.struct(F.lit("es").alias("code")).alias("language"), F.array(F.lit("a"), F.lit("b")).alias("keywords"), "ts", "value",
    )
    store = sinks.Store(spark, folder(spark, "store"))
    for _ in range(2):
        store.append("predicciones_api", sinks.audit_rows(r, F.date_format("ts", "yyyy-MM-dd"), F.col("value") * 2, DEFAULT.version), batch="one")
    return store.read("predicciones_api").drop("id")


VERSIONS = "(SELECT 'v' || (event_id % 12) AS version, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS fecha, count(*) AS n, round(avg(value), 6) AS f1 FROM events GROUP BY 1)"


def filled_versions(spark: SparkSession, d: str) -> sinks.Store:
    """The log of model versions, appended in two batches."""
    e = table(spark, d, "events").groupBy(F.concat(F.lit("v"), (F.col("event_id") % 12).cast("string")).alias("version")).agg(F.max("ts").alias("ts"), F.count("*").alias("n_documentos"), F.round(F.avg("value"), 6).alias("f1"))
    rows = e.select("version", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("fecha"), F.lit("lr").alias("tipo_clasificador"), "n_documentos", F.lit("h").alias("huella_configuracion"), F.to_json(F.struct(F.col("f1").alias("f1_macro"))).alias("metricas_json"))
    store = sinks.Store(spark, folder(spark, "store"))
    for k, part in enumerate((rows.filter("version < 'v5'"), rows.filter("version >= 'v5'"))):
        store.append("versiones_modelo", part, batch=str(k))
    return store


@query(f"SELECT version, fecha, 'lr' AS tipo_clasificador, n AS n_documentos, 'h' AS huella_configuracion FROM {VERSIONS} ORDER BY fecha DESC, version LIMIT 10")
def version_history(spark, d):
    return reports.version_history(filled_versions(spark, d))


@query(f"SELECT version, fecha, f1 FROM {VERSIONS}")
def version_scores(spark, d):
    return sinks.version_scores(filled_versions(spark, d).read("versiones_modelo"))


@query("SELECT doc_id::VARCHAR AS doc_id, source, n_chars::VARCHAR AS n_chars FROM documents")
def csv_round_trip(spark, d):
    path = folder(spark, "csv")
    sinks.write_csv(table(spark, d, "documents").select("doc_id", "source", "n_chars"), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT doc_id, text, source FROM documents UNION ALL SELECT doc_id, text, 'again' FROM documents WHERE doc_id % 10 = 0")
def jsonl_round_trip(spark, d):
    path, docs = folder(spark, "jsonl"), table(spark, d, "documents").select("doc_id", "text", "source")
    sinks.append_jsonl(docs, path)
    sinks.append_jsonl(docs.filter("doc_id % 10 = 0").withColumn("source", F.lit("again")), path)
    return spark.read.schema("doc_id bigint, text string, source string").json(path)


@query("SELECT vec_id AS doc_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, 'c' || label AS category, NULL::VARCHAR AS topic FROM embeddings")
def vector_load(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"))
    loaded = sinks.load_vectors(e, folder(spark, "vectors"))
    return loaded.select("doc_id", F.round(F.aggregate(vectors.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"), "category", "topic")


@query("SELECT 'f' || doc_id AS path, n_chars AS bytes, md5(text) AS sha256 FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def files_to_fetch(spark, d):
    """A listing that lacks every fifth file and has other sizes of every seventh."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("bytes"), F.md5("text").alias("sha256"))
    have = docs.filter("doc_id % 5 <> 0").withColumn("bytes", F.when(F.col("doc_id") % 7 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return sinks.to_fetch(docs.drop("doc_id"), have)


@query(
    """WITH r AS (SELECT doc_id, sha256(concat_ws(';', 'doc_id=' || length(doc_id::VARCHAR) || ':' || doc_id, 'lang=' || octet_length(encode(lang)) || ':' || lang, 'n_chars=' || length(n_chars::VARCHAR) || ':' || n_chars,
      'source=' || octet_length(encode(source)) || ':' || source, 'text=' || octet_length(encode(text)) || ':' || text)) AS h, ('0x' || substr(md5(doc_id::VARCHAR), 1, 3))::INT AS b FROM documents),
    p AS (SELECT b, sha256(string_agg(h, '' ORDER BY doc_id, h)) AS h FROM r GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY b)) AS digest FROM p"""
)
def dataset_hash(spark, d):
    return reporting.dataset_hash(table(spark, d, "documents"))


# --- orders, shares, terms ---------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, count(*) FILTER (b) AS breaks, count(*) FILTER (b) = 0 AS ordered FROM (SELECT lag(value) OVER (ORDER BY event_id, value) > value AS b FROM events)")
def ordering_check(spark, d):
    return evaluation.in_order(table(spark, d, "events"), "event_id", "value")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def customers_without_orders(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def _present(term: str) -> str:
    """SQL: whether a text has a term between characters that are no part of words."""
    literal = "".join("\\" + c if c in ".+#/-" else c for c in term).replace("'", "''")
    return rf"CASE WHEN regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_]){literal}($|[^\p{{L}}\p{{N}}_])') THEN '{term}' END"


@query("SELECT doc_id, list_sort(list_filter([" + ", ".join(_present(t) for t in fixed.TECHNOLOGIES) + "], lambda x: x IS NOT NULL)) AS entities FROM documents")
def entities(spark, d):
    return corpus(spark, d).select("doc_id", keywords.entities(F.col("body")).alias("entities"))


@query(
    f"""{TFIDF}, best AS (SELECT doc_id, rank, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 10) DESC, term) AS rank FROM x) WHERE rank <= 5)
    SELECT coalesce(b.doc_id, f.doc_id) AS doc_id, coalesce(b.rank, f.rank)::INTEGER AS rank, b.term AS lexical, f.keyword AS frequent FROM best b FULL JOIN {FREQUENCY} f ON f.doc_id = b.doc_id AND f.rank = b.rank"""
)
def keyword_comparison(spark, d):
    lexical = keywords.tfidf_keywords(keywords.tfidf_lists(table(spark, d, "documents")), k=5)
    frequent = keywords.frequency_keywords(corpus(spark, d)).withColumnRenamed("keyword", "term")
    return keywords.compare_keywords("doc_id", lexical=lexical, frequent=frequent)


@query("SELECT lang AS category, string_agg(keyword, ', ' ORDER BY keyword) AS joined FROM (SELECT DISTINCT lang, source AS keyword FROM documents) GROUP BY 1")
def joined_lists(spark, d):
    k = table(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.array_sort(F.collect_set("source")).alias("k"))
    return k.select("category", F.array_join("k", ", ").alias("joined"))


# --- explanation and prediction ----------------------------------------------------------------------------------


@query(
    """SELECT doc_id, term, without AS text FROM (SELECT doc_id, term, text, regexp_replace(text, '(?i)' || term, ' ', 'g') AS without
      FROM (SELECT doc_id, text, unnest(['the', 'de', 'que', 'und', 'ausente', 'en']) AS term FROM documents)) WHERE trim(without) <> trim(text)"""
)
def ablated_texts(spark, d):
    terms = F.array(*[F.lit(x) for x in ("the", "de", "que", "und", "ausente", "en", "unseen seventh")])
    return learning.ablation_inputs(table(spark, d, "documents").select("doc_id", "text", terms.alias("keywords")))


@query(
    f"""WITH b AS (SELECT doc_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM {SCORES}) WHERE r = 1),
    c AS (SELECT b.doc_id, t.term, round(b.score - abs(b.score - t.k * (b.doc_id % 3) / 10.0), 4) AS contribution FROM b, (VALUES ('uno', 1), ('dos', 2), ('tres', -3)) t(term, k))
    SELECT doc_id, term, contribution, CASE WHEN contribution > 0 THEN 'for' ELSE 'against' END AS sign, row_number() OVER (PARTITION BY doc_id, contribution > 0 ORDER BY abs(contribution) DESC, term)::INTEGER AS rank FROM c WHERE contribution <> 0"""
)
def term_contributions(spark, d):
    s = class_scores(spark, d)
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "label"))).filter("r = 1").select("doc_id", "label", "score")
    terms = spark.createDataFrame([("uno", 1), ("dos", 2), ("tres", -3)], "term string, k int")
    without = best.crossJoin(terms).select("doc_id", "term", "label", F.abs(F.col("score") - F.col("k") * (F.col("doc_id") % 3) / 10.0).alias("score"))
    return learning.ablation(best, without)


@query(
    f"""SELECT query_id, doc_id, rank::INTEGER AS rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM (
    SELECT q.vec_id AS query_id, i.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(i.embedding::DOUBLE[], i.embedding::DOUBLE[])), 4) AS similarity
    FROM embeddings q, embeddings i WHERE i.vec_id <> q.vec_id)) WHERE rank <= {DEFAULT.vectors.related}"""
)
def related(spark, d):
    return retrieval.related(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")))


@query(
    f"""SELECT d.doc_id, CASE WHEN length(b) = 0 THEN 'campo_vacio' WHEN length(b) < 20 THEN 'longitud_insuficiente' WHEN length(b) > 50000 THEN 'longitud_excesiva' WHEN {NON_ALPHA.format(c='b')} > 0.45 THEN 'contenido_degenerado'
      WHEN l.code <> 'es' THEN 'idioma_no_soportado' END AS error, source AS title FROM (SELECT doc_id, source, {BODY.format(c='text')} AS b FROM documents) d JOIN {lang_sql('text')} l ON l.doc_id = d.doc_id"""
)
def prediction_errors(spark, d):
    """The rows of a batch prediction: which are refused, why, and what is kept of them."""
    from ..operators.predict import Analyzer

    docs = table(spark, d, "documents")
    labelled = docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    got = Analyzer.fit(labelled).predict(corpus(spark, d))
    # a category, three best at most and keywords belong to rows without an error, and to them alone
    ok = (F.col("error").isNull() == F.col("category").isNotNull()) & (F.size(F.coalesce(F.map_keys("distribution"), F.array())) <= DEFAULT.service.top_categories)
    return got.select("doc_id", F.when(ok, F.col("error")).otherwise("inconsistent").alias("error"), "title")


@query()
def language_id(spark, d):
    """Fitted on four fifths of the documents by hash, judged on the others."""
    from ..operators.language_id import LanguageId

    docs = table(spark, d, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return LanguageId.fit(docs.filter(~held)).detect(docs.filter(held)).groupBy("lang", "language").agg(F.count("*").alias("n"))


# --- fitted models: rows only, as iterations are not SQL; tests hold them against plain evaluations ----------------------


def folded(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with their label, dealt into folds."""
    from .catalog import vectors_of

    v = vectors_of(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label"), "features")
    return evaluation.folds(evaluation.encode_labels(v), "label", "doc_id")


def names_of(df: DataFrame) -> list[str]:
    return [r[0] for r in df.select("label").distinct().orderBy("label").collect()]  # one row a class


@query()
def cross_validation(spark, d):
    f = folded(spark, d).cache()
    scores = learning.cross_validate(f, names_of(f))
    return spark.createDataFrame(list(enumerate(scores)), "fold int, f1_macro double")


@query()
def calibration(spark, d):
    """Brier scores before and after sigmoids that were fitted on the other folds' predictions, and whether they are adopted."""
    f = folded(spark, d).cache()
    held = learning.out_of_fold(f, names_of(f)).cache()
    after = learning.calibrated(held, learning.calibrate(held))
    before, then = (evaluation.brier(x).first()["brier"] for x in (held, after))
    return spark.createDataFrame([(before, then, learning.adopt_calibration(held, after))], "before double, after double, adopted boolean")


@query()
def drift(spark, d):
    """Whether the score on the test split is further from the folds' than chance explains."""
    f = folded(spark, d).cache()
    names = names_of(f)
    split = evaluation.stratified_split(f, "label")
    test = split.filter("split = 'test'").select("doc_id", F.col("label").alias("actual"), "features")
    s = learning.scores(learning.train(split.filter("split = 'train'")), test, names)
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "label"))).filter("r = 1")
    found = evaluation.metrics(best.select("actual", F.col("label").alias("predicted"))).first()["f1_macro"]
    alert = evaluation.drift_alert(found, learning.cross_validate(f, names), test.count())
    return spark.createDataFrame([(float(alert["gap"]), float(alert["limit"]), bool(alert["alert"]))], "gap double, limit double, alert boolean")


@query()
def diverse_keywords(spark, d):
    """Maximal marginal relevance over each document's terms of most weight, by hashed vectors."""
    weights = keywords.tfidf_lists(table(spark, d, "documents"))
    documents = retrieval.embed(weights, dimension=64)
    top = keywords.tfidf_keywords(weights, k=3 * DEFAULT.keywords.candidates)
    terms = top.select("term").distinct().select(F.col("term").alias("doc_id"), "term", F.lit(1.0).alias("weight"))
    candidates = top.join(retrieval.embed(terms, dimension=64).withColumnRenamed("doc_id", "term"), "term").select("doc_id", "term", "vector")
    return keywords.semantic_keywords(candidates, documents).withColumn("score", F.round("score", 9))


@query()
def class_terms(spark, d):
    """The terms that speak most for each class of the lexical classifier."""
    from ..operators.predict import Analyzer

    labelled = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    a = Analyzer.fit(labelled, vectors=False)
    return learning.global_explanation(a.model, a.vocab, a.labels).withColumn("coefficient", F.round("coefficient", 6))


@query("SELECT count(*) AS queries, 5 * count(*) AS links, true AS enough FROM embeddings")
def vector_index(spark, d):
    """Every vector's five nearest others by the index, and whether nine tenths of the exact ones, asked for by every 20th id, are among them."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    found = stored(VectorIndex.fit(e).related(5), "index-found")
    asked = e.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = retrieval.search(asked, e, 6).filter("query_id <> doc_id").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("r <= 5")
    share = recall(found, exact)
    return found.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("links"), F.lit(share >= 0.9).alias("enough"))


@query()
def responses(spark, d):
    """The whole response to every document, by an engine that was saved and loaded."""
    from ..operators.predict import Analyzer

    docs = table(spark, d, "documents")
    labelled = docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    path = f"{workspace(spark)}/engine-{uuid.uuid4().hex}"
    Analyzer.fit(labelled).fit_topics().save(path)
    got = Analyzer.load(spark, path).respond(corpus(spark, d).withColumn("external_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x-"), F.col("doc_id")))))
    return got.select("doc_id", "response_id", "category", "probability", F.array_join("keywords", ", ").alias("keywords"), "topic.id", "topic.label", F.to_json("explanation").alias("explanation"), F.to_json("related").alias("related"), "error")


# --- postings ----------------------------------------------------------------------------------------------------

PAIRS = f"(SELECT DISTINCT lower(keyword) AS term, doc_id AS id FROM {FREQUENCY})"


@query(
    f"""SELECT term, block, first, last, n::INTEGER AS n, list_transform(ids, lambda x: x - first) AS offsets FROM (
      SELECT term, block, min(id) AS first, max(id) AS last, count(*) AS n, list_sort(list(id)) AS ids FROM (
        SELECT term, id, CASE WHEN count(*) OVER (PARTITION BY term) > 256 THEN id // 256 ELSE 0 END AS block FROM {PAIRS}) GROUP BY term, block)"""
)
def posting_blocks(spark, d):
    return postings.blocks(keywords.frequency_keywords(corpus(spark, d))).drop("part")


@query(
    f"""WITH p AS {PAIRS}, q AS (SELECT lang, a.item AS a, b.item AS b FROM (
        SELECT lang, term AS item, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r FROM p JOIN documents ON id = doc_id GROUP BY lang, term) a
      JOIN (SELECT lang, term AS item, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r FROM p JOIN documents ON id = doc_id GROUP BY lang, term) b USING (lang)
      WHERE a.r < b.r AND b.r <= 12)
    SELECT q.lang || ':' || q.a || ':' || q.b AS query, x.id FROM q JOIN p x ON x.term = q.a JOIN p y ON y.term = q.b AND y.id = x.id"""
)
def posting_intersections(spark, d):
    """Documents that have both of two keywords, for all pairs of each language's twelve most frequent ones, through a saved index."""
    k = stored(keywords.frequency_keywords(corpus(spark, d)).select("doc_id", F.lower("keyword").alias("keyword")).distinct(), "posting-pairs")
    path = folder(spark, "postings")
    postings.save(postings.blocks(k), path)
    n = k.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL").groupBy("lang", "keyword").count()
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "keyword"))).filter("r <= 12").select("lang", "r", "keyword")
    b = top.select("lang", F.col("r").alias("r2"), F.col("keyword").alias("b"))
    pairs = top.join(b, "lang").filter("r < r2").withColumn("query", F.concat_ws(":", "lang", "keyword", "b"))
    queries = pairs.select("query", F.explode(F.array("keyword", "b")).alias("term"))
    return postings.intersect(postings.load(spark, path), queries)
