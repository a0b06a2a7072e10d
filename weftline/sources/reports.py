"""The reports that ship with the store, built from the reporting operators over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reporting
from .sinks import Store

#: Probability from which an error counts as confident; rows of the reports that list the first ones.
CONFIDENT, KEYWORDS, ERRORS, VERSIONS = 0.6, 10, 5, 10


def documents_by_category(store: Store) -> DataFrame:
    """Documents of each category and their mean tokens, largest first."""
    g = reporting.size_and_mean(store.read("documentos"), "categoria", "n_tokens")
    return g.select("categoria", F.col("n").alias("documentos"), F.col("mean").alias("tokens_medios")).orderBy(F.desc("documentos"), "categoria")


def frequent_keywords(store: Store) -> DataFrame:
    top = reporting.frequent_keywords(store.read("keywords_documento"), k=KEYWORDS)
    return top.select("keyword", F.col("documents").alias("documentos"))


def hit_rate_by_category(store: Store) -> DataFrame:
    """Hits of each actual category in per cent, weakest first."""
    h = reporting.hit_rate(store.read("resultados_clasificacion"), "categoria_real", "acierto")
    return h.select("categoria_real", "total", F.col("hits").alias("aciertos"), F.col("pct").alias("pct_acierto")).orderBy("pct_acierto", "categoria_real")


def confident_errors(store: Store) -> DataFrame:
    """Wrong predictions above CONFIDENT with their titles, surest first."""
    r = store.read("resultados_clasificacion")
    titled = reporting.confident_errors(r, store.read("documentos").select("doc_id", "titulo"), "acierto", "probabilidad", "doc_id", CONFIDENT, ERRORS)
    return titled.select("doc_id", "titulo", "categoria_real", "categoria_pred", "probabilidad")


def version_history(store: Store) -> DataFrame:
    """The newest versions, times to the second."""
    newest = store.read("versiones_modelo").withColumn("fecha", F.substring("fecha", 1, 19)).orderBy(F.desc("fecha"), "version").limit(VERSIONS)
    return newest.select("version", "fecha", "tipo_clasificador", "n_documentos", "huella_configuracion")


#: The names that reports go by.
REPORTS = {f.__name__: f for f in (documents_by_category, frequent_keywords, hit_rate_by_category, confident_errors, version_history)}
