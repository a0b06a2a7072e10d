"""Schemas of the tables that the engine reads and writes."""

SEEDS = "category STRING, title STRING, url STRING, source STRING, language STRING, selector STRING, wiki_title STRING"
DOCUMENTS = "doc_id STRING, titulo STRING, categoria STRING, idioma STRING, n_tokens INT, n_chars INT, fuente STRING"
DOC_KEYWORDS = "doc_id STRING, keyword STRING, rango INT"
CLUSTERING = "doc_id STRING, cluster_kmeans INT, topico_bertopic INT, etiqueta_topico STRING"
CLASSIFICATION = "doc_id STRING, categoria_real STRING, categoria_pred STRING, probabilidad DOUBLE, acierto INT, particion STRING, modelo STRING"
PREDICTION_LOG = (
    "id BIGINT, fecha STRING, titulo STRING, categoria STRING, probabilidad DOUBLE, confianza_baja INT, idioma STRING, keywords STRING, "
    "latencia_ms DOUBLE, version_modelo STRING"
)
MODEL_VERSIONS = (
    "version STRING, fecha STRING, huella_configuracion STRING, tipo_clasificador STRING, dataset STRING, hash_dataset STRING, n_documentos BIGINT, "
    "parametros_json STRING, metricas_json STRING"
)
TABLES = {
    "documentos": DOCUMENTS, "keywords_documento": DOC_KEYWORDS, "resultados_clustering": CLUSTERING,
    "resultados_clasificacion": CLASSIFICATION, "predicciones_api": PREDICTION_LOG, "versiones_modelo": MODEL_VERSIONS,
}
