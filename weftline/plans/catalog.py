"""The registered queries of the engine's own operators, with their SQL.

documents stands for the corpus (source is the title, text the body, lang the category), labels for the supervised
target, embeddings for the vector store, events for logs, conversations for ordered sections, pages for fetched
pages; the star schema carries relational shapes at volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..config import DEFAULT
from ..functions import language, text, vectors
from ..operators import dedup, evaluation, keywords, learning, reporting, retrieval, sections, validation
from ..session import spread, stored
from ..sources import html, seeds, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Columns that are INT here and BIGINT as DuckDB counts them, or wider.
NARROW = {
    "validation_codes": "n_chars", "canonical_hashes": "n_words", "shingle_stats": "n", "section_carry": "place", "section_split": "part", "round_robin": "turn", "top_tokens": "rank",
    "keyword_frequency": "rank", "tfidf_keywords": "rank", "knn": "rank", "related": "rank", "centroids": "i", "nearest_centroid": "rank", "label_encoding": "label_index", "filtered_search": "rank",
}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            narrow = NARROW.get(f.__name__)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({narrow}::INTEGER AS {narrow}) FROM ({sql.strip()})" if narrow else sql.strip()
        return f

    return add


def sql_query(name: str, sql: str) -> None:
    """A report that is the same SQL text here and in the oracle, over views of the tables it names."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in TABLES:
            if t in sql:
                table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    QUERIES[name], ORACLES[name] = run, sql.strip()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"), F.col("lang").alias("category"))


# --- SQL fragments of the oracle ---------------------------------------------------------------------------------

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  coalesce({c}, ''), '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '(?i)\[\d+\]|\[cita requerida\]|\[nota \d+\]', ' ', 'g'), '\([^)]{{0,3}}\)', ' ', 'g'),
  '[^\p{{L}}\p{{N}}_\s.,;:+#/-]', ' ', 'g'), '\s+', ' ', 'g'), '^ ', ''))"""
WHITE = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
NON_ALPHA = r"(CASE WHEN length({c}) = 0 THEN 1.0 ELSE 1 - length(regexp_replace({c}, '[^\p{{L}}\s]', '', 'g'))::DOUBLE / length({c}) END)"
UPPER = r"(CASE WHEN length(regexp_replace({c}, '[^\p{{L}}]', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace({c}, '[^\p{{Lu}}]', '', 'g'))::DOUBLE / length(regexp_replace({c}, '[^\p{{L}}]', '', 'g')) END)"
BODY = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
LANG = """(SELECT doc_id, n, es, en, CASE WHEN n < 5 OR greatest(es, en) / greatest(n, 1) <= 0.05 THEN 'und' WHEN en > es THEN 'en' ELSE 'es' END AS code,
  CASE WHEN n < 5 OR es + en = 0 THEN 0.0 ELSE round((greatest(es, en)::DOUBLE / n) / (es::DOUBLE / n + en::DOUBLE / n), 4) END AS confidence
FROM (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda w: list_contains([{es}], w))) AS es, len(list_filter(t, lambda w: list_contains([{en}], w))) AS en
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce({c}, '')), '[a-záéíóúüñ]+') AS t FROM documents)))"""


def lang_sql(c: str) -> str:
    q = {k: ", ".join(f"'{w}'" for w in v) for k, v in fixed.LANGUAGE_WORDS.items()}
    return LANG.format(c=c, **q)


# --- text and validation -----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {CLEAN.format(c='text')} AS clean FROM documents")
def clean_text(spark, d):
    return corpus(spark, d).select("doc_id", text.clean(F.col("body")).alias("clean"))


@query(
    f"""SELECT doc_id, CASE WHEN length(b) = 0 THEN 'campo_vacio' WHEN length(b) < 250 THEN 'longitud_insuficiente' WHEN length(b) > 50000 THEN 'longitud_excesiva'
    WHEN {NON_ALPHA.format(c='b')} > 0.45 THEN 'contenido_degenerado' END AS reason, length(b) AS n_chars, round({NON_ALPHA.format(c='b')}, 4) AS non_alpha, round({UPPER.format(c='b')}, 4) AS upper,
    length(b) > 0 AND {UPPER.format(c='b')} > 0.8 AS warned
    FROM (SELECT doc_id, {BODY.format(c='text')} AS b FROM documents)"""
)
def validation_codes(spark, d):
    v = validation.validate(corpus(spark, d), mode="corpus")
    return v.select("doc_id", "reason", F.length("v_body").alias("n_chars"), F.col("metrics.non_alpha"), F.col("metrics.upper"), (F.size("warnings") > 0).alias("warned"))


@query(
    f"""SELECT coalesce(reason, 'accepted') AS status, code AS language, count(*) AS n FROM (
      SELECT doc_id, CASE WHEN length(b) = 0 THEN 'campo_vacio' WHEN length(b) < 250 THEN 'longitud_insuficiente' WHEN length(b) > 50000 THEN 'longitud_excesiva'
      WHEN {NON_ALPHA.format(c='b')} > 0.45 THEN 'contenido_degenerado' END AS reason FROM (SELECT doc_id, {CLEAN.format(c='text')} AS b FROM documents)) v
    JOIN {lang_sql(CLEAN.format(c='text'))} l USING (doc_id) GROUP BY 1, 2"""
)
def validation_summary(spark, d):
    c = corpus(spark, d).withColumn("body", text.clean(F.col("body")))
    v = validation.validate(c, mode="corpus").select(F.coalesce("reason", F.lit("accepted")).alias("status"), language.detect(F.col("v_body"))["code"].alias("language"))
    return reporting.value_counts(v, "status", "language")


@query(f"SELECT doc_id, {NON_ALPHA.format(c='text')} AS ratio FROM documents")
def non_alpha_ratio(spark, d):
    return corpus(spark, d).select("doc_id", validation.non_alpha_ratio(F.col("body")).alias("ratio"))


@query(f"SELECT doc_id, code, confidence FROM {lang_sql('text')}")
def language_heuristic(spark, d):
    return corpus(spark, d).select("doc_id", language.detect(F.col("body")).alias("l")).select("doc_id", "l.code", "l.confidence")


@query(f"""SELECT code, (code = 'es') AS supported, count(*) AS n FROM {lang_sql('text')} GROUP BY ALL""")
def language_gate(spark, d):
    code = language.detect(F.col("body"))["code"]
    return corpus(spark, d).select(code.alias("code")).select("code", language.supported(F.col("code")).alias("supported")).groupBy("code", "supported").agg(F.count("*").alias("n"))


@query(
    f"""SELECT doc_id, sha256({WHITE.format(c='lower(text)')}) AS hash, substr(sha1(text), 1, 16) AS short_id, len(list_filter(string_split({WHITE.format(c='text')}, ' '), lambda w: w <> '')) AS n_words FROM documents"""
)
def canonical_hashes(spark, d):
    return corpus(spark, d).select("doc_id", text.canonical_hash(F.col("body")).alias("hash"), text.short_id(F.col("body")).alias("short_id"), F.size(text.words(F.col("body"))).alias("n_words"))


# --- deduplication -----------------------------------------------------------------------------------------------


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256({WHITE.format(c='lower(text)')})")
def exact_dedup(spark, d):
    return dedup.exact_dedup(table(spark, d, "documents")).select("doc_id")


SHINGLES = f"""(SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM (SELECT doc_id, list_filter(string_split({WHITE.format(c='lower(text)')}, ' '), lambda x: x <> '') AS w FROM documents))"""


@query(f"SELECT doc_id, len(g) AS n FROM {SHINGLES}")
def shingle_stats(spark, d):
    return dedup.hashed_shingles(table(spark, d, "documents"), "doc_id", "text", 3).select(F.col("id").alias("doc_id"), F.size("grams").alias("n"))


@query(
    f"""WITH e AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256({WHITE.format(c='lower(text)')})),
    s AS (SELECT doc_id, g, len(g) AS n FROM {SHINGLES} JOIN e USING (doc_id)),
    x AS (SELECT doc_id, n, unnest(g) AS gram FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id < b.doc_id
          AND least(a.n, b.n) > 0.6 * greatest(a.n, b.n) GROUP BY ALL)
    SELECT a, b, round(common::DOUBLE / (na + nb - common), 6) AS similarity FROM p WHERE common::DOUBLE / (na + nb - common) > 0.6"""
)
def near_dup_pairs(spark, d):
    exact = stored(dedup.exact_dedup(table(spark, d, "documents")).select("doc_id", "text"), "exact")
    return dedup.near_pairs(exact).withColumn("similarity", F.round("similarity", 6))


@query("SELECT doc_id, printf('DOC-%04d', row_number() OVER (ORDER BY length(text) DESC, doc_id)) AS seq_id FROM documents")
def sequential_ids(spark, d):
    return dedup.with_sequential_ids(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "seq_id")


# --- sources and sections ----------------------------------------------------------------------------------------


@query(
    """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section,
    row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS place FROM conversations"""
)
def section_carry(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations")
    return c.select(
        "conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("section"),
        (F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1).alias("place"),
    )


@query(
    r"""WITH l AS (SELECT doc_id, source, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM (SELECT doc_id, source, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents))),
    k AS (SELECT doc_id, source, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l WHERE length(x) >= 250 AND x NOT LIKE '==%')
    SELECT doc_id, part, source AS title, x AS body FROM k WHERE part <= 6"""
)
def section_split(spark, d):
    return sections.split_sections(corpus(spark, d), "title", "body", "doc_id")


@query("SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY doc_id) - 1 AS turn FROM (SELECT doc_id, lang AS category FROM documents)")
def round_robin(spark, d):
    return sections.round_robin(corpus(spark, d).select("doc_id", "category"), "category", "doc_id")


@query("SELECT category, min(doc_id) AS doc_id FROM (SELECT doc_id, lang AS category FROM documents) GROUP BY 1")
def first_per_group(spark, d):
    return sections.round_robin(corpus(spark, d).select("doc_id", "category"), "category", "doc_id").filter("turn = 0").select("category", "doc_id")


@query(
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, translate(list_last(string_split(rtrim(url, '/'), '/')), '-_', '  ') AS title FROM pages"""
)
def url_title(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return p.select("page_id", seeds.host(F.col("url")).alias("host"), seeds.readable_title(p).alias("title"))


MARKUP = """replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""


# a paragraph that is left open holds what follows it in the article as well, so its text has that too
@query(
    rf"""WITH b AS (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS raw
      FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<(?:h1|p)>.*?(?:</h1>|</p>|<br>)') AS a FROM pages)),
    t AS (SELECT page_id, i, raw, trim({MARKUP}, concat(' ', chr(10), chr(9), chr(13))) AS t FROM b), l AS (SELECT page_id, list(t ORDER BY i) AS ts FROM t GROUP BY 1),
    x AS (SELECT page_id, string_agg(CASE WHEN raw LIKE '<h1%' THEN chr(10) || '== ' || t || ' ==' || chr(10) WHEN raw LIKE '%<br>' THEN array_to_string(list_filter(ts[i:], lambda y: y <> ''), ' ') ELSE t END, chr(10) ORDER BY i) AS text
      FROM t JOIN l USING (page_id) WHERE t <> '' OR raw LIKE '%<br>' GROUP BY 1)
    SELECT page_id, trim(coalesce(text, ''), concat(' ', chr(10))) AS text FROM pages LEFT JOIN x USING (page_id)"""
)
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.extract(F.col("html")).alias("text"))


@query(
    f"""SELECT l.doc_id, CASE WHEN length(text) = 0 THEN 'SIN CONTENIDO' WHEN length(text) < 400 THEN 'MUY POCO (¿SPA?)' WHEN code <> 'es' THEN 'IDIOMA ' || upper(code) ELSE 'OK' END AS verdict
    FROM documents d JOIN {lang_sql('text')} l ON l.doc_id = d.doc_id"""
)
def seed_verdict(spark, d):
    return corpus(spark, d).select("doc_id", seeds.verdict(F.col("body")).alias("verdict"))


@query(
    """SELECT page_id AS seq, CASE WHEN page_id % 3 = 0 AND coalesce(url, '') NOT LIKE '%/wiki/%' THEN 'wikipedia without title or /wiki/ address' WHEN page_id % 3 = 1 THEN 'html without url' END AS problem
    FROM pages WHERE page_id % 3 < 2 AND (page_id % 3 = 1 OR coalesce(url, '') NOT LIKE '%/wiki/%')"""
)
def seed_problems(spark, d):
    p = table(spark, d, "pages").select(
        F.col("page_id").alias("seq"), F.lit("x").alias("category"), F.when(F.col("page_id") % 3 == 0, "wikipedia").otherwise("html").alias("source"),
        F.when(F.col("page_id") % 3 == 1, F.lit(None)).otherwise(F.col("url")).alias("url"),
    )
    return seeds.problems(p)


@query(
    """SELECT coalesce(a.category, b.category) AS category, coalesce(e, 0) AS expected, coalesce(n, 0) AS actual, round(coalesce(n, 0)::DOUBLE / nullif(coalesce(e, 0), 0), 2) AS ratio
    FROM (SELECT lang AS category, count(*) AS e FROM documents GROUP BY 1) a FULL JOIN (SELECT lang AS category, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1) b ON a.category = b.category"""
)
def coverage(spark, d):
    c = corpus(spark, d)
    return reporting.coverage(c, c.join(table(spark, d, "labels").filter("quality = 0"), "doc_id"))


# --- relational reports ------------------------------------------------------------------------------------------

sql_query("docs_per_category", "SELECT lang AS category, count(*) AS n, round(avg(n_chars), 1) AS mean_chars FROM documents GROUP BY lang")
sql_query("audit_daily", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
sql_query("category_topic", "SELECT lang AS category, source AS topic, count(*) AS n FROM documents GROUP BY 1, 2")
sql_query("confident_errors", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 0 AND l.toxic = 1")
sql_query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty,
    round(avg(l_extendedprice), 6) AS avg_price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
sql_query(
    "revenue_by_nation",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
sql_query(
    "top_orders",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY 1")
def category_pivot(spark, d):
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("SELECT doc_id, name, value FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT (value FOR name IN (quality, toxic))")
def unpivot_scores(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality", "toxic").unpivot("doc_id", ["quality", "toxic"], "name", "value")


@query("SELECT avg(n_chars) AS mean, sum(n_chars)::BIGINT AS total, median(n_chars) AS median, max(n_chars) AS longest, min(n_chars) AS shortest FROM documents")
def length_stats(spark, d):
    return reporting.length_stats(table(spark, d, "documents"))


@query("SELECT max(n)::DOUBLE / min(n) AS ratio FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def imbalance(spark, d):
    return reporting.imbalance(corpus(spark, d))


@query(
    """SELECT source, lang, purity FROM (SELECT source, lang, n::DOUBLE / sum(n) OVER (PARTITION BY source) AS purity, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r
    FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE r = 1"""
)
def dominant_category(spark, d):
    return reporting.dominant(table(spark, d, "documents"), "source", "lang")


TOKENS = "(SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM documents)"


@query(f"SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, token, n FROM (SELECT token, count(*) AS n FROM {TOKENS} GROUP BY 1 ORDER BY n DESC, token LIMIT 20)")
def top_tokens(spark, d):
    return reporting.top_tokens(corpus(spark, d).select(text.tokens(F.col("body")).alias("t")), "t")


@query(
    f"""WITH t AS (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) AS r FROM {TOKENS} GROUP BY 1, 2), k AS (SELECT lang, token FROM t WHERE r <= 40)
    SELECT a.lang AS a, b.lang AS b, round(count(*)::DOUBLE / 40, 3) AS overlap, array_to_string(list_sort(list(token))[1:6], ', ') AS common, count(*)::DOUBLE / 40 > 0.45 AS high
    FROM k a JOIN k b USING (token) WHERE a.lang < b.lang GROUP BY 1, 2"""
)
def vocab_overlap(spark, d):
    return reporting.vocabulary_overlap(corpus(spark, d).select("category", text.tokens(F.col("body")).alias("t")), "t")


@query("SELECT event_type AS operation, round(seconds, 4) AS seconds, calls, round(100 * seconds / sum(seconds) OVER (), 1) AS percent FROM (SELECT event_type, sum(value) AS seconds, count(*) AS calls FROM events GROUP BY 1)")
def timing_rollup(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("seconds"))
    return reporting.timing(e).withColumn("seconds", F.round("seconds", 4))


@query("SELECT sum(n)::BIGINT AS n_docs, count(*) AS n_categories, min(n) AS least, max(n) AS most, count(*) >= 3 AND min(n) >= 2 AND sum(n) >= 30 AS fit FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def corpus_health(spark, d):
    return reporting.corpus_health(corpus(spark, d)).drop("problems")


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, count(DISTINCT text) AS texts FROM documents")
def distinct_counts(spark, d):
    return table(spark, d, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("languages"), F.count_distinct("text").alias("texts"))


# --- terms and keywords ------------------------------------------------------------------------------------------

FREQUENT = ", ".join(f"'{w}'" for w in fixed.FREQUENCY_STOP_WORDS)
FREQUENCY = f"""(SELECT doc_id, rank, keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM (
  SELECT doc_id, lower(w) AS l, count(*) AS n, min(p) AS p, arg_min(w, p) AS keyword FROM (
    SELECT doc_id, unnest(range(1, len(a) + 1)) AS p, unnest(a) AS w FROM (SELECT doc_id, regexp_extract_all(source || ' ' || source || ' ' || text, '[\\p{{L}}\\p{{N}}+#]{{3,}}') AS a FROM documents))
  WHERE lower(w) NOT IN ({FREQUENT}) GROUP BY 1, 2)) WHERE rank <= 5)"""


@query(f"SELECT * FROM {FREQUENCY}")
def keyword_frequency(spark, d):
    return keywords.frequency_keywords(corpus(spark, d))


@query(f"SELECT lower(keyword) AS term, list_sort(list(DISTINCT doc_id)) AS ids FROM {FREQUENCY} GROUP BY 1")
def inverted_index(spark, d):
    return reporting.inverted_index(keywords.frequency_keywords(corpus(spark, d)))


TFIDF = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS a FROM documents),
g AS (SELECT doc_id, unnest(a) AS term FROM t UNION ALL SELECT doc_id, a[i] || ' ' || a[i + 1] FROM t, LATERAL (SELECT unnest(range(1, len(a))) AS i)
  UNION ALL SELECT doc_id, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] FROM t, LATERAL (SELECT unnest(range(1, len(a) - 1)) AS i)),
f AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM f GROUP BY 1), n WHERE df >= 2 AND df <= 0.85 * n ORDER BY total DESC, term LIMIT 8000),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM f JOIN v USING (term)),
x AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query(TFIDF + " SELECT doc_id, term, round(weight, 6) AS weight FROM x")
def tfidf(spark, d):
    return keywords.tfidf(table(spark, d, "documents")).withColumn("weight", F.round("weight", 6))


@query(TFIDF + " SELECT doc_id, rank, term, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 10) DESC, term) AS rank FROM x) WHERE rank <= 5")
def tfidf_keywords(spark, d):
    return keywords.tfidf_keywords(keywords.tfidf_lists(table(spark, d, "documents")))


@query(
    TFIDF + f""", k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 10) DESC, term) AS rank FROM x),
    s AS (SELECT doc_id, 0.8 AS w, rank, term FROM k WHERE rank <= 10 UNION ALL SELECT doc_id, 1.0, rank, keyword FROM {FREQUENCY})
    SELECT doc_id, trim(lower(term)) AS term, round(sum(w::DOUBLE / (60 + rank)), 9) AS score FROM s WHERE length(trim(lower(term))) >= 3 GROUP BY 1, 2"""
)
def rrf(spark, d):
    s = keywords.tfidf_keywords(keywords.tfidf_lists(table(spark, d, "documents")), k=10).select("doc_id", F.lit("tfidf").alias("signal"), "rank", "term")
    f = keywords.frequency_keywords(corpus(spark, d)).select("doc_id", F.lit("semantic").alias("signal"), "rank", F.col("keyword").alias("term"))
    return keywords.fuse(s.unionByName(f)).withColumn("score", F.round("score", 9))


STOPS = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)


@query(
    f"""WITH t AS (SELECT lang AS topic, token AS term, count(*) AS tf FROM {TOKENS} WHERE token NOT IN ({STOPS}) GROUP BY 1, 2), s AS (SELECT topic, sum(tf) AS words FROM t GROUP BY 1), a AS (SELECT term, sum(tf) AS al FROM t GROUP BY 1),
    m AS (SELECT avg(words) AS mean FROM s), w AS (SELECT topic, term, tf::DOUBLE / words * ln(1 + mean / al) AS weight FROM t JOIN s USING (topic) JOIN a USING (term), m)
    SELECT topic, string_agg(term, ', ' ORDER BY rank) AS label FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS rank FROM w) WHERE rank <= 4 GROUP BY 1"""
)
def ctfidf_labels(spark, d):
    return keywords.topic_labels(corpus(spark, d).withColumnRenamed("category", "topic"), "topic", "body")


@query()
def local_keywords(spark, d):
    return keywords.local_keywords(table(spark, d, "documents")).withColumn("score", F.round("score", 9))


@query()
def fused_keywords(spark, d):
    docs = table(spark, d, "documents")
    s = keywords.tfidf_keywords(keywords.tfidf_lists(docs), k=10).select("doc_id", F.lit("tfidf").alias("signal"), "rank", "term")
    s = s.unionByName(keywords.local_keywords(docs).select("doc_id", F.lit("semantic").alias("signal"), "rank", "term"))
    return keywords.select_keywords(keywords.fuse(s))


EXTRA = ", ".join(f"'{w}'" for w in fixed.EXTRA_STOP_WORDS)
LEMMA = r"""CASE WHEN length(w) <= 5 THEN w WHEN regexp_matches(regexp_replace(w, 'ces$', 'z'), '[lnrdsjzxc]es$') THEN regexp_replace(regexp_replace(w, 'ces$', 'z'), 'es$', '')
  ELSE regexp_replace(regexp_replace(w, 'ces$', 'z'), '([aeiouáéíóú])s$', '\1') END"""


@query(
    rf"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_+#]+'), lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN ({STOPS}) AND NOT regexp_matches(x, '^\p{{N}}+$')) AS t FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w FROM t), l AS (SELECT doc_id, i, w, {LEMMA} AS l FROM w), k AS (SELECT * FROM l WHERE l NOT IN ({EXTRA})),
    p AS (SELECT doc_id, i, l, NOT (length(w) > 4 AND regexp_matches(w, '(?:{keywords.ADVERB_SUFFIX}|{keywords.VERB_SUFFIXES})$')) AS kept FROM k)
    SELECT doc_id, coalesce(n, 0)::INTEGER AS n_tokens, coalesce(m, 0)::INTEGER AS n_pos, coalesce(s, '') AS text_pos FROM documents
    LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (kept) AS m, string_agg(l, ' ' ORDER BY i) FILTER (kept) AS s FROM p GROUP BY 1) USING (doc_id)"""
)
def preprocessed(spark, d):
    return keywords.preprocess(corpus(spark, d), "body").select("doc_id", "n_tokens", F.size("lemmas_pos").alias("n_pos"), "text_pos")


@query("SELECT keyword, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS keyword FROM documents) GROUP BY 1 ORDER BY documents DESC, keyword LIMIT 10")
def keyword_df_top10(spark, d):
    return reporting.frequent_keywords(corpus(spark, d).select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("body")))).alias("keyword")))


@query("SELECT lang AS category, count(*) AS total, sum(quality)::BIGINT AS hits, round(100.0 * sum(quality) / count(*), 1) AS pct FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def hit_rate(spark, d):
    return reporting.hit_rate(corpus(spark, d).join(table(spark, d, "labels"), "doc_id"), "category", "quality")


@query("SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) AS total, count(*) FILTER (value > 0)::DOUBLE / count(*) AS positive FROM events")
def outcome_counters(spark, d):
    return reporting.outcomes(table(spark, d, "events"), F.col("event_type") == "error", F.col("value") > 0)


@query(
    """SELECT avg(len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))) AS raw,
    avg(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))) AS without_stop_words, avg(len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda w: length(w) > 4))) AS by_pos FROM documents"""
)
def lexical_reduction(spark, d):
    """Long tokens stand for those that the parts of speech keep."""
    t = text.tokens(F.col("body"))
    c = corpus(spark, d).select(F.size(text.words(F.col("body"))).alias("n_words"), F.size(t).alias("n_tokens"), F.filter(t, lambda w: F.length(w) > 4).alias("lemmas_pos"))
    return reporting.lexical_reduction(c)


# --- vectors -----------------------------------------------------------------------------------------------------

COSINE = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) / sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])), 4)"


@query(
    f"""SELECT query_id, doc_id, rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM (
    SELECT q.vec_id AS query_id, i.vec_id AS doc_id, {COSINE.format(a='q.embedding', b='i.embedding')} AS similarity FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0)) WHERE rank <= 5"""
)
def knn(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.search(q, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")))


CENTRES = "(SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


@query(f"SELECT label, i - 1 AS i, round(x / sqrt(list_dot_product(c, c)), 6) AS x FROM (SELECT label, c, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS x FROM {CENTRES})")
def centroids(spark, d):
    c = retrieval.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    f"""SELECT vec_id, label, rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) AS rank FROM (
    SELECT vec_id, c.label, round(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(c, c)), 4) AS similarity FROM embeddings, {CENTRES} c)) WHERE rank <= 3"""
)
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.nearest_centroids(e, retrieval.centroids(e, "label", "embedding"), item_id="vec_id", vector="embedding")


@query(
    TFIDF + """, coordinate AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 7))::BIGINT % 384 AS i, sum(CASE WHEN substr(md5(term), 8, 1) < '8' THEN weight ELSE -weight END) AS x FROM x GROUP BY 1, 2),
    norm AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM coordinate GROUP BY 1) SELECT doc_id, i::INTEGER AS i, round(x / l, 6) AS x FROM coordinate JOIN norm USING (doc_id) WHERE round(x / l, 6) <> 0"""
)
def text_embeddings(spark, d):
    e = retrieval.embed(keywords.tfidf_lists(table(spark, d, "documents")), dimension=DEFAULT.embeddings.dimension)
    return e.select("doc_id", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6)).filter("x <> 0")


@query(
    f"""SELECT query_id, doc_id, rank, similarity, category, title, extract FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM (
    SELECT q.vec_id AS query_id, i.vec_id AS doc_id, i.label AS category, substr(repeat('title ' || i.vec_id || ' ', 20), 1, 70) AS title, substr(repeat('text ' || i.vec_id || ' ', 40), 1, 120) || '...' AS extract,
    {COSINE.format(a='q.embedding', b='i.embedding')} AS similarity FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 AND i.label = 3)) WHERE rank <= 5"""
)
def filtered_search(spark, d):
    many = lambda word, n: F.repeat(F.concat(F.lit(word + " "), F.col("vec_id").cast("string"), F.lit(" ")), F.lit(n))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("category"), many("title", 20).alias("title"), many("text", 40).alias("text"))
    q = e.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.semantic_search(q, e, category=3).select("query_id", "doc_id", "rank", "similarity", "category", "title", "extract")


KNOWN = "(SELECT text FROM documents JOIN labels USING (doc_id))"


@query(f"SELECT hits, misses, round(hits::DOUBLE / (hits + misses), 4) AS hit_rate FROM (SELECT count(*) FILTER (text IN {KNOWN}) AS hits, count(*) FILTER (text NOT IN {KNOWN}) AS misses FROM documents)")
def embedding_cache(spark, d):
    """The texts of labelled documents are cached already."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    encode = lambda m: m.select("cache_key", F.array(F.length("text").cast("double")).alias("vector"))
    known = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = encode(known.select(retrieval.cache_key("text").alias("cache_key"), "text").groupBy("cache_key").agg(F.min("text").alias("text")))
    return retrieval.through_cache(docs, cache, encode)[2]


# --- evaluation --------------------------------------------------------------------------------------------------

GUESS = "(SELECT l.doc_id, l.quality AS actual, (d.n_chars % 3 > 0)::INT AS predicted FROM labels l JOIN documents d USING (doc_id))"


def guesses(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for stored predictions."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.col("quality").alias("actual"), (F.col("n_chars") % 3 > 0).cast("int").alias("predicted"))


@query("SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS label_index FROM documents")
def label_encoding(spark, d):
    return evaluation.encode_labels(table(spark, d, "documents").select("doc_id", "lang"), "lang").select("doc_id", "lang", "label_index")


@query(
    """SELECT doc_id, CASE WHEN r <= least(ceil(0.25 * n), n - 1) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)"""
)
def stratified_split(spark, d):
    return evaluation.stratified_split(table(spark, d, "labels"), "quality").select("doc_id", "split")


@query(
    """SELECT doc_id, ((r - 1) % least(min(n) OVER (), 5))::INT AS fold FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)"""
)
def kfold(spark, d):
    return evaluation.folds(table(spark, d, "labels"), "quality").select("doc_id", F.col("fold").cast("int").alias("fold"))


@query(f"SELECT actual, predicted, n, n::DOUBLE / sum(n) OVER (PARTITION BY actual) AS share FROM (SELECT actual, predicted, count(*) AS n FROM {GUESS} GROUP BY 1, 2)")
def confusion(spark, d):
    return evaluation.confusion(guesses(spark, d))


REPORT = f"""(SELECT label, hits / nullif(guessed, 0) AS p, hits / nullif(support, 0) AS r, support FROM (
  SELECT label, count(*) FILTER (predicted = label)::DOUBLE AS guessed, count(*) FILTER (actual = label)::DOUBLE AS support, count(*) FILTER (actual = label AND predicted = label)::DOUBLE AS hits
  FROM {GUESS}, (SELECT DISTINCT actual AS label FROM {GUESS} UNION SELECT DISTINCT predicted FROM {GUESS}) GROUP BY 1))"""


@query(f"SELECT label, coalesce(p, 0) AS precision, coalesce(r, 0) AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, support::BIGINT AS support FROM {REPORT}")
def class_report(spark, d):
    return evaluation.class_report(guesses(spark, d))


@query(
    f"""SELECT a AS accuracy, avg(p) AS precision_macro, avg(r) AS recall_macro, avg(f) AS f1_macro, sum(p * support) / sum(support) AS precision_weighted, sum(r * support) / sum(support) AS recall_weighted, sum(f * support) / sum(support) AS f1_weighted
    FROM (SELECT coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f, support FROM {REPORT}), (SELECT avg((actual = predicted)::INT) AS a FROM {GUESS}) GROUP BY a"""
)
def metrics(spark, d):
    return evaluation.metrics(guesses(spark, d))


SCORES = "(SELECT doc_id, lang AS actual, l AS label, ((doc_id * 7 + p * 13) % 10 + 1)::DOUBLE / s AS score FROM documents, (VALUES ('de', 1), ('en', 2), ('es', 3), ('fr', 4)) v(l, p), LATERAL (SELECT sum((doc_id * 7 + x * 13) % 10 + 1) AS s FROM (VALUES (1), (2), (3), (4)) y(x)))"


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    raw = lambda p: (F.col("doc_id") * 7 + p * 13) % 10 + 1
    names = ["de", "en", "es", "fr"]
    s = table(spark, d, "documents").select("doc_id", F.col("lang").alias("actual"), F.explode(F.array(*[F.struct(F.lit(n).alias("label"), raw(i + 1).alias("x")) for i, n in enumerate(names)])).alias("v"), sum((raw(i) for i in range(2, 5)), raw(1)).alias("s"))
    return s.select("doc_id", "actual", "v.label", (F.col("v.x") / F.col("s")).alias("score"))


@query(f"SELECT avg(h) AS top_k FROM (SELECT doc_id, max((r <= 2 AND label = actual)::INT) AS h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM {SCORES}) GROUP BY 1)")
def topk_accuracy(spark, d):
    return evaluation.top_k_accuracy(class_scores(spark, d), 2)


@query(
    f"""SELECT round(avg(b), 9) AS brier, round(avg(l), 9) AS log_loss, round(avg(m), 9) AS mean_confidence FROM (SELECT doc_id, sum((score - (label = actual)::INT) ** 2) AS b,
    sum(CASE WHEN label = actual THEN -ln(score) END) AS l, max(score) AS m FROM {SCORES} GROUP BY 1)"""
)
def brier(spark, d):
    return evaluation.brier(class_scores(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("brier", "log_loss", "mean_confidence")])


@query(
    """WITH c AS (SELECT lang AS x, source AS y, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2), r AS (SELECT x, sum(n) AS r FROM c GROUP BY 1), s AS (SELECT y, sum(n) AS s FROM c GROUP BY 1),
    k AS (SELECT (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(r * (r - 1) / 2) FROM r) AS i2, (SELECT sum(s * (s - 1) / 2) FROM s) AS j2)
    SELECT round((ij - i2 * j2 / (t * (t - 1) / 2)) / ((i2 + j2) / 2 - i2 * j2 / (t * (t - 1) / 2)), 8) AS ari,
    round(2 * (SELECT sum(n / t * ln(n * t / (r * s))) FROM c JOIN r USING (x) JOIN s USING (y)) / ((SELECT -sum(r / t * ln(r / t)) FROM r) + (SELECT -sum(s / t * ln(s / t)) FROM s)), 8) AS nmi FROM k"""
)
def ari_nmi(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("a"), F.col("source").alias("b"))
    return evaluation.clustering_agreement(docs).select(F.round("ari", 8).alias("ari"), F.round("nmi", 8).alias("nmi"))


@query(
    """WITH t AS (SELECT vec_id, vec_id % 7 AS cluster, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS topic FROM embeddings),
    v AS (SELECT cluster, topic AS voted FROM (SELECT cluster, topic, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, topic) AS r FROM t WHERE topic <> -1 GROUP BY 1, 2) WHERE r = 1)
    SELECT vec_id, CASE WHEN topic = -1 THEN coalesce(voted, -1) ELSE topic END AS topic_final, topic = -1 AND voted IS NOT NULL AS approximate FROM t LEFT JOIN v USING (cluster)"""
)
def outlier_rescue(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("cluster"), F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label")).alias("topic"))
    return reporting.rescue_outliers(t).select("vec_id", "topic_final", "approximate")


@query("SELECT json_extract_string(props, '$.' || k) AS value, count(*) AS n FROM (SELECT props, json_keys(props)[1] AS k FROM events WHERE props IS NOT NULL) GROUP BY 1")
def json_metrics(spark, d):
    e = table(spark, d, "events").filter("props IS NOT NULL").select("props", F.json_object_keys("props")[0].alias("k"))
    m = F.from_json("props", "map<string,string>")
    return e.select(F.try_element_at(m, F.col("k")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT actual, predicted, n, share FROM (SELECT actual, predicted, n, n::DOUBLE / sum(n) OVER (PARTITION BY actual) AS share FROM (SELECT actual, predicted, count(*) AS n FROM " + GUESS + " GROUP BY 1, 2)) WHERE actual <> predicted ORDER BY share DESC, actual, predicted LIMIT 5")
def confused_pairs(spark, d):
    return evaluation.confused_pairs(guesses(spark, d))


@query("SELECT doc_id, quality, 1.0 * t / (k * n) AS class_weight FROM (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n, count(*) OVER () AS t FROM labels), (SELECT count(DISTINCT quality) AS k FROM labels)")
def class_weights(spark, d):
    return learning.balanced_weights(table(spark, d, "labels").select("doc_id", "quality"), "quality").select("doc_id", "quality", "class_weight")


@query(f"SELECT doc_id, label, score FROM (SELECT doc_id, label, round(score, 4) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM {SCORES}) WHERE r <= 3")
def three_best(spark, d):
    """The map of the three best categories of a response, as rows."""
    lists = class_scores(spark, d).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "label"))), 1, 3).alias("x"))
    return lists.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.label", F.round(-F.col("x.o"), 4).alias("score"))


# --- stores and scalars ------------------------------------------------------------------------------------------


@query("SELECT doc_id, regexp_replace(text, '(?i)the', ' ', 'g') AS without, regexp_replace(text, '(?i)the', ' ', 'g') <> text AS changed FROM documents")
def term_removal(spark, d):
    without = text.without_term(F.col("body"), F.lit("The"))
    return corpus(spark, d).select("doc_id", without.alias("without"), (without != F.col("body")).alias("changed"))


@query("SELECT doc_id, CASE lower(w) WHEN 'go' THEN 'Go' WHEN 'r' THEN 'R' ELSE w END AS term FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'GO' WHEN 1 THEN 'r' ELSE source END AS w FROM documents)")
def canonical_terms(spark, d):
    w = F.when(F.col("doc_id") % 3 == 0, "GO").when(F.col("doc_id") % 3 == 1, "r").otherwise(F.col("title"))
    return corpus(spark, d).select("doc_id", text.canonical_case(w).alias("term"))


@query("SELECT DISTINCT source AS term FROM documents")
def dictionary_extension(spark, d):
    docs = table(spark, d, "documents")
    return keywords.extend_dictionary(docs.filter("lang = 'en'").select(F.col("source").alias("term")).distinct(), docs.select(F.col("source").alias("term")))


@query("SELECT list_sort(list_intersect(list_distinct(list(lang) FILTER (source < 'src2')), list_distinct(list(lang) FILTER (source > 'src1')))) AS shared, len(list_distinct(list(source))) AS sources FROM documents")
def vocabulary_sets(spark, d):
    docs = table(spark, d, "documents")
    both = F.array_intersect(F.collect_set(F.when(F.col("source") < "src2", F.col("lang"))), F.collect_set(F.when(F.col("source") > "src1", F.col("lang"))))
    return docs.agg(F.array_sort(both).alias("shared"), F.size(F.collect_set("source")).cast("long").alias("sources"))


# --- learning (rows only: iterative algorithms) --------------------------------------------------------------------


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(vectors.doubles(F.col("embedding"))).alias("features"))


@query()
def kmeans(spark, d):
    return learning.cluster(vectors_of(spark, d), 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def logreg(spark, d):
    v = vectors_of(spark, d)
    s = evaluation.stratified_split(evaluation.encode_labels(v), "label", "vec_id")
    names = [str(r[0]) for r in v.select("label").distinct().orderBy("label").collect()]
    m = learning.train(s.filter("split = 'train'"))
    p = learning.scores(m, s.filter("split = 'test'").select("vec_id", F.col("label").cast("string").alias("actual"), "features"), names, "vec_id")
    best = p.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "label"))).filter("r = 1")
    return evaluation.metrics(best.select("actual", F.col("label").alias("predicted")))


@query()
def pca(spark, d):
    _, shares = learning.project(vectors_of(spark, d))
    return spark.createDataFrame([(i, x) for i, x in enumerate(shares)], "component int, share double")


@query()
def topics(spark, d):
    return learning.topics(vectors_of(spark, d), key="vec_id").groupBy("topic").agg(F.count("*").alias("n"))


@query()
def kmeans_sweep(spark, d):
    v = vectors_of(spark, d)
    return learning.kmeans_sweep(v)[0]


@query()
def predict_batch(spark, d):
    from ..operators.predict import Analyzer

    docs = table(spark, d, "documents")
    labelled = docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    return Analyzer.fit(labelled).predict(corpus(spark, d)).select("doc_id", "category", "probability", F.col("keywords").cast("string").alias("keywords"), "error")


from . import records  # noqa: E402, F401  registers its queries, which use the definitions above


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
