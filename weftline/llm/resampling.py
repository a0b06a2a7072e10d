"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are there.

Words are laid out as a table of positions. lead() over each document gives the words that follow, concatenated for each
order; n-grams are hashed to buckets, buckets are counted over both tables, and each document sums the gains of its
buckets. Gumbel noise from a hash of the id turns the greatest scores into a draw without replacement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop_cut, numbered

#: A word: letters a-z in either case, digits, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ngram_buckets(df: DataFrame, text_col: str = "text", orders: int = 2, buckets: int = 10_000, *keep: str) -> DataFrame:
    """(_u, keep..., b1..bN): a row for each word of each row of df, with the buckets of the n-grams that begin there.

    _u tells rows apart, equal ones too. An n-gram that would pass the text's end is null; a text without words
    gives one row of nulls. Texts are dealt by _u before their words are laid out, so the words stay where they are and
    meet in one window.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))
    dealt = df.withColumn("_u", F.monotonically_increasing_id()).repartition("_u")
    placed = dealt.select("_u", *keep, F.posexplode_outer(words).alias("_p", "_w")).withColumn("_w", ascii_lower(F.col("_w")))
    w = Window.partitionBy("_u").orderBy("_p")
    follows = [F.col("_w"), *[F.lead("_w", n).over(w) for n in range(1, orders)]]
    grams = placed.select("_u", *keep, *[x.alias(f"w{n}") for n, x in enumerate(follows, 1)])
    of = lambda n: F.concat_ws(" ", *[f"w{i}" for i in range(1, n + 1)])
    return grams.select("_u", *keep, *[F.when(F.col(f"w{n}").isNotNull(), F.crc32(of(n)) % buckets).cast("int").alias(f"b{n}") for n in range(1, orders + 1)])


def bucket_counts(rows: DataFrame, orders: int) -> DataFrame:
    """(b, n) over all orders; each task counts first, so a task's buckets are all that moves."""
    return rows.select(F.explode(F.array(*[f"b{n}" for n in range(1, orders + 1)])).alias("b")).filter("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("n"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    percent: int = 25, orders: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 7,
) -> DataFrame:
    """One row for each row of docs: _id, n_words, n_features, weight, score, rank (null if not drawn), all but _id long.

    A bucket of s of the S features of docs and t of the T of the target gains floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))).
    weight is the floored mean gain of a row's features, 0 without any. score adds noise that follows from the seed and
    the id alone, a null id being the empty text. Of the rows with at least least_words words the given percentage is
    drawn, by falling score, then rising id, null last. Repeated rows are drawn each for itself; their order among
    themselves is arbitrary. Null and empty texts have no features; an empty target gives gains from its smoothing
    alone, an empty table no rows.
    """
    names = [f"b{n}" for n in range(1, orders + 1)]
    rows = cut(ngram_buckets(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_t", orders, buckets, "_id"), "resample-buckets")
    own = cut(bucket_counts(rows, orders), "resample-counts")
    aim = cut(bucket_counts(ngram_buckets(target.select(F.col(target_text).alias("_t")), "_t", orders, buckets), orders).withColumnRenamed("n", "t"), "resample-target")
    total, total_t = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((own, "n"), (aim, "t")))
    d = lambda c: c.cast("double")
    gain = F.floor(1000 * F.ln(d(F.coalesce("t", F.lit(0)) + 1) * d(F.lit(total + buckets)) / (d(F.col("n") + 1) * d(F.lit(total_t + buckets)))))
    gains = own.join(F.broadcast(aim), "b", "left").select("b", gain.alias("gain"))  # a row for each bucket at most, as aim
    each = rows.select("_u", "_id", F.posexplode(F.array(*names)).alias("o", "b")).join(F.broadcast(gains), "b", "left")
    sums = each.groupBy("_u", "_id").agg(F.count_if((F.col("o") == 0) & F.col("b").isNotNull()).alias("n_words"), F.count("b").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    sums = sums.withColumn("weight", F.expr("if(n_features = 0, 0L, (g - pmod(g, n_features)) div n_features)"))
    sums = sums.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))))
    sums = cut(sums.withColumn("in", F.col("n_words") >= least_words).drop("g"), "resample-scores")
    drop_cut(rows)
    n = sums.filter("in").count() * percent // 100
    ranks = numbered(sums, "resample-order", F.desc("in"), F.desc("score"), F.asc_nulls_last("_id"), F.asc("_u"))
    return ranks.select("_id", "n_words", "n_features", "weight", "score", F.when(F.col("_n") <= n, F.col("_n")).alias("rank"))


#: DuckDB: the same, with a CRC over the bytes of each different feature.
SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) r(i))),
w AS (SELECT 'd' AS src, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
g AS (SELECT src, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
fb AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(f))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)),
  lambda c, x: xor(tab.t[(xor(c, x) & 255) + 1], c // 256))) % 10000 AS b FROM (SELECT DISTINCT f FROM g), tab),
c AS (SELECT b, count(*) FILTER (src = 'd') AS s, count(*) FILTER (src = 'b') AS t FROM g JOIN fb USING (f) GROUP BY b),
z AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM c),
gain AS (SELECT b, floor(1000 * ln((c.t + 1)::DOUBLE * (z.s + 10000) / ((c.s + 1)::DOUBLE * (z.t + 10000))))::BIGINT AS gain FROM c, z),
m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM g JOIN fb USING (f) JOIN gain USING (b) WHERE src = 'd' GROUP BY doc_id),
s AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (doc_id) WHERE src = 'd'),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n >= 20)
SELECT doc_id, n AS n_words, (n + greatest(n - 1, 0))::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM r) THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""
