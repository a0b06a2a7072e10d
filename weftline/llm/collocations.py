"""Collocations by hierarchical naming of pairs.

Every frequent word gets an id. The ids of neighbouring words form pairs; frequent pairs get ids of their own and replace
their two words at each place, so that neighbouring pairs, which share a word, form three words, and so on. A name's
two parts are its parents: phrases, the counts of every cut and the phrases that lie inside a longer one are looked up
along them. All counts are partial sums before they move. Texts are read twice and move once; for the second level
and beyond, what moves for each place is its ids, packed two in a number where they fit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, numbered, small

#: What ends a piece, and what a word is within one.
BREAKS = ".,;:!?\n\x0b\x0c\r"
TOKEN = r"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+"


def tokens(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dealt: bool = False) -> DataFrame:
    """(_u, lang, _p, word): rows, and places that skip one at the end of a piece. dealt: rows of one _u are in one partition."""
    found = F.regexp_extract_all(F.coalesce(F.col("_t"), F.lit("")), F.lit(TOKEN), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("_u"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("_t"))
    rows = (rows.repartition("_u") if dealt else rows).select("_u", "lang", F.posexplode(found).alias("_p", "word"))
    return rows.filter(~F.col("word").isin(*BREAKS)).withColumn("word", ascii_lower(F.col("word")))


def _pair(a: str | Column, b: str | Column, ids: int) -> Column:
    """Two ids of so many as one key."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.shiftleft(a, 32).bitwiseOR(b) if ids < 1 << 31 else F.struct(a.alias("a"), b.alias("b"))


def _parts(key: str, ids: int) -> tuple[Column, Column]:
    return (F.shiftright(key, 32), F.col(key).bitwiseAND((1 << 32) - 1)) if ids < 1 << 31 else (F.col(f"{key}.a"), F.col(f"{key}.b"))


def _named(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """(id, c0, c1, lang, phrase, f, pre, suf) of pairs (id, c0, c1, f) of names below: pre has the counts of the first 1, 2, ...
    words, suf those of what follows each."""
    left = below.select(F.col("id").alias("c0"), "lang", F.col("phrase").alias("lp"), F.col("f").alias("lf"), F.col("pre").alias("lpre"))
    right = below.select(F.col("id").alias("c1"), F.substring_index("phrase", " ", -1).alias("rw"), F.col("f").alias("rf"), F.col("suf").alias("rsuf"))
    return pairs.join(left, "c0").join(right, "c1").select(
        "id", "c0", "c1", "lang", F.concat_ws(" ", "lp", "rw").alias("phrase"), "f",
        F.concat("lpre", F.array("lf")).alias("pre"), F.concat(F.array("rf"), "rsuf").alias("suf"),
    )


def cut_scores() -> Column:
    """The lowest-scoring cut of a named phrase: (score, k, l, r). Products of counts need more than 64 bits, so they are decimals."""
    return F.expr(
        """array_min(transform(sequence(1, size(pre)), k -> named_struct(
             'score', (CAST(f AS DECIMAL(19)) * CAST(f AS DECIMAL(19)) * CAST(1000000 AS DECIMAL(7))) div (CAST(pre[k - 1] AS DECIMAL(19)) * CAST(suf[k - 1] AS DECIMAL(19))),
             'k', k, 'l', pre[k - 1], 'r', suf[k - 1])))"""
    )


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, inside: int = 50) -> tuple[DataFrame, DataFrame]:
    """(phrases, (lang, n) of all words): lang, phrase, words, a, l, r, score of every candidate that no longer one covers.

    Candidates are contiguous phrases of 2 to longest words within a piece that occur at least `least` times in their
    language. The lowest-scoring cut counts, ties to the shortest first part. A candidate goes if a longer one that
    contains it, kept or not, occurs at least inside % as often; the phrases one word longer decide, since none
    beyond them is more frequent. Null texts have no words; a null language is 'und'. Repeated rows count each.
    An empty table gives no rows.
    """
    every = cut(tokens(docs, text_col, lang_col).groupBy("lang", "word").agg(F.count("*").alias("f")), "phrases-words")
    totals = cut(every.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-totals")
    empty = F.array().cast("array<bigint>")
    first = every.filter(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f", empty.alias("pre"), empty.alias("suf"))
    # the most frequent have the least ids, which are short
    level = cut(numbered(first, "phrases-order", F.desc("f"), F.asc("lang"), F.asc("phrase"), number="id"), "phrases-1")
    ids = level.count()
    words = tokens(docs, text_col, lang_col, dealt=True).join(small(level.select("lang", F.col("phrase").alias("word"), "id"), ids), ["lang", "word"])
    w = Window.partitionBy("_u").orderBy("_p")
    near = [F.when(F.lead("_p", j).over(w) == F.col("_p") + j, F.lead("id", j).over(w)).alias(f"c{j}") for j in range(1, longest)]
    rows = words.select(F.col("id").alias("c0"), *near).filter("c1 IS NOT NULL")
    rows = cut(rows.select(_pair("c0", "c1", ids).alias("k"), *[f"c{j}" for j in range(2, longest)]), "phrases-places")
    levels = []
    for k in range(2, longest + 1):
        counted = cut(rows.groupBy("k").agg(F.count("*").alias("f")).filter(F.col("f") >= least), f"phrases-pairs-{k}")
        pairs = cut(numbered(counted, f"phrases-order-{k}", F.desc("f"), F.asc("k"), number="id"), f"phrases-ids-{k}")
        c0, c1 = _parts("k", ids)
        level = cut(_named(pairs.select("id", c0.alias("c0"), c1.alias("c1"), "f"), level), f"phrases-{k}")
        levels.append(level)
        if k == longest:
            break
        # the pair at each place replaces its first part, where both it and the next one are frequent
        ahead, more = rows.filter("c2 IS NOT NULL"), longest - k
        for j in range(more + 1):
            name = pairs.select("k", F.col("id").alias(f"q{j}"))
            rest = [F.col(f"c{i}") for i in range(j + 2, more + 2)]
            known = [F.col(f"q{i}") for i in range(j + 1)]
            following = [_pair(_parts("k", ids)[1], f"c{j + 2}", ids).alias("k")] if j < more else []
            ahead = ahead.join(name, "k", "inner" if j < 2 else "left").select(*known, *following, *rest[1:])
        ids = pairs.count()
        rows = ahead.select(_pair("q0", "q1", ids).alias("k"), *[F.col(f"q{j}").alias(f"c{j}") for j in range(2, more + 1)])
        rows = cut(rows, f"phrases-places-{k}") if k + 1 < longest else rows
    kept = []
    for k, named in enumerate(levels, 2):
        if k < longest:
            over = levels[k - 1]
            cover = over.select(F.col("c0").alias("id"), F.col("f").alias("m")).union(over.select("c1", "f")).groupBy("id").agg(F.max("m").alias("m"))
            named = named.join(cover, "id", "left").filter(F.coalesce(100 * F.col("m") < inside * F.col("f"), F.lit(True)))
        kept.append(named.withColumn("x", cut_scores()).select("lang", "phrase", F.lit(k).alias("words"), F.col("f").alias("a"), F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score")))
    return reduce(DataFrame.unionByName, kept), totals


def best_phrases(docs: DataFrame, top: int = 2000, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, inside: int = 50) -> DataFrame:
    """The first `top` phrases of each language by falling score, then falling a, then the phrase's bytes: lang, rank, phrase, a, l, r, n, score.

    A language's candidates are sorted in parts, and only the first of each part meet, so none is sorted in one task whole.
    """
    found, totals = mine(docs, text_col, lang_col, longest, least, inside)
    found = cut(found, "phrases-found")
    parts = max(1, math.isqrt(found.count() // top))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    first = found.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(small(totals, totals.count()), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB: every phrase of one to three words counted as text.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
h AS (SELECT lang, phrase, k, f, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:], ' ') AS q FROM c, (VALUES (1), (2)) t(j) WHERE j < k),
x AS (SELECT h.lang, h.phrase, h.f AS a, j, lf.f AS l, rf.f AS r, ((1000000::HUGEINT * h.f * h.f) // (lf.f::HUGEINT * rf.f))::BIGINT AS score
  FROM h JOIN f lf ON lf.lang = h.lang AND lf.phrase = h.p JOIN f rf ON rf.lang = h.lang AND rf.phrase = h.q),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
s AS (SELECT lang, phrase, max(f) AS m FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM c WHERE k = 3) GROUP BY ALL),
z AS (SELECT y.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y LEFT JOIN s USING (lang, phrase) WHERE coalesce(100 * m < 50 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
