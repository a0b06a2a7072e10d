"""Benchmark decontamination with a positional inverted index.

Each item gives windows of consecutive words. The frequency of every benchmark word is counted over the whole
corpus; a window's two rarest words are its anchors. Postings (word, document, position) of the anchors are
stored, those of a window's rarest word with the words around it, which are the entries that the lists of all other
words have there. Lists are intersected after each position is moved back by the word's offset in the window: a phrase
match has every word at its place, a proximity match has every word within SLOP words of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import ascii_lower, cut, small

#: What separates words: ASCII other than digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, ANCHORS, SLOP = 10, 2, 3
#: A window's second list is merged only if at most so many times as long as its first; beyond that
#: the phrase check settles a match more cheaply than the merge.
SKIP = 2


def words(text: Column) -> Column:
    """Words with A-Z lowered and nothing else. A gap at either end gives an empty word there, which matches nothing."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.split(F.lower(text), GAP)).otherwise(F.transform(F.split(text, GAP), ascii_lower))


def n_words(w: Column) -> Column:
    """How many words an array of words() has."""
    return (F.size(w) - (w[0] == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("long")


def windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window id, words) of the different windows, and (window id, item) pairs. Items without words give none."""
    w = items.select(F.col(item_col).cast("string").alias("item"), F.filter(words(F.col(text_col)), lambda x: x != "").alias("w")).filter(F.size("w") > 0)
    every = w.select(
        "item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))).alias("w")
    ).distinct()
    pairs = cut(every.withColumn("wid", F.sha2(F.array_join("w", " "), 256)), "bench-windows")
    return pairs.select("wid", "w").distinct(), pairs.select("wid", "item")


def index(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, size: int = WINDOW, slop: int = SLOP) -> dict:
    """The stored index: the texts' words, postings of the anchors, the windows with their anchors, and the item pairs.

    Anchors are different words wherever a window has two.
    """
    wins, pairs = windows(items, text_col=text_col, size=size)
    terms = cut(wins.select("wid", F.posexplode("w").alias("off", "term")).withColumn("t", F.xxhash64("term")), "bench-terms")
    vocab = terms.select("t").distinct()
    n_vocab = vocab.count()
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), words(F.col(text_col)).alias("_w"))
    texts = cut(texts, "bench-words")
    # how often the corpus has each benchmark word; a partial sum for each task is all that moves
    freq = texts.select(F.explode("_w").alias("term")).select(F.xxhash64("term").alias("t")).join(small(vocab, n_vocab), "t").groupBy("t").agg(F.count("*").alias("cf"))
    by_window = Window.partitionBy("wid")
    known = (
        terms.join(cut(freq, "bench-frequency"), "t", "left")
        .withColumn("least", F.min(F.coalesce("cf", F.lit(0))).over(by_window))
        .withColumn("again", F.row_number().over(Window.partitionBy("wid", "t").orderBy("off")) > 1)
    )
    # a word that the corpus lacks rules its windows out
    known = known.filter("least > 0").withColumn("rank", F.row_number().over(by_window.orderBy("again", "cf", "off")))
    held = known.filter((F.col("rank") == 1) | ((F.col("rank") <= ANCHORS) & ~F.col("again") & (F.col("cf") <= SKIP * F.col("least"))))
    anchors = cut(
        held.join(wins, "wid").select("wid", "t", "off", "rank", F.size("w").alias("len"), F.when(F.col("rank") == 1, F.col("w")).alias("w"),
                                      F.count("*").over(by_window).alias("need")),
        "bench-anchors",
    )
    lookup = cut(anchors.groupBy("t").agg(F.min("rank").alias("best")), "bench-lookup")
    n_lookup, reach = lookup.count(), size - 1 + 2 * slop
    # 'around' begins reach words before the posting, or at the text's first word
    around = F.when(F.col("best") == 1, F.slice("_w", F.greatest(F.col("pos") - reach + 1, F.lit(1)), F.least(F.col("pos"), F.lit(reach)) + reach + 1))
    if n_lookup <= common.BROADCAST_ROWS:
        placed = texts.select("_id", "_h", "_w", F.posexplode("_w").alias("pos", "term")).withColumn("t", F.xxhash64("term")).join(F.broadcast(lookup), "t")
    else:
        # words alone meet the lookup; places come back to their text, which moves once
        found = texts.select("_id", "_h", F.posexplode("_w").alias("pos", "term")).select("_id", "_h", "pos", F.xxhash64("term").alias("t")).distinct().join(lookup, "t")
        found = found.groupBy(F.col("_id").alias("_i2"), F.col("_h").alias("_h2")).agg(F.collect_list(F.struct("pos", "t", "best")).alias("p"))
        once = texts.dropDuplicates(["_id", "_h"])
        placed = once.join(found, once["_id"].eqNullSafe(found["_i2"]) & (once["_h"] == found["_h2"])).select("_id", "_h", "_w", F.inline("p"))
    postings = cut(placed.select("_id", "_h", "t", "pos", around.alias("around")), "bench-postings")
    return {"texts": texts, "postings": postings, "anchors": anchors, "n_anchors": anchors.count(), "pairs": pairs, "size": size, "slop": slop}


def _moved(ix: dict) -> DataFrame:
    """Postings with the windows of their words; start is where a window would begin, at its place within 'around'."""
    reach = F.lit(ix["size"] - 1 + 2 * ix["slop"])
    joined = ix["postings"].join(small(ix["anchors"], ix["n_anchors"]), "t")
    return joined.withColumn("start", F.col("pos") - F.col("off")).withColumn("at", F.least(F.col("pos"), reach) - F.col("off"))


def exact(ix: dict) -> DataFrame:
    """(_id, _h, wid, start, len) of every occurrence of a window."""
    phrase = (F.col("at") >= 0) & F.slice("around", F.greatest("at", F.lit(0)) + 1, F.col("len")).eqNullSafe(F.col("w"))
    return (
        _moved(ix).filter((F.col("start") >= 0) & ((F.col("rank") > 1) | phrase))
        .groupBy("_id", "_h", "wid", "start", "len", "need")
        .agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("met"))
        .filter("bit_count(met) = need")
        .drop("need", "met")
    )


def proximity(ix: dict) -> DataFrame:
    """(_id, _h, wid) of the windows that a text has within slop words, exact ones among them.

    For some start, every word of the window stands at most slop words from its place, and the stretch from slop words
    before the first place to slop words behind the last has each word as often as the window has it.
    """
    slop = ix["slop"]
    all_there = F.size(F.array_except("w", "around")) == 0
    near = F.expr(
        f"""exists(sequence({-slop}, {slop}), d ->
              forall(sequence(0, len - 1), k -> array_contains(slice(around, greatest(at + d + k - {slop}, 0) + 1, greatest(least({2 * slop + 1}, at + d + k + {slop + 1}), 0)), w[k]))
              AND (size(array_distinct(w)) = len OR forall(w, x ->
                size(filter(slice(around, greatest(at + d - {slop}, 0) + 1, greatest(least(len + {2 * slop}, at + d + len + {slop}), 0)), y -> y = x)) >= size(filter(w, y -> y = x)))))"""
    )
    rarest = _moved(ix).filter(F.col("rank") == 1)
    return rarest.filter(F.when(all_there, near).otherwise(F.lit(False))).select("_id", "_h", "wid").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_sha256.

    The last two count items with a window that matches by proximity, exact matches among them, and digest their
    sorted ids. Null and empty texts have no words. Items without words, or null ones, match nothing; an empty benchmark
    hits nothing. Rows that repeat id and text get equal results.
    """
    ix = index(docs, items, id_col, text_col, size, slop)
    hits = cut(exact(ix), "bench-hits")
    key = ["_id", "_h"]

    def by_item(found: DataFrame, name: str) -> DataFrame:
        each = found.select(*key, "wid").distinct().join(ix["pairs"], "wid").select(*key, "item").distinct()
        return each.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias(name))

    n_hit = (
        hits.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p"))
        .distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    )
    near, items_ = by_item(proximity(ix), "near"), by_item(hits, "items")
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])
    found = n_hit.join(items_, same(n_hit, items_)).select(n_hit["_id"], n_hit["_h"], "n_hit", "items")
    # what matches exactly matches by proximity
    found = near.join(found, same(near, found), "left").select(near["_id"].alias("_id2"), near["_h"].alias("_h2"), "n_hit", "items", "near")
    all_docs = ix["texts"].select(*key, n_words(F.col("_w")).alias("n_words"))
    out = all_docs.join(found, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(some("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(some("items"), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.size(some("near")).cast("long").alias("n_near"),
        F.sha2(F.array_join(some("near"), ","), 256).alias("near_sha256"),
    )


#: DuckDB: every word sequence of a document as long as some window, joined with the windows; for proximity, the windows
#: whose words a document all has, then the starts that each word's places allow.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1),
ww AS (SELECT g, n, unnest(range(0, n)) AS k, unnest(string_split(g, ' ')) AS t FROM (SELECT DISTINCT g, n FROM bw)),
wc AS (SELECT *, count(*) OVER (PARTITION BY g) AS kinds FROM (SELECT g, t, count(*) AS m FROM ww GROUP BY 1, 2)),
dp AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
dt AS (SELECT DISTINCT doc_id, t FROM dp),
likely AS (SELECT doc_id, g FROM dt JOIN wc USING (t) GROUP BY 1, 2 HAVING count(*) = min(kinds)),
starts AS (SELECT doc_id, g, n, k, unnest(range(p - k - 3, p - k + 4)) AS s FROM likely JOIN ww USING (g) JOIN dp USING (doc_id, t)),
st AS (SELECT doc_id, g, n, s FROM starts GROUP BY ALL HAVING count(DISTINCT k) = n),
often AS (SELECT st.doc_id, st.g, st.s, wc.t, wc.m, wc.kinds, count(*) AS c FROM st JOIN wc USING (g) JOIN dp ON dp.doc_id = st.doc_id AND dp.t = wc.t AND dp.p BETWEEN st.s - 3 AND st.s + st.n + 2 GROUP BY ALL),
matched AS (SELECT doc_id, g, s FROM often GROUP BY doc_id, g, s HAVING bool_and(c >= m) AND count(*) = min(kinds)),
near AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near FROM (SELECT DISTINCT doc_id, item FROM matched JOIN bw USING (g)) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""
