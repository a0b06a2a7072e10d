"""Terms and keywords: TF-IDF, frequency, local statistics, semantic ranking, fusion."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..config import DEFAULT, Config
from ..functions import text, vectors
from ..session import BROADCAST_ROWS, small, stored


def frequency_keywords(df: DataFrame, title: str = "title", body: str = "body", key: str = "doc_id", k: int = 5) -> DataFrame:
    """(key, rank, keyword, n): most frequent words of twice the title and the body, first come first on ties.

    Words are three or more letters, digits, '+' or '#'; stop words count as places but not as keywords; a keyword
    shows the capitals of its first occurrence. A document's words are counted where it lies, in Arrow batches.
    """
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    # rows that share a key are read side by side, so that a word's place is the least of its places
    merged = F.array_sort(F.flatten(F.collect_list(F.transform("t", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))))))
    found = token_lists(df, key, F.regexp_extract_all(whole, F.lit(r"[\p{L}\p{N}+#]{3,}"), F.lit(0)), F.transform(merged, lambda x: x["word"]))
    found = found.select(key, F.transform("t", lambda w: F.lower(w)).alias("low"), "t")

    def run(batches):  # noqa: ANN001, ANN202
        stops = pa.array(fixed.FREQUENCY_STOP_WORDS, pa.string())
        for b in batches:
            words, seen = b.column("t").flatten(), 0
            for (start, _), flat, row in _blocks(b):
                d = flat.dictionary_encode()
                code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                here = np.flatnonzero(~pc.is_in(d.dictionary, value_set=stops).to_numpy(zero_copy_only=False)[code])
                span = len(d.dictionary) + 1
                u, first, n = np.unique(row[here] * span + code[here], return_index=True, return_counts=True)
                order = np.lexsort((first, -n, u // span))
                r = u[order] // span
                rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
                best = rank <= k
                order, rank, r = order[best], rank[best], r[best]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(start + r)), pa.array(rank, pa.int32()), words.take(pa.array(seen + here[first[order]])), pa.array(n[order], pa.int64())], names=[key, "rank", "keyword", "n"])
                seen += len(flat)

    return found.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, rank int, keyword string, n long")


def grams_of(df: DataFrame, key: str, text_col: str, low: int, high: int, words: DataFrame) -> DataFrame:
    """(key, term) of the n-grams whose words are all in words (term, distinct).

    A row is a token with those that follow it; words are looked up before any phrase is put together.
    """
    t = df.select(F.col(key), text.tokens(F.col(text_col)).alias("_t")).filter(F.size("_t") > 0)
    cols = [f"_w{k}" for k in range(high)]
    each = F.transform(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: F.struct(*[F.get("_t", i + k).alias(c) for k, c in enumerate(cols)]))
    rows = t.select(key, F.explode(each).alias("_x")).select(key, "_x.*")
    for k, c in enumerate(cols):
        rows = rows.join(words.select(F.col("term").alias(f"_f{k}")), F.col(c) == F.col(f"_f{k}"), "inner" if k < low else "left")
    terms, ok = [], F.lit(True)
    for n in range(1, high + 1):
        ok = ok & F.col(f"_f{n - 1}").isNotNull()
        if n >= low:
            terms.append(F.when(ok, F.concat_ws(" ", *cols[:n])))
    return rows.select(key, F.explode(F.array_compact(F.array(*terms))).alias("term"))


def _kept(by_term: DataFrame, n: int, cfg: Config) -> DataFrame:
    c = cfg.tfidf
    return by_term.filter((F.col("df") >= c.min_df) & (F.col("df") <= c.max_df * F.lit(n))).orderBy(F.desc("total"), "term").limit(c.max_features)


def _joined_terms(df: DataFrame, key: str, text_col: str, low: int, high: int, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """((term, df, idf), (key, term, tf)): what fitted_terms() finds, by joins, for vocabularies with more ties at their end than tasks can be sent.

    A phrase is no more frequent than its rarest word and in no more documents than it has places, so phrases are
    dropped, before they are put together, where a word is rarer than the last one that could enter; counts by row are
    made only of terms that are frequent enough.
    """
    n, c = df.count(), cfg.tfidf
    t = df.select(text.tokens(F.col(text_col)).alias("_t"))
    one = lambda x, total, rows: t.select(F.explode(x).alias("term"), F.lit(total).alias("total"), F.lit(rows).alias("df"))
    words = one("_t", 1, 0).unionByName(one(F.array_distinct("_t"), 0, 1)).groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    words = stored(words, "word-counts")
    last = _kept(words, n, cfg).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    least = max(c.min_df, last["least"] if low == 1 and last["n"] >= c.max_features else 0)
    common = stored(words.filter(F.col("total") >= least).select("term"), "frequent-words")
    common = small(common, common.count())
    likely = words.filter((F.col("total") >= least) & (F.col("df") <= c.max_df * F.lit(n))).select("term") if low == 1 else words.select("term").limit(0)
    if high > 1:
        phrases = grams_of(df, key, text_col, max(low, 2), high, common).groupBy("term").agg(F.count("*").alias("total")).filter(F.col("total") >= least)
        likely = likely.unionByName(phrases.select("term"))
    likely = stored(likely, "frequent-terms")
    counts = grams_of(df, key, text_col, low, high, common).join(small(likely, likely.count()), "term").groupBy(key, "term").agg(F.count("*").alias("tf"))
    counts = stored(counts, "term-counts")
    kept = _kept(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), n, cfg)
    vocab = stored(kept.select("term", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")
    return vocab, counts


def token_lists(df: DataFrame, key: str, tokens: Column, merged: Column | None = None) -> DataFrame:
    """(key, t): one row for each key with its array of tokens.

    Rows that share a key are put behind one another, with a null between, which no phrase spans; merged, an aggregate
    over the arrays t, may put them together otherwise. Only keys are shuffled to find such rows.
    """
    lists = df.select(F.col(key), tokens.alias("t"))
    twice = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n")).filter("n > 1").select("_k")
    n = twice.count()
    if not n:
        return lists
    same = F.col(key).eqNullSafe(F.col("_k"))
    merged = F.flatten(F.collect_list(F.concat(F.coalesce("t", F.array().cast("array<string>")), F.array(F.lit(None).cast("string"))))) if merged is None else merged
    several = lists.join(small(twice, n), same, "left_semi").groupBy(key).agg(merged.alias("t"))
    return lists.join(small(twice, n), same, "left_anti").unionByName(several)


#: Tokens that a task counts at once.
BLOCK = 1 << 20


def _blocks(batch: pa.RecordBatch):  # noqa: ANN202
    """(rows as (first, end), tokens, row of each token) of runs of a batch of (key, list) whose tokens fit in a block."""
    sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, ends, at = batch.column(1).flatten(), np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        upto = max(int(np.searchsorted(ends, base + BLOCK, side="right")), at + 1)
        yield (at, upto), flat.slice(base, ends[upto - 1] - base), np.repeat(np.arange(upto - at), sizes[at:upto])
        at = upto


def _pairs(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, count) of the distinct pairs, by row and id."""
    span = int(ids.max(initial=0)) + 1
    u, n = np.unique(row * span + ids, return_counts=True)
    return u // span, u % span, n


def _sums(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, its places, its rows)."""
    _, g, n = _pairs(row, ids)
    order = np.argsort(g, kind="stable")
    first = np.flatnonzero(np.diff(g[order], prepend=-1))
    return g[order][first], np.add.reduceat(n[order], first) if len(first) else n, np.diff(np.append(first, len(g)))


def _phrases(now: np.ndarray, words: np.ndarray, row: np.ndarray, n: int, width: int) -> np.ndarray:
    """The number of the phrase of n words that begins at each token, if both phrases of n - 1 words in it are known (now), else -1."""
    ids, m = np.full(len(words), -1, np.int64), max(len(words) - n + 1, 0)
    at = np.flatnonzero((now[:m] >= 0) & (now[1 : m + 1] >= 0) & (row[:m] == row[n - 1 : n - 1 + m]))
    ids[at] = now[at].astype(np.int64) * width + words[at + n - 1]
    return ids


def _places(words: np.ndarray, row: np.ndarray, known: list[np.ndarray], width: int):  # noqa: ANN202
    """For one word, two and so on: the place in its list of the term that begins at each token, or -1."""
    now = words
    yield now
    for n, numbers in enumerate(known, 2):
        ids = _phrases(now, words, row, n, width)
        at = np.searchsorted(numbers, ids)
        at[at == len(numbers)] = 0
        now = np.where((ids >= 0) & (numbers[at] == ids), at, -1) if len(numbers) else np.full(len(ids), -1)
        yield now


def _found(words: np.ndarray, row: np.ndarray, known: list[np.ndarray], index: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every place of a term that has an index."""
    rows, ids = [], []
    for now, at in zip(_places(words, row, known, width), index, strict=True):
        here = np.flatnonzero(now >= 0)
        v = at[now[here]]
        rows.append(row[here][v >= 0])
        ids.append(v[v >= 0])
    return np.concatenate(rows), np.concatenate(ids)


def fitted_terms(df: DataFrame, key: str, text_col: str, low: int, high: int, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """((term, df, idf), (key, terms, counts)): the vocabulary, and for each key the terms of it that its texts have.

    Terms are within the limits of document frequency, at most max_features by corpus count, ties by term. A document's
    terms are counted where it lies: words first, then documents are kept as numbers of the words that are frequent
    enough, and phrases are counted by length. A phrase is no more frequent than the phrases in it, so it is counted only
    where those are frequent enough; what is enough rises with each length to the last term that could still enter. Only
    sums by term are shuffled.
    """
    n, c, spark = df.count(), cfg.tfidf, df.sparkSession
    lists = token_lists(df, key, text.tokens(F.col(text_col)))

    def count_words(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for _, flat, row in _blocks(b):
                d, here = flat.dictionary_encode(), flat.is_valid().to_numpy(zero_copy_only=False)
                g, total, rows = _sums(row[here], d.indices.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([d.dictionary.take(pa.array(g)), pa.array(total, pa.int64()), pa.array(rows, pa.int64())], names=["term", "total", "df"])

    sums = [F.sum("total").alias("total"), F.sum("df").alias("df")]
    words = stored(lists.mapInArrow(count_words, "term string, total long, df long").groupBy("term").agg(*sums).filter(F.col("df") >= c.min_df), "word-counts")
    within = F.col("df") <= c.max_df * F.lit(n)
    enough, kept = c.min_df, words.filter(within).select("total") if low == 1 else words.select("total").limit(0)

    def last(so_far: int) -> int:
        top = kept.orderBy(F.desc("total")).limit(c.max_features).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
        return max(so_far, top["least"]) if top["n"] >= c.max_features else so_far

    enough = last(enough)
    common = words.filter(F.col("total") >= enough)
    if common.count() > BROADCAST_ROWS:
        return _joined_lists(df, key, text_col, low, high, cfg)
    common = common.orderBy("term").toArrow()  # bounded by the count
    names = [common.column("term").combine_chunks()]
    width, found = max(len(names[0]), 1), [(1, common)]
    sent = spark.sparkContext.broadcast(names[0])

    def encode(batches):  # noqa: ANN001, ANN202
        for b in batches:
            offsets = np.append(0, np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            numbers = pc.index_in(b.column(1).flatten(), value_set=sent.value).fill_null(-1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), numbers)], names=[key, "c"])

    kind = f"`{key}` {df.schema[key].dataType.simpleString()}"
    coded = stored(lists.mapInArrow(encode, f"{kind}, c array<int>"), "word-numbers")
    known: list[np.ndarray] = []
    for size in range(2, high + 1):

        def count_phrases(batches, size=size, known=tuple(known)):  # noqa: ANN001, ANN202
            for b in batches:
                for _, flat, row in _blocks(b):
                    w = flat.to_numpy(zero_copy_only=False)
                    *_, now = _places(w, row, known, width)
                    ids = _phrases(now, w, row, size, width)
                    at = np.flatnonzero(ids >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _sums(row[at], ids[at])], names=["g", "total", "df"])

        counts = coded.mapInArrow(count_phrases, "g long, total long, df long").groupBy("g").agg(*sums)
        counts = stored(counts.filter((F.col("total") >= enough) & (F.col("df") >= c.min_df)), "phrase-counts")
        if size >= low:
            kept = kept.unionByName(counts.filter(within).select("total"))
            enough = last(enough)
        counts = counts.filter(F.col("total") >= enough)
        if counts.count() > BROADCAST_ROWS:
            return _joined_lists(df, key, text_col, low, high, cfg)
        counts = counts.orderBy("g").toArrow()  # bounded by the count
        numbers = counts.column("g").to_numpy()
        before, after = names[-1].take(pa.array(numbers // width)), names[0].take(pa.array(numbers % width))
        names.append(pc.binary_join_element_wise(before, after, " "))
        known.append(numbers)
        found.append((size, counts))
    most = c.max_df * n
    terms = [(-t, term, size, i, d) for (size, x), own in zip(found, names, strict=True) if size >= low for i, (term, t, d) in enumerate(zip(own.to_pylist(), x.column("total").to_pylist(), x.column("df").to_pylist(), strict=True)) if d <= most]
    terms = sorted(terms)[: c.max_features]
    index = [np.full(len(x), -1) for x in names]
    for v, (_, _, size, i, _) in enumerate(terms):
        index[size - 1][i] = v
    vocab = spark.createDataFrame([(term, d) for _, term, _, _, d in terms], "term string, df long").select("term", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    about = spark.sparkContext.broadcast((pa.array([x[1] for x in terms], pa.string()), known, index))

    def count_terms(batches):  # noqa: ANN001, ANN202
        for b in batches:
            own, known, index = about.value
            for (first, end), flat, row in _blocks(b):
                r, v, tf = _pairs(*_found(flat.to_numpy(zero_copy_only=False), row, known, index, width))
                offsets = pa.array(np.searchsorted(r, np.arange(end - first + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.ListArray.from_arrays(offsets, own.take(pa.array(v))), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names=[key, "terms", "counts"])

    return vocab, coded.mapInArrow(count_terms, f"{kind}, terms array<string>, counts array<bigint>")


def known_weights(df: DataFrame, key: str, text_col: str, low: int, high: int, vocab: DataFrame) -> DataFrame:
    """(key, i, x): for each key the rising indices and the weights, of unit length, of the terms of a bounded vocabulary (term, index, idf).

    A document's terms are counted where it lies, by numbers of words and phrases; texts without a known term have empty lists.
    """
    spark, rows = df.sparkSession, vocab.select("term", "index", "idf").toArrow().to_pylist()  # bounded by max_features
    terms = {tuple(r["term"].split(" ")): (r["index"], r["idf"]) for r in rows}
    terms = {t: x for t, x in terms.items() if low <= len(t) <= high}
    # whatever stands within a term is numbered by length, so that phrases are found from shorter ones
    parts = [sorted({t[i : i + n] for t in terms for i in range(len(t) - n + 1)}) for n in range(1, high + 1)]
    at, place = {t[0]: i for i, t in enumerate(parts[0])}, {t: i for i, t in enumerate(parts[0])}
    width, known, index = max(len(at), 1), [], [np.array([terms.get(t, (-1,))[0] for t in parts[0]], np.int64)]
    for own in parts[1:]:
        numbers = {place[t[:-1]] * width + at[t[-1]]: t for t in own}
        known.append(np.array(sorted(numbers), np.int64))
        place = {numbers[g]: i for i, g in enumerate(sorted(numbers))}
        index.append(np.array([terms.get(t, (-1,))[0] for t in place], np.int64))
    idf = np.zeros(max((i for i, _ in terms.values()), default=-1) + 1)
    for i, x in terms.values():
        idf[i] = x
    sent = spark.sparkContext.broadcast((pa.array(list(at), pa.string()), known, index, idf))

    def weigh(batches):  # noqa: ANN001, ANN202
        names, known, index, idf = sent.value
        for b in batches:
            for (first, end), flat, row in _blocks(b):
                w = pc.index_in(flat, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
                r, v, tf = _pairs(*_found(w, row, known, index, width))
                x = (1 + np.log(tf)) * idf[v]
                x = x / np.sqrt(np.bincount(r, x * x, end - first))[r]
                offsets = pa.array(np.searchsorted(r, np.arange(end - first + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(x, pa.float64()))], names=[key, "i", "x"])

    return token_lists(df, key, text.tokens(F.col(text_col))).mapInArrow(weigh, f"`{key}` {df.schema[key].dataType.simpleString()}, i array<int>, x array<double>")


def _joined_lists(df: DataFrame, key: str, text_col: str, low: int, high: int, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """fitted_terms() by joins: its lists are gathered by key."""
    vocab, counts = _joined_terms(df, key, text_col, low, high, cfg)
    both = counts.join(F.broadcast(vocab.select("term")), "term").groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("x"))
    return vocab, both.select(key, F.col("x.term").alias("terms"), F.col("x.tf").alias("counts"))


def vocabulary(df: DataFrame, key: str, text_col: str, low: int, high: int, cfg: Config = DEFAULT) -> DataFrame:
    """(term, df, idf) of fitted_terms()."""
    return fitted_terms(df, key, text_col, low, high, cfg)[0]


def tfidf_lists(df: DataFrame, key: str = "doc_id", text_col: str = "text", cfg: Config = DEFAULT, low: int | None = None, high: int | None = None) -> DataFrame:
    """(key, terms, weights): for each key its terms, and their sublinear frequencies times smoothed idf, of unit length.

    The vocabulary has at most max_features terms, so it is sent to all tasks; nothing is shuffled.
    """
    c = cfg.tfidf
    vocab, lists = fitted_terms(df, key, text_col, low or c.ngram_min, high or c.ngram_max, cfg)
    idf = vocab.select("term", "idf").orderBy("term").toArrow()  # bounded by max_features
    sent = df.sparkSession.sparkContext.broadcast((idf.column("term").combine_chunks(), idf.column("idf").to_numpy()))

    def weigh(batches):  # noqa: ANN001, ANN202
        names, idf = sent.value
        for b in batches:
            sizes = b.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            tf = b.column("counts").flatten().to_numpy(zero_copy_only=False)
            w = ((1 + np.log(tf)) if c.sublinear else tf) * idf[pc.index_in(b.column("terms").flatten(), value_set=names).to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(sizes)), sizes)
            w = w / np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("terms"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(w, pa.float64()))], names=[key, "terms", "weights"])

    return lists.mapInArrow(weigh, f"`{key}` {df.schema[key].dataType.simpleString()}, terms array<string>, weights array<double>").filter(F.size("terms") > 0)


def tfidf(df: DataFrame, key: str = "doc_id", text_col: str = "text", cfg: Config = DEFAULT, low: int | None = None, high: int | None = None) -> DataFrame:
    """(key, term, weight) of tfidf_lists()."""
    return tfidf_lists(df, key, text_col, cfg, low, high).select(key, F.explode(F.arrays_zip("terms", "weights")).alias("x")).select(key, F.col("x.terms").alias("term"), F.col("x.weights").alias("weight"))


def tfidf_keywords(weights: DataFrame, key: str = "doc_id", k: int = DEFAULT.keywords.top_k) -> DataFrame:
    """(key, rank, term, weight to 4 places): the terms of greatest weight, ties by term. weights: of tfidf(), or of tfidf_lists(), which shuffles nothing."""
    if "terms" in weights.columns:
        each = F.transform(F.filter(F.arrays_zip("terms", "weights"), lambda x: x["weights"] > 0), lambda x: F.struct((-F.round(x["weights"], 10)).alias("o"), x["terms"].alias("term"), x["weights"].alias("w")))
        best = weights.select(key, F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("p", "x"))
        return best.select(key, (F.col("p") + 1).alias("rank"), "x.term", F.round("x.w", 4).alias("weight"))
    ranked = weights.filter("weight > 0").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("weight", 10)), "term")))
    return ranked.filter(F.col("rank") <= k).select(key, "rank", "term", F.round("weight", 4).alias("weight"))


def class_tfidf(df: DataFrame, group: str, text_col: str, k: int = DEFAULT.clustering.words_per_topic, low: int = 1, high: int = 1) -> DataFrame:
    """(group, rank, term, weight): class-based weights, tf / words of the group * ln(1 + mean words / frequency of the term)."""
    counts = (
        df.select(F.col(group), F.explode(text.ngrams(text.tokens(F.col(text_col)), low, high)).alias("term"))
        .filter(~F.col("term").isin(*fixed.STOP_WORDS)).groupBy(group, "term").agg(F.count("*").alias("tf"))
    )
    size = counts.groupBy(group).agg(F.sum("tf").alias("words"))
    total = counts.groupBy("term").agg(F.sum("tf").alias("all"))
    mean = size.agg(F.avg("words").alias("mean"))
    w = counts.join(total, "term").join(size, group).crossJoin(F.broadcast(mean)).withColumn("weight", F.col("tf") / F.col("words") * F.log(1 + F.col("mean") / F.col("all")))
    ranked = w.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("weight", 12)), "term")))
    return ranked.filter(F.col("rank") <= k).select(group, "rank", "term", "weight")


def topic_labels(df: DataFrame, group: str, text_col: str, cfg: Config = DEFAULT) -> DataFrame:
    """(group, label): a topic's first words, or the outlier label for -1."""
    top = class_tfidf(df, group, text_col, cfg.clustering.label_words)
    label = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ")
    return top.groupBy(group).agg(label.alias("label")).withColumn("label", F.when(F.col(group).cast("string") == "-1", fixed.OUTLIER_LABEL).otherwise(F.col("label")))


ENTITY_PATTERN = r"(?<![\p{L}\p{N}_])(?:" + "|".join(re.sub(r"([.+#/-])", r"\\\1", t) for t in sorted(fixed.TECHNOLOGIES, key=lambda t: (-len(t), t))) + r")(?![\p{L}\p{N}_])"


def entities(c: Column, terms: list[str] | None = None) -> Column:
    """The sorted distinct dictionary terms in a text, with its capitals; the longest term wins where several begin."""
    pattern = ENTITY_PATTERN if terms is None else r"(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")(?![\p{L}\p{N}_])"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))))


def extend_dictionary(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Terms with those of new that they lack; both have a column term."""
    return terms.select("term").unionByName(new.select("term").distinct().join(terms.select("term"), "term", "left_anti"))


def fuse(signals: DataFrame, key: str = "doc_id", cfg: Config = DEFAULT) -> DataFrame:
    """(key, term, score): reciprocal rank fusion of (key, signal, rank, term).

    Terms are compared trimmed and in lower case; those below min_chars add nothing, though their rank is taken.
    Signals are semantic, local (or tfidf, with its weight) and entities.
    """
    k = cfg.keywords
    weight = F.when(F.col("signal") == "semantic", k.weight_semantic).when(F.col("signal").isin("local", "tfidf"), k.weight_local).otherwise(k.weight_entities)
    t = signals.withColumn("term", F.trim(F.lower("term"))).filter(F.length("term") >= k.min_chars)
    return t.groupBy(key, "term").agg(F.sum(weight / (k.rrf_k + F.col("rank"))).alias("score"))


def select_keywords(fused: DataFrame, entity_terms: DataFrame | None = None, key: str = "doc_id", k: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(key, keywords): by score, ties by term, without any that contains or is contained in one already taken.

    Terms that the filter by part of speech rejects are passed over unless entity_terms (key, term) has them. The
    fold over one document's candidates, a few dozen, stays in the JVM.
    """
    k = k or cfg.keywords.top_k
    ok = valid_phrase(F.col("term")) if cfg.keywords.filter_by_pos else F.lit(True)
    f = fused.withColumn("ok", ok)
    if entity_terms is not None:
        e = entity_terms.select(key, F.trim(F.lower("term")).alias("term")).distinct().withColumn("e", F.lit(True))
        f = f.join(e, [key, "term"], "left").withColumn("ok", F.col("ok") | F.coalesce("e", F.lit(False)))
    lists = f.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("s"), "term", "ok"))).alias("c"))
    taken = F.aggregate(
        "c",
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) >= k) | ~x["ok"] | F.exists(acc, lambda y: y.contains(x["term"]) | x["term"].contains(y)), acc).otherwise(F.array_append(acc, x["term"])),
    )
    return lists.select(key, F.transform(taken, lambda w: text.canonical_case(w)).alias("keywords"))


# Ours: suffixes that speak for a part of speech, longest first; a small lexicon stands in for a linguistic model.
VERB_SUFFIXES = "aríamos|eríamos|iríamos|ábamos|aremos|eremos|iremos|ando|iendo|arse|erse|irse|aron|ieron|aban|ían|amos|emos|imos|ará|erá|irá"
ADVERB_SUFFIX, ADJECTIVE_SUFFIXES = "mente", "oso|osa|osos|osas|ivo|iva|ivos|ivas|able|ables|ible|ibles|ico|ica|icos|icas|al|ales"
FUNCTION_WORDS = fixed.STOP_WORDS


def part_of_speech(w: Column) -> Column:
    """An approximate tag of a lower-case word: FUNC, ADV, VERB, ADJ or NOUN."""
    long = F.length(w) > 4
    return (
        F.when(w.isin(*FUNCTION_WORDS), "FUNC").when(long & w.endswith(ADVERB_SUFFIX), "ADV").when(long & w.rlike(f"(?:{VERB_SUFFIXES})$"), "VERB")
        .when(long & w.rlike(f"(?:{ADJECTIVE_SUFFIXES})$"), "ADJ").otherwise("NOUN")
    )


def lemma(w: Column) -> Column:
    """An approximate lemma: plural endings go."""
    return F.when(F.length(w) > 5, F.regexp_replace(F.regexp_replace(w, "ces$", "z"), "(?<=[lnrdsjzxc])es$|(?<=[aeiouáéíóú])s$", "")).otherwise(w)


def valid_phrase(c: Column) -> Column:
    """At least one noun, and neither end a verb, adverb or function word."""
    tags = F.transform(F.split(c, " "), part_of_speech)
    bad = ("VERB", "ADV", "FUNC")
    return F.array_contains(tags, "NOUN") & ~tags[0].isin(*bad) & ~F.element_at(tags, -1).isin(*bad)


def preprocess(df: DataFrame, text_col: str = "clean_text", cfg: Config = DEFAULT) -> DataFrame:
    """df with tokens, lemmas, lemmas_pos, text_lemmas, text_pos, entities, n_tokens: without stop words, numbers and short tokens."""
    raw = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"[\p{L}\p{N}_+#]+"), F.lit(0))
    low = F.transform(raw, lambda w: F.lower(w))
    kept = F.filter(low, lambda w: (F.length(w) >= cfg.nlp.min_token) & ~w.isin(*fixed.STOP_WORDS) & ~w.rlike(r"^\p{N}+$"))
    pairs = F.filter(F.transform(kept, lambda w: F.struct(w.alias("t"), lemma(w).alias("l"))), lambda x: ~x["l"].isin(*fixed.EXTRA_STOP_WORDS))
    out = df.withColumn("_p", pairs).withColumns(
        {
            "tokens": F.transform("_p", lambda x: x["t"]),
            "lemmas": F.transform("_p", lambda x: x["l"]),
            "lemmas_pos": F.transform(F.filter("_p", lambda x: part_of_speech(x["t"]).isin("NOUN", "ADJ")), lambda x: x["l"]),
            "entities": entities(F.col(text_col)),
        }
    )
    return out.withColumns({"text_lemmas": F.array_join("lemmas", " "), "text_pos": F.array_join("lemmas_pos", " "), "n_tokens": F.size("tokens")}).drop("_p")


def _distance(a: str, b: str) -> int:
    """Levenshtein distance: a column of the table is one number, its steps up and down are bits."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    all_, last, up, down, d = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for x in b:
        eq = at.get(x, 0)
        same = eq | down
        eq = (((eq & up) + up) ^ up) | eq
        more, less = down | (all_ & ~(eq | up)), up & eq
        d += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(same | more)) & all_, more & same & all_
    return d


def _local(sentences: list[list[str]], capitals: list[list[bool]], cfg: Config) -> list[tuple[str, float]]:
    """The terms of one document with their scores, best first: see local_keywords()."""
    c, words, grams = cfg.keywords, {}, Counter()
    for s, (ws, caps) in enumerate(zip(sentences, capitals, strict=True)):
        for p, w in enumerate(ws):
            seen = words.get(w) or words.setdefault(w, ([], [], set(), set()))
            seen[0].append(s)
            seen[1].append(caps[p] and p > 0)
            if p:
                seen[2].add(ws[p - 1])
            if p + 1 < len(ws):
                seen[3].add(ws[p + 1])
        for n in range(1, min(c.ngram_max, 3) + 1):
            grams.update(zip(*(ws[k:] for k in range(n)), strict=False))
    if not words:
        return []
    tfs = [len(x[0]) for x in words.values()]
    mean = sum(tfs) / len(tfs)
    usual, top = mean + math.sqrt(sum((t - mean) ** 2 for t in tfs) / len(tfs)) + 1, max(tfs)
    sents = max(x[0][(len(x[0]) - 1) // 2] for x in words.values()) + 1
    h = {}
    for w, (at, caps, left, right) in words.items():
        tf = len(at)
        related = 1 + (len(left) + len(right)) / (2 * tf) * tf / top
        place = math.log(math.log(3 + at[(tf - 1) // 2]) + 1)
        h[w] = related * place / (sum(caps) / (1 + math.log(tf)) + tf / usual / related + len(set(at)) / sents / related)
    stops, found = frozenset(FUNCTION_WORDS), []
    for g, n in grams.items():
        # of a phrase that ends as it begins, the word between counts as its end
        if g[0] in stops or (g[1] if len(g) == 3 and g[0] == g[2] else g[-1]) in stops or len(term := " ".join(g)) < c.min_chars:
            continue
        score = math.prod(h[w] for w in g) / (n * (1 + sum(h[w] for w in g)))
        found.append((round(score, 12), term, score))
    taken: list[tuple[str, float]] = []
    for _, term, score in sorted(found):
        if len(taken) >= c.candidates:
            break
        for other, _ in taken:
            most = max(len(term), len(other))
            if 1 - abs(len(term) - len(other)) / most > c.dedup_limit and 1 - _distance(term, other) / most > c.dedup_limit:
                break
        else:
            taken.append((term, score))
    return taken


def local_keywords(df: DataFrame, key: str = "doc_id", text_col: str = "text", cfg: Config = DEFAULT) -> DataFrame:
    """(key, rank, term, score): a local statistical score, lower is better, without near-equal terms.

    A word's score combines how often it is capitalised, how early its sentences are, its relative frequency, how
    many different neighbours it has and in how many sentences it stands; a phrase multiplies its words' scores and
    divides by their sum and its frequency. All of it belongs to one document, so nothing is shuffled: words are found
    by expressions, counted in Arrow batches. The key tells rows apart; rows without one are left out.
    """
    raw = F.transform(F.split(F.coalesce(text_col, F.lit("")), r"[.!?\n]+"), lambda x: F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_+#-]{2,}"), F.lit(0)))
    words = df.filter(F.col(key).isNotNull()).select(key, raw.alias("_r"))
    words = words.select(key, F.transform("_r", lambda x: F.transform(x, lambda w: F.lower(w))).alias("w"), F.transform("_r", lambda x: F.transform(x, lambda w: w.rlike(r"^\p{Lu}"))).alias("cap"))

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = [_local(w, cap, cfg) for w, cap in zip(part.column("w").to_pylist(), part.column("cap").to_pylist(), strict=True)]
                keys = part.column(0).take(pa.array([n for n, r in enumerate(rows) for _ in r], pa.int64()))
                ranks = pa.array([k + 1 for r in rows for k in range(len(r))], pa.int32())
                yield pa.RecordBatch.from_arrays([keys, ranks, pa.array([t for r in rows for t, _ in r], pa.string()), pa.array([x for r in rows for _, x in r], pa.float64())], names=[key, "rank", "term", "score"])

    return words.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, rank int, term string, score double")


def semantic_keywords(candidates: DataFrame, documents: DataFrame, key: str = "doc_id", cfg: Config = DEFAULT) -> DataFrame:
    """(key, rank, term, score): maximal marginal relevance over (key, term, vector) candidates and (key, vector) documents.

    Each pick maximises (1 - diversity) * likeness to the document - diversity * greatest likeness to those picked;
    ties go to the lesser term.
    """
    k, lam = cfg.keywords.candidates, cfg.keywords.diversity
    lists = candidates.filter("vector IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", vectors.doubles(F.col("vector")).alias("v")))).alias("c"))
    both = lists.join(documents.filter("vector IS NOT NULL").select(key, vectors.doubles(F.col("vector")).alias("d")), key).select(key, F.col("c.term").alias("terms"), F.col("c.v").alias("v"), "d")

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            at, ranks, terms, found = [], [], [], []
            for n in range(b.num_rows):
                names = b.column("terms")[n].as_py()
                v, d = unit(b.column("v")[n].values.flatten().to_numpy().reshape(len(names), -1)), unit(b.column("d")[n].values.to_numpy())
                sim = v @ d
                order = np.lexsort((np.arange(len(names)), -np.round(sim, 10)))  # terms come sorted
                names, v, sim = [names[i] for i in order], v[order], sim[order]
                same, most, free = np.unique(names, return_inverse=True)[1], np.zeros(len(names)), np.ones(len(names), bool)
                for r in range(k):
                    if not free.any():
                        break
                    p = int(np.where(free, np.round((1 - lam) * sim - lam * most, 12), -np.inf).argmax())
                    free &= same != same[p]
                    near = v @ v[p]
                    most = near if r == 0 else np.maximum(most, near)
                    at.append(n)
                    ranks.append(r + 1)
                    terms.append(names[p])
                    found.append(float(sim[p]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ranks, pa.int32()), pa.array(terms, pa.string()), pa.array(found, pa.float64())], names=[key, "rank", "term", "score"])

    return both.mapInArrow(run, f"`{key}` {both.schema[key].dataType.simpleString()}, rank int, term string, score double")


def compare_keywords(key: str, **signals: DataFrame) -> DataFrame:
    """(key, rank, one column for each signal): the lists side by side, padded with nulls."""
    out = None
    for name, df in signals.items():
        one = df.select(key, "rank", F.col("term").alias(name))
        out = one if out is None else out.join(one, [key, "rank"], "full_outer")
    return out
