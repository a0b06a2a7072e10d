"""Reports on corpora, keywords, predictions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..session import small


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def coverage(expected: DataFrame, actual: DataFrame, key: str = "category") -> DataFrame:
    """(key, expected, actual, ratio to 2 places): counts of both sides aligned, 0 where one lacks a key."""
    a, b = expected.groupBy(key).agg(F.count("*").alias("expected")), actual.groupBy(key).agg(F.count("*").alias("actual"))
    j = a.join(b, key, "full_outer").na.fill(0, ["expected", "actual"])
    return j.withColumn("ratio", F.round(F.col("actual") / F.nullif(F.col("expected"), F.lit(0)), 2))


def length_stats(df: DataFrame, col: str = "n_chars") -> DataFrame:
    return df.agg(F.avg(col).alias("mean"), F.sum(col).alias("total"), F.median(col).alias("median"), F.max(col).alias("longest"), F.min(col).alias("shortest"))


def imbalance(df: DataFrame, key: str = "category") -> DataFrame:
    return value_counts(df, key).agg((F.max("n") / F.min("n")).alias("ratio"))


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, purity): the most frequent value of each group, ties by value, and its share."""
    c = df.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    return (
        c.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), value)), "all": F.sum("n").over(w)})
        .filter("r = 1").select(group, value, (F.col("n") / F.col("all")).alias("purity"))
    )


def top_tokens(df: DataFrame, tokens: str, k: int = 20, by: str | None = None) -> DataFrame:
    """(by, rank, token, n): most frequent tokens of all rows or of each group, ties by token."""
    keys = [by] if by else []
    c = df.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    if by:
        r = c.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "token")))
        return r.filter(F.col("rank") <= k).select(by, "rank", "token", "n")
    best = c.orderBy(F.desc("n"), "token").limit(k)  # a heap in each task, k rows from each
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token"))).select("rank", "token", "n")


def vocabulary_overlap(df: DataFrame, tokens: str, group: str = "category", k: int = 40, limit: float = 0.45) -> DataFrame:
    """(a, b, overlap to 3 places, common, high): shared top tokens of each pair of groups, their first six in order."""
    top = top_tokens(df, tokens, k, group)
    a, b = top.select(F.col(group).alias("a"), "token"), top.select(F.col(group).alias("b"), "token")
    pairs = a.join(b, "token").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("token")).alias("t"))
    return pairs.select("a", "b", F.round(F.col("n") / k, 3).alias("overlap"), F.array_join(F.slice("t", 1, 6), ", ").alias("common"), (F.col("n") / k > limit).alias("high"))


def timing(df: DataFrame, name: str = "operation", seconds: str = "seconds", total: str = "[total]") -> DataFrame:
    """(name, seconds, calls, percent): percent to 1 place of the row total, or of all if there is none, greatest first."""
    g = df.groupBy(name).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("calls"))
    base = g.agg(F.coalesce(F.sum(F.when(F.col(name) == total, F.col("seconds"))), F.sum("seconds")).alias("base"))
    return g.crossJoin(F.broadcast(base)).select(name, "seconds", "calls", F.round(100 * F.col("seconds") / F.col("base"), 1).alias("percent"))


def inverted_index(keywords: DataFrame, key: str = "doc_id", term: str = "keyword") -> DataFrame:
    """(term, ids): ordered ids of each lower-case keyword."""
    return keywords.select(F.lower(term).alias("term"), key).distinct().groupBy("term").agg(F.array_sort(F.collect_list(key)).alias("ids"))


def corpus_health(df: DataFrame, category: str = "category", cfg: Config = DEFAULT) -> DataFrame:
    """One row: n_docs, n_categories, least, most, problems (array), fit (enough categories, rows in each, documents)."""
    s = value_counts(df.filter(F.col(category).isNotNull()), category).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.count("*").alias("n_categories"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most")
    )
    n, least = F.col("n_categories"), F.col("least")
    problems = F.array_compact(
        F.array(
            F.when(n < 2, "fewer than two categories"), F.when(n == 2, "two categories only"), F.when((n > 0) & (least < 2), "a category with one document"),
            F.when((n > 0) & (least < cfg.classification.folds), "a category with fewer documents than folds"), F.when(F.col("n_docs") < cfg.corpus.min_documents, "too few documents"),
            F.when((n >= 2) & (F.col("most") / F.greatest(least, F.lit(1)) > 2), "imbalanced"),
        )
    )
    return s.withColumns({"problems": problems, "fit": (n >= cfg.corpus.min_categories) & (least >= 2) & (F.col("n_docs") >= cfg.corpus.min_documents)})


def cluster_vote(df: DataFrame, cluster: str = "cluster", topic: str = "topic") -> DataFrame:
    """(cluster, voted): the most frequent topic of each cluster but -1, ties by topic."""
    return dominant(df.filter(F.col(topic) != -1), cluster, topic).select(cluster, F.col(topic).alias("voted"))


def rescue_outliers(df: DataFrame, cluster: str = "cluster", topic: str = "topic") -> DataFrame:
    """df with topic_final and approximate: outliers take the vote of their cluster; votes are counted before they are broadcast."""
    vote = cluster_vote(df, cluster, topic)
    j = df.join(small(vote, vote.count()), cluster, "left")
    return j.withColumns({"topic_final": F.when(F.col(topic) == -1, F.coalesce("voted", F.lit(-1))).otherwise(F.col(topic)), "approximate": (F.col(topic) == -1) & F.col("voted").isNotNull()}).drop("voted")


def lexical_reduction(df: DataFrame) -> DataFrame:
    """Mean counts of words, kept tokens and tokens kept by part of speech."""
    return df.agg(F.avg("n_words").alias("raw"), F.avg("n_tokens").alias("without_stop_words"), F.avg(F.size("lemmas_pos")).alias("by_pos"))


def outcomes(df: DataFrame, failed: Column, positive: Column) -> DataFrame:
    """One row: errors, total, positive (share of the rows where it holds)."""
    return df.agg(F.sum(failed.cast("long")).alias("errors"), F.count("*").alias("total"), F.avg(positive.cast("int")).alias("positive"))


def hit_rate(df: DataFrame, group: str, hit: str) -> DataFrame:
    """(group, total, hits, pct to 1 place)."""
    g = df.groupBy(group).agg(F.count("*").alias("total"), F.sum(hit).alias("hits"))
    return g.withColumn("pct", F.round(100.0 * F.col("hits") / F.col("total"), 1))


def size_and_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean to 1 place)."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 1).alias("mean"))


def confident_errors(df: DataFrame, titles: DataFrame, hit: str, score: str, key: str = "doc_id", limit: float = 0.6, k: int = 5) -> DataFrame:
    """The k misses with the highest scores above limit that have a title (ties by key), with their rows of titles."""
    missed = df.filter((F.col(hit) == 0) & (F.col(score) > limit))
    return missed.join(titles, key).orderBy(F.desc(score), key).limit(k)


def frequent_keywords(df: DataFrame, keyword: str = "keyword", k: int = 10) -> DataFrame:
    """(keyword, documents): most frequent first, ties by keyword. df has one row for each document and keyword."""
    return df.groupBy(keyword).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), keyword).limit(k)


def dataset_hash(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row, digest: SHA-256 over the rows' digests in order of key.

    A row is its columns in order of name, each as name=length in bytes:text, or name=null. Rows are digested in
    parallel; what is ordered is 64 characters a row, within 4096 buckets by the key's MD5, which are digested first.
    """
    cell = lambda c: F.coalesce(F.concat(F.lit(f"{c}="), F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit(f"{c}=null"))
    row = F.sha2(F.concat_ws(";", *[cell(c) for c in sorted(df.columns)]), 256)
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int")
    b = df.select(bucket.alias("b"), F.col(key).alias("k"), row.alias("d"))
    per = b.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))
