"""Splits, folds and measures, relationally."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..session import ranked, small, stored


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """df with label_index: place among the sorted labels, which are counted before they are broadcast."""
    labels = df.select(label).distinct()
    known = labels.withColumn("label_index", F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(small(known, labels.count()), label)


def _shuffled(df: DataFrame, label: str, key: str) -> DataFrame:
    return ranked(df, label, F.md5(F.col(key).cast("string")), key)


def stratified_split(df: DataFrame, label: str = "label", key: str = "doc_id", cfg: Config = DEFAULT) -> DataFrame:
    """df with split: of each label a test_size share, rounded up but never all, goes to test, by order of md5(key)."""
    s = _shuffled(df, label, key)
    take = F.least(F.ceil(cfg.classification.test_size * F.col("_n")), F.col("_n") - 1)
    return s.withColumn("split", F.when(F.col("_r") <= take, "test").otherwise("train")).drop("_r", "_n")


def folds(df: DataFrame, label: str = "label", key: str = "doc_id", cfg: Config = DEFAULT) -> DataFrame:
    """df with fold: dealt in turn within each label; as many folds as the rarest label allows, null if below two."""
    s = _shuffled(df, label, key)
    least = s.agg(F.least(F.min("_n"), F.lit(cfg.classification.folds)).alias("_k"))
    return s.crossJoin(F.broadcast(least)).withColumn("fold", F.when(F.col("_k") >= 2, F.pmod(F.col("_r") - 1, "_k"))).drop("_r", "_n", "_k")


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n, share of the actual class)."""
    c = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def confused_pairs(df: DataFrame, k: int = 5, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return confusion(df, actual, predicted).filter("actual <> predicted").orderBy(F.desc("share"), "actual", "predicted").limit(k)


def class_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support); 0 where undefined."""
    c = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = c.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("s"), F.lit(0).alias("q")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").cast("int").alias("q")))).alias("x"), "a", "p", "n")
    per = both.groupBy(F.col("x.label").alias("label")).agg(
        F.sum("x.s").alias("support"), F.sum("x.q").alias("guessed"), (F.sum(F.when((F.col("a") == F.col("p")), F.col("n")).otherwise(0)) / 2).alias("hits")
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = per.select("label", ratio(F.col("hits"), F.col("guessed")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), "support")
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, macro and weighted precision, recall and F1."""
    r = class_report(df, actual, predicted)
    wide = r.agg(
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")]
    )
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias("accuracy")).crossJoin(wide)


def top_k_accuracy(scores: DataFrame, k: int = 2, key: str = "doc_id", actual: str = "actual", label: str = "label", score: str = "score") -> DataFrame:
    """One row, top_k: share of rows whose label is among the k best of (key, actual, label, score); null where k takes all classes."""
    r = scores.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), label)))
    n = scores.agg(F.count_distinct(label).alias("_c"))
    hit = r.groupBy(key).agg(F.max(((F.col("_r") <= k) & (F.col(label) == F.col(actual))).cast("int")).alias("h"))
    return hit.agg(F.avg("h").alias("a")).crossJoin(n).select(F.when(F.col("_c") > k, F.col("a")).alias("top_k"))


def brier(scores: DataFrame, key: str = "doc_id", actual: str = "actual", label: str = "label", score: str = "score") -> DataFrame:
    """One row: brier (mean of summed squared errors), log_loss, mean_confidence."""
    hit = (F.col(label) == F.col(actual)).cast("int")
    per = scores.groupBy(key).agg(
        F.sum((F.col(score) - hit) * (F.col(score) - hit)).alias("b"), F.sum(F.when(F.col(label) == F.col(actual), -F.log(F.greatest(F.col(score), F.lit(1e-15))))).alias("l"), F.max(score).alias("m")
    )
    return per.agg(F.avg("b").alias("brier"), F.avg("l").alias("log_loss"), F.avg("m").alias("mean_confidence"))


def clustering_agreement(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information of two labellings, from their contingency counts."""
    c = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("n"))
    two = lambda n: n * (n - 1) / 2
    rows, cols = c.groupBy("x").agg(F.sum("n").alias("r")), c.groupBy("y").agg(F.sum("n").alias("s"))
    total = c.agg(F.sum("n").alias("t"), F.sum(two(F.col("n"))).alias("ij"))
    sr = rows.agg(F.sum(two(F.col("r"))).alias("i2"), F.sum(F.col("r") * F.log("r")).alias("lr"))
    ss = cols.agg(F.sum(two(F.col("s"))).alias("j2"), F.sum(F.col("s") * F.log("s")).alias("ls"))
    mi = c.join(rows, "x").join(cols, "y").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("r") / F.col("s"))).alias("m"))
    t = F.col("t")
    hx, hy = F.log("t") - F.col("lr") / t, F.log("t") - F.col("ls") / t
    expected = F.col("i2") * F.col("j2") / two(t)
    most = (F.col("i2") + F.col("j2")) / 2
    return total.crossJoin(sr).crossJoin(ss).crossJoin(mi).select(
        F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"),
        F.when(hx + hy == 0, 1.0).otherwise(2 * (F.col("m") / t + F.log("t")) / (hx + hy)).alias("nmi"),
    )


def in_order(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: n, breaks (rows whose value is below that of the row before by order), ordered. Neighbours are compared
    within range partitions, then the partitions' ends with one another."""
    p = df.select(F.col(order).alias("_o"), F.col(value).alias("_v")).repartitionByRange("_o").sortWithinPartitions("_o", "_v").withColumn("_p", F.spark_partition_id())
    p = stored(p, "ordered")
    w = Window.partitionBy("_p").orderBy("_o", "_v")
    inside = p.withColumn("_b", F.lag("_v").over(w) > F.col("_v")).groupBy("_p").agg(
        F.count("*").alias("n"), F.count_if("_b").alias("b"), F.min_by("_v", F.struct("_o", "_v")).alias("first"), F.max_by("_v", F.struct("_o", "_v")).alias("last")
    )
    ends = inside.withColumn("e", F.coalesce((F.lag("last").over(Window.orderBy("_p")) > F.col("first")).cast("long"), F.lit(0)))  # one row for each partition
    return ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("b") + F.col("e")), F.lit(0)).alias("breaks")).withColumn("ordered", F.col("breaks") == 0)


def drift_alert(test_score: float, fold_scores: list[float], n_test: int) -> dict:
    """Whether a test score is further from the folds' mean than twice the larger of their deviation and the sampling error."""
    m = sum(fold_scores) / len(fold_scores)
    std = (sum((s - m) ** 2 for s in fold_scores) / len(fold_scores)) ** 0.5
    sampling = (m * (1 - m) / n_test) ** 0.5
    return {"gap": abs(test_score - m), "limit": 2 * max(std, sampling), "alert": abs(test_score - m) > 2 * max(std, sampling)}
