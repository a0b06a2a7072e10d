"""Classifiers, calibration, explanation, clustering and topics on pyspark.ml."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..config import DEFAULT, Config
from ..functions import text
from ..session import small, stored
from . import evaluation, keywords, reporting
from .density import DensityTopics

#: Rows that one task of a training step takes, where there are no more partitions than that.
TRAIN_ROWS = 8_192


def sparse_features(weights: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, features): sparse vectors of (key, term, weight) over (term, index); the vocabulary is bounded, so it is broadcast."""
    j = weights.join(F.broadcast(vocab), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("p"))
    return as_features(j.select(key, F.transform("p", lambda x: x["index"]).alias("i"), F.transform("p", lambda x: x["weight"]).alias("x")), vocab.count(), key)


def as_features(rows: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(key, features): sparse vectors of (key, i, x), rising indices and their weights; empty lists are zeros throughout."""
    # the fields of a sparse vector, written as such and read as vectors: no row passes Python
    fields = [F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("i").cast("array<int>").alias("indices"), F.col("x").cast("array<double>").alias("values")]
    rows = rows.select(key, F.struct(*fields).alias("features"))
    return stored(rows, "features", StructType([rows.schema[key], StructField("features", VectorUDT())]))


def index_terms(vocab: DataFrame) -> DataFrame:
    """(term, index) of a bounded vocabulary, in order of terms."""
    return vocab.select("term").distinct().withColumn("index", F.row_number().over(Window.orderBy("term")) - 1)


def balanced_weights(df: DataFrame, label: str = "label_index") -> DataFrame:
    """df with class_weight = rows / (classes * rows of the class)."""
    per = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = per.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    w = per.crossJoin(total).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("class_weight"))
    return df.join(small(w, w.count()), label)


def train(df: DataFrame, features: str = "features", label: str = "label_index", cfg: Config = DEFAULT) -> LogisticRegressionModel:
    """Multinomial logistic regression with balanced classes; C becomes regParam = 1 / (C * rows)."""
    c = cfg.classification
    n = max(df.count(), 1)
    lr = LogisticRegression(featuresCol=features, labelCol=label, weightCol="class_weight", family="multinomial", standardization=False, elasticNetParam=0.0, regParam=1 / (c.c * n), maxIter=c.max_iter, tol=1e-6)
    rows = balanced_weights(df, label).select(features, label, "class_weight")
    return lr.fit(rows.coalesce(-(-n // TRAIN_ROWS)))  # a step is short, so few rows are not dealt over many tasks


def scores(model: LogisticRegressionModel, df: DataFrame, labels: list[str], key: str = "doc_id") -> DataFrame:
    """(other columns, label, score): one row for each class."""
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    names = F.array(*[F.lit(x) for x in labels])
    return out.select(*[c for c in df.columns if c not in ("features",)], F.posexplode("_p").alias("_i", "score")).withColumn("label", names[F.col("_i")]).drop("_i")


def select_model(f1_lexical: float, f1_semantic: float) -> str:
    """The semantic model wins ties on macro F1."""
    return "semantic" if f1_semantic >= f1_lexical else "lexical"


def out_of_fold(df: DataFrame, labels: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """(doc_id, actual, label, score): each row scored by the model of the other folds. df has label, label_index, features, fold."""
    n = df.agg(F.max("fold")).first()[0]
    if n is None:
        raise ValueError("too few rows in a class for cross-validation")
    out = None
    for k in range(int(n) + 1):
        m = train(df.filter(F.col("fold") != k), cfg=cfg)
        s = scores(m, df.filter(F.col("fold") == k).select("doc_id", F.col("label").alias("actual"), "features"), labels)
        out = s if out is None else out.unionByName(s)
    return out


def cross_validate(df: DataFrame, labels: list[str], cfg: Config = DEFAULT) -> list[float]:
    """Macro F1 of each fold."""
    s = out_of_fold(df, labels, cfg).join(df.select("doc_id", "fold"), "doc_id")
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "label"))).filter("r = 1")
    best = stored(best.select("fold", "actual", F.col("label").alias("predicted")), "folds")
    return [evaluation.metrics(best.filter(F.col("fold") == k)).first()["f1_macro"] for (k,) in best.select("fold").distinct().orderBy("fold").collect()]


def calibrate(held: DataFrame) -> dict[str, tuple[float, float]]:
    """For each label (slope, intercept) of a sigmoid over log-odds, fitted on (actual, label, score) held out of training."""
    logit = F.log(F.greatest("score", F.lit(1e-9)) / F.greatest(1 - F.col("score"), F.lit(1e-9)))
    rows = held.withColumns({"features": array_to_vector(F.array(logit)), "hit": (F.col("actual") == F.col("label")).cast("double")})
    out = {}
    for (name,) in rows.select("label").distinct().orderBy("label").collect():  # one fit for each class
        m = LogisticRegression(labelCol="hit", maxIter=100).fit(rows.filter(F.col("label") == name))
        out[name] = (float(m.coefficients[0]), float(m.intercept))
    return out


def calibrated(s: DataFrame, sigmoids: dict[str, tuple[float, float]], key: str = "doc_id") -> DataFrame:
    """s with scores through the sigmoids, summing to one for each key."""
    a = F.create_map(*[F.lit(x) for k, (v, _) in sigmoids.items() for x in (k, v)])
    b = F.create_map(*[F.lit(x) for k, (_, v) in sigmoids.items() for x in (k, v)])
    logit = F.log(F.greatest("score", F.lit(1e-9)) / F.greatest(1 - F.col("score"), F.lit(1e-9)))
    raw = 1 / (1 + F.exp(-(a[F.col("label")] * logit + b[F.col("label")])))
    return s.withColumn("_s", raw).withColumn("score", F.col("_s") / F.sum("_s").over(Window.partitionBy(key))).drop("_s")


def adopt_calibration(before: DataFrame, after: DataFrame, key: str = "doc_id") -> bool:
    """Only if the Brier score improves."""
    return evaluation.brier(after, key).first()["brier"] < evaluation.brier(before, key).first()["brier"]


def global_explanation(model: LogisticRegressionModel, vocab: DataFrame, labels: list[str], k: int = DEFAULT.classification.terms_per_class) -> DataFrame:
    """(label, rank, term, coefficient): greatest coefficients of each class; the matrix is classes by a bounded vocabulary."""
    spark = vocab.sparkSession
    m = model.coefficientMatrix.toArray()
    rows = spark.createDataFrame([(labels[i], int(j), float(m[i, j])) for i in range(m.shape[0]) for j in m[i].argsort()[::-1]], "label string, index int, coefficient double")
    r = rows.join(F.broadcast(vocab), "index").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("coefficient"), "term")))
    return r.filter(F.col("rank") <= k).select("label", "rank", "term", "coefficient")


def ablation_inputs(df: DataFrame, terms: str = "keywords", body: str = "text", key: str = "doc_id", cfg: Config = DEFAULT) -> DataFrame:
    """(key, term, body without it) for the first terms of each row, but those whose removal changes nothing."""
    t = df.select(key, body, F.explode(F.slice(terms, 1, cfg.service.ablation_terms)).alias("term"))
    return t.withColumn("without", text.without_term(F.col(body), F.col("term"))).filter(F.trim("without") != F.trim(body)).select(key, "term", F.col("without").alias(body))


def ablation(base: DataFrame, without: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, contribution to 4 places, sign): what each term adds to the probability of the predicted label.

    base has (key, label, score) of each row's prediction, without (key, term, label, score) of the ablated texts.
    Terms in favour come first, greatest first; then those against, least first.
    """
    j = without.join(base.select(key, "label", F.col("score").alias("p0")), [key, "label"])
    c = j.select(key, "term", F.round(F.col("p0") - F.col("score"), 4).alias("contribution")).filter("contribution <> 0")
    w = Window.partitionBy(key, F.signum("contribution")).orderBy(F.desc(F.abs("contribution")), "term")
    return c.select(key, "term", "contribution", F.when(F.col("contribution") > 0, "for").otherwise("against").alias("sign"), F.row_number().over(w).alias("rank"))


def _added(df: DataFrame, work) -> list:  # noqa: ANN001
    """work(rows as a matrix, their hashes) for blocks of df (x, h), a list of arrays, added up over all blocks.

    Each task adds up its own, then tasks add up by place in the list, in order of the first ones' numbers: the driver gets
    one sum, however many tasks there are.
    """

    def run(batches):  # noqa: ANN001, ANN202
        total = None
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            h = b.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, b.num_rows, 1024):
                part = work(x[i : i + 1024], h[i : i + 1024])
                total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([pickle.dumps(p) for p in total], pa.binary())], names=["i", "t", "p"])

    def add(batches):  # noqa: ANN001, ANN202
        found = sorted((i, t, p) for b in batches for i, t, p in zip(*(c.to_pylist() for c in b.columns), strict=True))
        total: dict = {}
        for i, _, p in found:
            p = pickle.loads(p)  # noqa: S301
            total[i] = total[i] + p if i in total else p
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pickle.dumps(p) for p in total.values()], pa.binary())], names=["i", "p"])

    parts = df.mapInArrow(run, "i int, t int, p binary").repartition(2, "i").mapInArrow(add, "i int, p binary")  # what it moves follows tasks and models, not rows
    return [pickle.loads(r["p"]) for r in sorted(parts.collect(), key=lambda r: r["i"])]  # noqa: S301


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from a row's hash and the salt alone."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / 2**53


def _candidates(df: DataFrame, seeds: list[int], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each seed (points, weights): k-means|| with two rounds and 2 * most points a round, all seeds in the same scans."""
    first = df.agg(*[F.min_by("x", F.xxhash64("h", F.lit(s))).alias(f"s{s}") for s in seeds]).first()
    found = [np.array([first[f"s{s}"]]) for s in seeds]
    for step in range(2):
        cost = _added(df, lambda x, _: [np.array([_squares(x, c).min(1).sum() for c in found])])[0]

        def draw(x, h, step=step, cost=cost):  # noqa: ANN001, ANN202
            out = []
            for i, s in enumerate(seeds):
                d = _squares(x, found[i]).min(1)
                out.append({x[j].tobytes() for j in np.flatnonzero(_uniform(h, 2 * s + step) * cost[i] < 2 * most * d)})
            return [_Sets(out)]

        drawn = _added(df, draw)[0]
        for i in range(len(seeds)):
            more = sorted(drawn.sets[i])
            if more:
                found[i] = np.vstack([found[i], *[np.frombuffer(m) for m in more]])
    weigh = lambda x, _: [np.bincount(_squares(x, c).argmin(1), minlength=len(c)).astype(float) for c in found]
    return list(zip(found, _added(df, weigh), strict=True))


class _Sets:
    """Sets that are added up one by one."""

    def __init__(self, sets):  # noqa: ANN001
        self.sets = list(sets)

    def __add__(self, other: _Sets) -> _Sets:
        return _Sets([a | b for a, b in zip(self.sets, other.sets, strict=True)])


def _start(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres by weighted k-means++ over candidates, then Lloyd steps among them."""
    rng = np.random.default_rng([seed, k])
    at = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(at) < k:
        d = weights * _squares(points, points[at]).min(1)
        at.append(int(rng.choice(len(points), p=d / d.sum())) if d.sum() > 0 else at[0])
    c = points[at]
    for _ in range(30):
        near = _squares(points, c).argmin(1)
        w = np.bincount(near, weights, k)
        sums = np.stack([np.bincount(near, weights * col, k) for col in points.T], 1)
        c = np.where(w[:, None] > 0, sums / np.maximum(w, 1e-300)[:, None], c)
    return c


def _assigned(centres: np.ndarray):  # noqa: ANN202
    """Work for _added: rows, sums, sums of squares and the inertia by cluster of (models, k, columns) centres."""
    m, k, width = centres.shape

    def work(x, _):  # noqa: ANN001, ANN202
        d = _squares(x, centres.reshape(m * k, width)).reshape(len(x), m, k)
        one = (d.argmin(2)[:, :, None] == np.arange(k)).reshape(len(x), m * k).astype(float)
        return [one.sum(0).reshape(m, k), (one.T @ x).reshape(m, k, width), (one.T @ (x * x).sum(1)).reshape(m, k), d.min(2).sum(0)]

    return work


def _silhouettes(centres: dict, stats: dict):  # noqa: ANN202
    """Work for _added: the sum of squared-distance silhouettes for each k, from each cluster's rows, sum and sum of squares."""

    def work(x, _):  # noqa: ANN001, ANN202
        out, own = [], np.arange(len(x))
        for k, c in centres.items():
            n, sums, squares = stats[k]
            a = _squares(x, c).argmin(1)
            total = np.maximum((x * x).sum(1)[:, None] * n - 2 * (x @ sums.T) + squares, 0)  # to all rows of each cluster
            inside = total[own, a] / np.maximum(n[a] - 1, 1)
            other = np.where(n > 0, total / np.maximum(n, 1), np.inf)
            other[own, a] = np.inf
            outside = other.min(1)
            most = np.maximum(inside, outside)
            good = (n[a] > 1) & np.isfinite(outside) & (most > 0)
            out.append(((outside - inside) / np.where(good, most, 1))[good].sum())
        return [np.array(out)]

    return work


def kmeans_sweep(df: DataFrame, features: str = "features", cfg: Config = DEFAULT) -> tuple[DataFrame, int]:
    """((k, inertia, silhouette), best k): every k the settings allow, the best of n_init seeds by inertia; none, and 0, for
    tables of fewer than three rows.

    The fits of all k and seeds take their steps in the same scans, each until its centres rest or 300 steps are done.
    """
    c = cfg.clustering
    spark = df.sparkSession
    x = df.select(vector_to_array(features).alias("x"))
    x = x.select("x", F.xxhash64("x").alias("h")).coalesce(max(spark.sparkContext.defaultParallelism, 1)).persist()  # scanned once for every step
    n = x.count()
    ks = range(c.k_min, min(c.k_max, max(2, n // 5), n - 1) + 1)
    seeds = [cfg.seed + s for s in range(max(1, c.n_init))]
    start = _candidates(x, seeds, max(ks, default=2)) if len(ks) else []
    centres = {k: np.stack([_start(*start[i], k, s) for i, s in enumerate(seeds)]) for k in ks}
    moving = {k: np.arange(len(seeds)) for k in ks}
    for _ in range(300):
        moving = {k: m for k, m in moving.items() if len(m)}
        if not moving:
            break
        works = [_assigned(centres[k][m]) for k, m in moving.items()]
        got = iter(_added(x, lambda b, h, works=works: [a for w in works for a in w(b, h)]))
        for k, m in moving.items():
            size, sums, _, _ = (next(got) for _ in range(4))
            new = np.where(size[:, :, None] > 0, sums / np.maximum(size, 1)[:, :, None], centres[k][m])
            rest = ((new - centres[k][m]) ** 2).sum(2).max(1) <= 1e-8
            centres[k][m] = new
            moving[k] = m[~rest]
    rows = []
    if len(ks):
        works = [_assigned(centres[k]) for k in ks]
        got = iter(_added(x, lambda b, h: [a for w in works for a in w(b, h)]))
        best, stats, inertia = {}, {}, {}
        for k in ks:
            size, sums, squares, cost = (next(got) for _ in range(4))
            i = int(cost.argmin())
            best[k], stats[k], inertia[k] = centres[k][i], (size[i], sums[i], squares[i]), float(cost[i])
        total = _added(x, _silhouettes(best, stats))[0]
        rows = [(k, inertia[k], float(t / n)) for k, t in zip(ks, total, strict=True)]
    x.unpersist()
    best_k = max(rows, key=lambda r: r[2])[0] if rows else 0
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double"), best_k


def cluster(df: DataFrame, k: int, features: str = "features", cfg: Config = DEFAULT) -> DataFrame:
    return KMeans(k=k, seed=cfg.seed, featuresCol=features, maxIter=50).fit(df).transform(df).withColumnRenamed("prediction", "cluster")


def project(df: DataFrame, k: int = 2, features: str = "features") -> tuple[DataFrame, list[float]]:
    """(df with pca, explained shares): principal components of centred features."""
    centred = StandardScaler(inputCol=features, outputCol="_c", withMean=True, withStd=False).fit(df).transform(df)
    m = PCA(k=k, inputCol="_c", outputCol="pca").fit(centred)
    return m.transform(centred).drop("_c"), [float(x) for x in m.explainedVariance]


def topics(df: DataFrame, features: str = "features", cfg: Config = DEFAULT, key: str = "doc_id") -> DataFrame:
    """df with topic: density clusters in a space of few components; what lies outside of all is -1.

    Topics are numbered from 0 by falling size; the least size follows the rows, within the settings.
    """
    c = cfg.clustering
    n = df.count()
    reduced = project(df, min(c.components, df.first()[features].size), features)[0] if n > 1 else df.withColumn("pca", F.col(features))
    found = DensityTopics.fit(reduced.select(key, vector_to_array("pca").alias("vector")), max(c.topic_size_floor, n // c.topic_size_divisor), item_id=key, seed=cfg.seed)
    labels = found.labels.select(F.col("id").alias(key), "topic")
    return df.join(labels, key, "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))


def describe_topics(df: DataFrame, cluster_col: str = "cluster", topic_col: str = "topic", text_col: str = "text", cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(rows with rescued topics, labels of topics)."""
    rescued = reporting.rescue_outliers(df, cluster_col, topic_col) if cfg.clustering.rescue_outliers else df.withColumns({"topic_final": F.col(topic_col), "approximate": F.lit(False)})
    return rescued, keywords.topic_labels(rescued, "topic_final", text_col, cfg)


def save_model(model, path: str) -> None:  # noqa: ANN001
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
