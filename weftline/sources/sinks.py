"""Stores: tables with upsert, logs, vectors, manifests, model metadata and versions."""

from __future__ import annotations

import json
import platform
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, Config


class Store:
    """The relational store: six Parquet tables under a folder, each version of a table in a folder of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _whole(self, name: str) -> list[str]:
        """Names of the folders of a table that are written out: vN for versions, vN-batch for what was appended to one."""
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        return [x.getName() for x in found if x.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]

    def _versions(self, name: str) -> list[int]:
        return sorted(int(x[1:]) for x in self._whole(name) if x[1:].isdigit())

    def read(self, name: str) -> DataFrame:
        """The newest version of a table and what was appended to it."""
        schema, v = schemas.TABLES[name], self._versions(name)
        now = f"v{v[-1]}" if v else "v0"
        paths = [f"{self.root}/{name}/{x}" for x in self._whole(name) if x == now or x.startswith(now + "-")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _cast(self, name: str, df: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], schemas.TABLES[name]).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def replace(self, name: str, df: DataFrame) -> None:
        """The table becomes df; readers see the old version until the new one is whole."""
        self._write(name, df, set())

    def _write(self, name: str, df: DataFrame, folded: set[str]) -> None:
        v = self._versions(name)
        new = (v[-1] if v else 0) + 1
        self.spark.createDataFrame([(b,) for b in sorted(folded)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/folded-v{new}")
        self._cast(name, df).write.parquet(f"{self.root}/{name}/v{new}")

    def upsert(self, name: str, df: DataFrame, key: str = "doc_id", order: str | None = None) -> None:
        """Rows of df replace those of the same key. Of several rows of a key in df the last by order stays, ties and
        batches without order by the greatest JSON."""
        names = [f"`{c}`" for c in df.columns]
        row = F.struct(*names)
        rank = F.struct(F.col(order), F.to_json(row)) if order else F.to_json(row)
        new = self._cast(name, df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, rank).alias("_row")).select("_row.*"))
        old = self.read(name)
        v = self._versions(name)
        now = v[-1] if v else 0
        folded = self._folded(name, now) | {x.split("-", 1)[1] for x in self._whole(name) if x.startswith(f"v{now}-")}
        self._write(name, new.unionByName(old.join(new.select(key), key, "left_anti")), folded)

    def append(self, name: str, df: DataFrame, batch: str | None = None) -> None:
        """Adds rows as a folder of their own. A batch with a name replaces what an earlier try of that name left, and is
        not written again once an upsert has folded it in; a replace begins anew."""
        v = self._versions(name)
        now = v[-1] if v else 0
        if batch and batch in self._folded(name, now):
            return
        self._cast(name, df).write.mode("overwrite").parquet(f"{self.root}/{name}/v{now}-{batch or uuid.uuid4().hex}")

    def _folded(self, name: str, version: int) -> set[str]:
        """Names of the batches that upserts have folded into a version."""
        jvm, fs = self._fs()
        path = f"{self.root}/{name}/folded-v{version}"
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            return set()
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(path).collect()}

    def register_views(self) -> None:
        for name in schemas.TABLES:
            self.read(name).createOrReplaceTempView(name)


def version_scores(versions: DataFrame, path: str = "$.f1_macro") -> DataFrame:
    """(version, fecha, f1): the score of each version in time, from its metrics as JSON."""
    return versions.select("version", "fecha", F.get_json_object("metricas_json", path).cast("double").alias("f1")).orderBy("fecha", "version")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def load_vectors(df: DataFrame, path: str) -> DataFrame:
    """Drops and recreates the vector table: doc_id, embedding, text, title, category, language, topic, cluster, source."""
    names = ["doc_id", "embedding", "text", "title", "category", "language", "topic", "cluster", "source"]
    df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in names]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def manifest(spark: SparkSession, path: str, exclude: str = r"/(_SUCCESS|\.|_)[^/]*$") -> DataFrame:
    """(path, bytes, sha256) of all files under a folder but the excluded ones, read where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(~F.col("path").rlike(exclude)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def to_fetch(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of a manifest that a local listing lacks or has with another size or digest."""
    have = present.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("h"))
    return wanted.join(have, "path", "left").filter(F.col("b").isNull() | (F.col("b") != F.col("bytes")) | (F.col("h") != F.col("sha256"))).select("path", "bytes", "sha256")


def metadata(spark: SparkSession, cfg: Config, model: dict, metrics: dict, dataset: dict, stamp: str) -> DataFrame:
    """One row of six blocks as JSON: version, model, parameters, metrics, dataset, environment."""
    blocks = {
        "version": {"version": cfg.version, "date": stamp, "fingerprint": cfg.fingerprint()}, "model": model, "parameters": json.loads(cfg.to_json()), "metrics": metrics, "dataset": dataset,
        "environment": {"python": platform.python_version(), "spark": spark.version},
    }
    return spark.createDataFrame([tuple(json.dumps(v, sort_keys=True) for v in blocks.values())], ", ".join(f"{k} string" for k in blocks))


def version_row(spark: SparkSession, cfg: Config, kind: str, dataset: str, digest: str, n: int, metrics: dict, stamp: str) -> DataFrame:
    row = (cfg.version, stamp, cfg.fingerprint(), kind, dataset, digest, n, cfg.to_json(), json.dumps(metrics, sort_keys=True))
    return spark.createDataFrame([row], schemas.MODEL_VERSIONS)


def audit_rows(responses: DataFrame, stamp: Column, latency_ms: Column, version: str) -> DataFrame:
    """Prediction log rows of analysed documents; ids are unique, not dense."""
    good = responses.filter("error IS NULL")
    return good.select(
        F.monotonically_increasing_id().alias("id"), stamp.alias("fecha"), F.col("title").alias("titulo"), F.col("category").alias("categoria"), F.col("probability").alias("probabilidad"),
        F.col("low_confidence").cast("int").alias("confianza_baja"), F.col("language.code").alias("idioma"), F.array_join("keywords", ", ").alias("keywords"), latency_ms.alias("latencia_ms"),
        F.lit(version).alias("version_modelo"),
    )


class Timings:
    """Durations of named steps, as rows for reporting.timing()."""

    def __init__(self):
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def step(self, name: str):  # noqa: ANN201
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - began))

    def to_df(self, spark: SparkSession, cfg: Config = DEFAULT) -> DataFrame:
        return spark.createDataFrame(self.rows, "operation string, seconds double")
