"""From raw documents to sampled pieces: quality, line dedup, near-dedup, decontamination, encoding.

Each stage works on all that its predecessor kept, written as Parquet and read again. All but the last return the
columns of documents; where a stage changes text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, linededup, minhash, pieces, quality
from weftline.llm.common import cut, small, table

#: No SQL: a fitted model, signatures and sampled pieces are among the stages.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, does not reject."""
    score = quality.scorer(quality.train(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score(F.coalesce("text", F.lit(""))) >= quality.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; one that loses all its lines stays, empty."""
    columns = [F.col(c) for c in docs.columns]
    out = linededup.dedup_lines(docs).select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id; of rows that agree in doc_id and text, one."""
    found = cut(minhash.near_duplicates(docs), "pipeline-near")
    key = lambda df, a, b: F.col("doc_id").eqNullSafe(df[a]) & (F.xxhash64(F.coalesce("text", F.lit(""))) == df[b])
    lost = found.filter(~F.col("component").eqNullSafe(F.col("_id"))).select("_id", "_h")
    kept = docs.join(small(lost, lost.count()), key(lost, "_id", "_h"), "left_anti")
    twice = found.groupBy("_id", "_h").count().filter("count > 1").select("_id", "_h")
    n = twice.count()
    if n:
        several = kept.join(small(twice, n), key(twice, "_id", "_h"), "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(small(twice, n), key(twice, "_id", "_h"), "left_anti").unionByName(several)
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    ix = decontam.index(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text")
    hit = cut(decontam.exact(ix).select("_id", "_h").distinct(), "pipeline-leaks")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(small(hit, hit.count()), F.col("doc_id").eqNullSafe(hit["_id"]) & (h == hit["_h"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids, lossless."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
