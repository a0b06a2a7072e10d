"""Streams: documents from a folder are validated and logged as they come. An extension; the logic is the batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..functions import language, text
from ..operators import validation


def analysed(stream: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Status of each document of a stream: all of it is stateless."""
    v = validation.validate(stream, cfg=cfg).withColumn("lang", language.detect(F.col("v_body"), cfg))
    return v.select("doc_id", "v_title", F.coalesce("reason", F.lit("ok")).alias("status"), F.col("lang.code").alias("language"), text.canonical_hash(F.col("v_body")).alias("hash"))


def without_repeats(stream: DataFrame, time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first document of each canonical text within the watermark; state is dropped behind it."""
    return stream.withColumn("hash", text.canonical_hash(F.col("body"))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["hash"])


def log_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet log, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def documents_in(spark: SparkSession, folder: str, schema: str = "doc_id bigint, title string, body string, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of each window, late events up to the delay included."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
