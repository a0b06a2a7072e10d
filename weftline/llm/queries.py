"""Registered queries of the corpus operators, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import collocations, decontam, htmltree, linededup, media, minhash, packing, pieces, quality, resampling, secrets, sharding, urlfilter
from .common import table

SHARD_BYTES = 1 << 20
#: The rules of op11.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


def op3_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_media(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_minhash(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("_id").eqNullSafe(F.col("component")).alias("kept")
    )


def op9_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltree.extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_url_filter(spark, sf_dir):
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))
    return judged.withColumnRenamed("_id", "page_id")


def op12_resampling(spark, sf_dir):
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("_id", "doc_id")


def op13_collocations(spark, sf_dir):
    return collocations.best_phrases(table(spark, sf_dir, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql():
    return {
        "op1_secret_scan": secrets.SQL,
        "op2_sharding": sharding.SQL.format(limit=SHARD_BYTES),
        "op4_line_dedup": linededup.SQL,
        "op8_minhash": minhash.SQL,
        "op9_decontamination": decontam.SQL,
        "op10_html": htmltree.SQL,
        "op11_url_filter": urlfilter.sql(URL_RULES),
        "op12_resampling": resampling.SQL,
        "op13_collocations": collocations.SQL,
    }
