"""Corpus collection from fetched pages, with the fallback table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import reporting, sections
from ..session import small, stored
from . import html, seeds


def collect(seed_rows: DataFrame, pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(seq, turn, part, title, body, category, source): seeds in turn, their fetched pages (url, content) extracted and cut.

    Content of wikipedia rows is plain text with section marks already; that of html rows is markup. Fetching is the
    caller's: this engine reads tables, not the network.
    """
    s = seeds_with_routes(seed_rows, cfg)
    j = sections.round_robin(s, "category", "seq").join(pages.select(F.col("url").alias("_u"), "content"), F.col("url") == F.col("_u"), "left")
    body = F.when(F.col("extractor") == "wikipedia", F.col("content")).otherwise(html.extract(F.when(F.col("extractor") == "html", F.col("content")), F.col("selector") if "selector" in seed_rows.columns else None, cfg))
    parts = sections.split_sections(j.withColumn("_body", body), "readable", "_body", "seq", cfg)
    return parts.join(s.select("seq", "category", F.col("extractor").alias("source")), "seq").join(j.select("seq", "turn"), "seq")


def seeds_with_routes(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return df.withColumns({"extractor": seeds.extractor(df, cfg), "readable": seeds.readable_title(df), "host": seeds.host(F.col("url")) if "url" in df.columns else F.lit(None).cast("string")})


def probe(pages: DataFrame, key: str = "category", order: str = "seq", every: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    """(key, title, chars, verdict) of the first page of each category, or of all.

    Places alone are aggregated, by partial minima; of pages that agree in category and place one is taken.
    """
    if every:
        first = pages
    else:
        least = pages.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.col(order).isNotNull().alias("t"), F.col(order).alias("o"))).alias("_f"))
        least = stored(least, "first-places")
        at = F.col(key).eqNullSafe(F.col("_k")) & F.col(order).eqNullSafe(F.col("_f.o"))
        several = pages.join(small(least, least.count()), at).select("_k", key, "title", "body")
        first = several.groupBy("_k").agg(F.min(F.struct(key, "title", "body")).alias("p")).select("p.*")
    return first.select(key, F.substring("title", 1, 38).alias("title"), F.length("body").alias("chars"), seeds.verdict(F.col("body"), cfg).alias("verdict"))


def or_fallback(corpus: DataFrame, fallback: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The corpus if it is fit for training, else the fallback table."""
    return corpus if reporting.corpus_health(corpus, cfg=cfg).first()["fit"] else fallback
