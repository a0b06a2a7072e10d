"""Seeds in turn and pages cut into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..session import ranked


def round_robin(df: DataFrame, category: str = "category", order: str = "id") -> DataFrame:
    """df with turn: each row's 0-based place within its category. Sorting by (turn, category) takes categories in turn."""
    return ranked(df, category, order).withColumn("turn", F.col("_r") - 1).drop("_r", "_n")


def split_sections(df: DataFrame, title: str = "title", body: str = "body", key: str = "id", cfg: Config = DEFAULT) -> DataFrame:
    """(key, part, title, body): blocks of each text that are long enough, at most max_docs_per_seed in order.

    Lines that begin with '==' name the section of those that follow; excluded sections are skipped. A document's
    title is the page's, with the section where it differs. The window is one page, so bounded by a text.
    """
    lines = df.select(F.col(key), F.col(title).alias("_t"), F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n", -1)).alias("_n", "_raw")).withColumn("_x", F.regexp_replace("_raw", r"(?U)^\s+|\s+$", ""))
    head = F.col("_x").startswith("==")
    by_page = Window.partitionBy(key).orderBy("_n")
    named = lines.withColumn(
        "_s", F.coalesce(F.last(F.when(head, F.regexp_replace("_x", r"(?U)^[= ]+|[= ]+$", "")), ignorenulls=True).over(by_page.rowsBetween(Window.unboundedPreceding, 0)), F.col("_t"))
    )
    kept = named.filter(~head & (F.length("_x") >= cfg.validation.corpus_body_min) & ~F.lower("_s").isin(*cfg.corpus.excluded_sections))
    return (
        kept.withColumn("part", F.row_number().over(by_page))
        .filter(F.col("part") <= cfg.corpus.max_docs_per_seed)
        .select(key, "part", F.when(F.col("_s") != F.col("_t"), F.concat("_t", F.lit(" — "), "_s")).otherwise(F.col("_t")).alias("title"), F.col("_x").alias("body"))
    )
