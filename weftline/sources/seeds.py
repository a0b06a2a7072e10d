"""Seed files: reading, checking, routing and probing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..config import DEFAULT, Config
from ..functions import language
from ..functions.text import safe_cell

# Column names of the two shapes of seed files.
NAMES = {"categoria": "category", "titulo": "title", "fuente": "source", "idioma": "language", "titulo_wikipedia": "wiki_title", "url": "url", "selector": "selector"}


def read_seeds(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV seed files of either shape as one table; columns that a file lacks are null.

    Each row has its place seq, unique over all files and rising in their order.
    """
    out = None
    for p in paths:
        header = spark.read.option("header", True).csv(p)
        df = header.select(*[F.col(f"`{c}`").alias(NAMES.get(c, c)) for c in header.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    # partitions of a union follow one another, so the numbers do as well
    return out.withColumn("seq", F.monotonically_increasing_id())


def _cell(df: DataFrame, name: str) -> Column:
    return safe_cell(F.col(name)) if name in df.columns else F.lit("")


def problems(df: DataFrame) -> DataFrame:
    """(seq, problem): one row for each fault; a table without needed columns gives one row with seq -1."""
    spark = df.sparkSession
    if "category" not in df.columns:
        return spark.createDataFrame([(-1, "missing column category")], "seq bigint, problem string")
    if not {"url", "wiki_title"} & set(df.columns):
        return spark.createDataFrame([(-1, "missing columns url and wiki_title")], "seq bigint, problem string")
    source, url, wiki = F.lower(_cell(df, "source")), _cell(df, "url"), _cell(df, "wiki_title")
    found = F.array_compact(
        F.array(
            F.when((source == "wikipedia") & (wiki == "") & ~url.contains("/wiki/"), "wikipedia without title or /wiki/ address"),
            F.when(source.isin("html", "") & (url == ""), "html without url"),
        )
    )
    return df.select("seq", F.explode(found).alias("problem"))


def wiki_title_of_url(url: Column) -> Column:
    """What follows the first '/wiki/', decoded, with spaces for underscores; '' where there is none."""
    at = F.instr(url, "/wiki/")
    tail = F.substring(url, at + 6, F.length(url))
    # a plus is a plus in a path
    return F.when(at > 0, F.trim(F.translate(F.coalesce(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), tail), "_", " "))).otherwise("")


def extractor(df: DataFrame, cfg: Config = DEFAULT) -> Column:
    """Which extractor reads a row: its source, or wikipedia if it has a wiki title; unknown ones take the default."""
    named = F.lower(_cell(df, "source"))
    guessed = F.when(named != "", named).when(_cell(df, "wiki_title") != "", "wikipedia").otherwise(cfg.corpus.default_extractor)
    return F.when(guessed.isin("wikipedia", "html"), guessed).otherwise(cfg.corpus.default_extractor)


def wiki_title(df: DataFrame) -> Column:
    own = _cell(df, "wiki_title")
    return F.when(own != "", own).otherwise(wiki_title_of_url(_cell(df, "url")))


def readable_title(df: DataFrame) -> Column:
    """Title, else wiki title, else the last part of the address with spaces, else the address."""
    url = _cell(df, "url")
    last = F.translate(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), "-_", "  ")
    return F.coalesce(*[F.when(x != "", x) for x in (_cell(df, "title"), _cell(df, "wiki_title"), last)], url)


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def verdict(body: Column, cfg: Config = DEFAULT) -> Column:
    """What a probe says of a page's text."""
    code = F.when(F.length(body) > 50, language.detect(body, cfg)["code"]).otherwise("—")
    none, little, tongue, ok = fixed.VERDICTS
    return (
        F.when(F.coalesce(body, F.lit("")) == "", none)
        .when(F.length(body) < cfg.corpus.min_page_chars, little)
        .when(~code.isin(*cfg.language.supported), F.concat(F.lit(tongue), F.upper(code)))
        .otherwise(ok)
    )
