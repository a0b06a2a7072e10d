"""Postings in blocks: for each term the ids of its rows, in runs that no single task has to hold whole.

A term of few ids is one block. The ids of any other are cut where their upper bits change, so a block has at most
2 ** bits of them however frequent its term, and which block may hold an id follows from the id: lists are intersected
by joins on equal (term, block), and blocks that no candidate falls into are never decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids that a block has at most, as a power of two; folders that a saved index is dealt into.
BITS, PARTS = 8, 64


def _part(term: Column, block: Column) -> Column:
    return F.pmod(F.xxhash64(term, block), F.lit(PARTS)).cast("int")


def _block(key: Column, frequent: Column, bits: int) -> Column:
    return F.when(frequent, F.shiftright(key, bits)).otherwise(F.lit(0)).cast("long")


def blocks(pairs: DataFrame, key: str = "doc_id", term: str = "keyword", bits: int = BITS) -> DataFrame:
    """(term, block, first, last, n, offsets, part): the distinct integer ids of each lower-case term, as distances from
    the block's first id in rising order. Rows with a null term or id have no posting; part is where save() puts a block."""
    if pairs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"ids in postings are integers, {key} is not")
    p = pairs.select(F.lower(F.col(f"`{term}`")).alias("term"), F.col(f"`{key}`").cast("long").alias("id")).filter("term IS NOT NULL AND id IS NOT NULL").distinct()
    # blocks as if every term were frequent, then those of the others become one
    cut = p.groupBy("term", F.shiftright("id", bits).alias("block")).agg(F.collect_list("id").alias("ids"))
    sizes = cut.groupBy("term").agg(F.sum(F.size("ids")).alias("all"))
    j = cut.join(sizes, "term").withColumn("frequent", F.col("all") > (1 << bits))
    rest = j.filter("NOT frequent").groupBy("term").agg(F.flatten(F.collect_list("ids")).alias("ids")).select("term", F.lit(0).cast("long").alias("block"), "ids")
    whole = j.filter("frequent").select("term", F.col("block").cast("long").alias("block"), "ids").unionByName(rest)
    s = whole.select("term", "block", F.array_sort("ids").alias("ids")).withColumn("first", F.element_at("ids", 1))
    return s.select("term", "block", "first", F.element_at("ids", -1).alias("last"), F.size("ids").alias("n"), F.transform("ids", lambda x: x - F.col("first")).alias("offsets"), _part(F.col("term"), F.col("block")).alias("part"))


def save(index: DataFrame, path: str) -> None:
    """Blocks as Parquet in PARTS folders, each sorted by term, so that a search opens the folders and row groups it needs."""
    index.repartition("part").sortWithinPartitions("part", "term", "block").write.mode("overwrite").partitionBy("part").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ids(index: DataFrame) -> DataFrame:
    """(term, id): postings one by one."""
    return index.select("term", F.explode(F.transform("offsets", lambda x: x + F.col("first"))).alias("id"))


def intersect(index: DataFrame, queries: DataFrame, bits: int = BITS) -> DataFrame:
    """(query, id) of the ids that have every term of a query. queries: (query, term), terms in any case, repeats count once.

    Candidates are the ids of a query's rarest term (ties by term). Those that fall into one block of another term are
    compared with it at once; there are at most 2 ** bits of them. A query with a term that has no postings has no ids.
    """
    q = queries.select("query", F.lower("term").alias("term")).distinct()
    sizes = index.groupBy("term").agg(F.sum("n").alias("all"))
    t = q.join(sizes, "term", "left").select("query", "term", F.coalesce("all", F.lit(0)).alias("all"))
    w = Window.partitionBy("query")
    t = t.withColumns({"r": F.row_number().over(w.orderBy("all", "term")), "terms": F.count("*").over(w), "least": F.min("all").over(w)}).filter("least > 0")
    found = index.join(t.filter("r = 1").select("query", "term", "terms"), "term")
    candidates = found.select("query", "terms", F.explode(F.transform("offsets", lambda x: x + F.col("first"))).alias("id"))
    alone = candidates.filter("terms = 1").select("query", "id")
    others = t.filter("r > 1").select("query", "term", (F.col("all") > (1 << bits)).alias("frequent"))
    looked = candidates.filter("terms > 1").join(others, "query").withColumn("block", _block(F.col("id"), F.col("frequent"), bits))
    looked = looked.groupBy("query", "terms", "term", "block").agg(F.collect_list("id").alias("some")).withColumn("part", _part(F.col("term"), F.col("block")))
    met = index.join(looked, ["part", "term", "block"]).select("query", "terms", F.array_intersect("some", F.transform("offsets", lambda x: x + F.col("first"))).alias("both"))
    hits = met.select("query", "terms", F.explode("both").alias("id")).groupBy("query", "id").agg(F.count("*").alias("n"), F.first("terms").alias("terms"))
    return alone.unionByName(hits.filter("n = terms - 1").select("query", "id"))
