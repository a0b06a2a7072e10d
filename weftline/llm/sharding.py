"""Sharding by extendible hashing.

A directory of hash prefixes starts as one bucket. Only buckets whose bytes exceed the limit split on
their next hash bit, until every shard fits. The first 32 bits of the hash come from the key and the next
28 from the content, so a hot key is divided as well. Sizes are rolled up at most STEP bits at a time and
only beneath buckets that are still too large, so a level's directory has at most 2**STEP rows for each
open bucket; the documents themselves take part in one partial aggregation for each level that exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

BITS, STEP = 60, 12


def hash_bits(key: Column, content: Column) -> Column:
    """60 bits: 32 of md5(key), then 28 of md5(content). A null counts as the text of a single NUL."""
    nul = F.lit("\x00")
    part = lambda c, n: F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), nul)), 1, n), 16, 10).cast("long")
    return F.shiftleft(part(key, 8), 28).bitwiseOR(part(content, 7))


def assign_shards(df: DataFrame, key: str = "doc_id", content: str = "text", max_bytes: int = 1 << 20) -> DataFrame:
    """One row for each row of df: key, n_bytes, shard_id, shard_depth, shard_bytes, oversize.

    shard_id is the bucket's bit string ('' for the undivided root). A null content has 0 bytes. Rows that
    agree in key and content cannot be told apart, so they share a shard; where such rows, or one row alone,
    exceed the limit, their shard has depth 60 and oversize is true. An empty table gives no rows.
    """
    return _assigned(df, key, content, max_bytes).drop("_shard_hash")


def _assigned(df: DataFrame, key: str, content: str, max_bytes: int) -> DataFrame:
    """What assign_shards() gives, with the hash bits that a row's shard follows from."""
    rows = cut(
        df.select(
            F.col(key).alias("_k"),
            F.coalesce(F.octet_length(F.col(content)), F.lit(0)).cast("long").alias("_n"),
            hash_bits(F.col(key), F.col(content)).alias("_h"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("_n")).first()[0] or 0
    if total <= max_bytes:
        return rows.select(
            F.col("_k").alias(key), F.col("_n").alias("n_bytes"), F.lit("").alias("shard_id"),
            F.lit(0).alias("shard_depth"), F.lit(total).cast("long").alias("shard_bytes"), F.lit(False).alias("oversize"), F.col("_h").alias("_shard_hash"),
        )
    open_rows, out, depth, n_open = rows, None, 0, 1
    while n_open:
        step = min(STEP, BITS - depth)
        low = depth + step
        fine = open_rows.groupBy(F.shiftright("_h", BITS - low).alias("_p")).agg(F.sum("_n").alias("_b"))
        levels = (
            fine.withColumn("_d", F.explode(F.sequence(F.lit(depth + 1), F.lit(low))))
            .withColumn("_q", F.expr(f"shiftright(_p, {low} - _d)"))
            .groupBy("_d", "_q").agg(F.sum("_b").alias("_b"), F.min("_p").alias("_lo"))
        )
        # the shallowest ancestor that fits; a bucket that never fits stays open at the lowest level
        fits = cut(levels.filter(F.col("_b") <= max_bytes).select("_d", "_q", "_b"), "shard-fits")
        per_fine = cut(
            fine.select("_p").withColumn("_d", F.explode(F.sequence(F.lit(depth + 1), F.lit(low))))
            .withColumn("_q", F.expr(f"shiftright(_p, {low} - _d)"))
            .join(small(fits, fits.count()), ["_d", "_q"], "left")
            .groupBy("_p").agg(F.min(F.when(F.col("_b").isNotNull(), F.struct("_d", "_b"))).alias("_leaf")),
            "shard-directory",
        )
        n_fine = per_fine.count()
        n_open = per_fine.filter("_leaf IS NULL").count()
        tagged = open_rows.withColumn("_f", F.shiftright("_h", BITS - low)).join(
            small(per_fine.withColumnRenamed("_p", "_f"), n_fine, 1 << STEP), "_f", "left"
        )
        last = low == BITS
        done = tagged.filter("_leaf IS NOT NULL").select("_k", "_n", "_h", F.col("_leaf._d").alias("_d"), F.col("_leaf._b").alias("_b"), F.lit(False).alias("_o"))
        if n_open and last:
            sizes = fine.select(F.col("_p").alias("_f"), "_b")
            done = done.unionByName(
                tagged.filter("_leaf IS NULL").join(sizes, "_f").select("_k", "_n", "_h", F.lit(BITS).alias("_d"), "_b", F.lit(True).alias("_o"))
            )
            n_open = 0
        out = done if out is None else out.unionByName(done)
        if n_open:
            open_rows = cut(tagged.filter("_leaf IS NULL").select("_k", "_n", "_h"), "shard-open")
        depth = low
    return out.select(
        F.col("_k").alias(key), F.col("_n").alias("n_bytes"),
        F.expr(f"lpad(bin(shiftright(_h, {BITS} - _d)), _d, '0')").alias("shard_id"),
        F.col("_d").alias("shard_depth"), F.col("_b").alias("shard_bytes"), F.col("_o").alias("oversize"), F.col("_h").alias("_shard_hash"),
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", content: str = "text", max_bytes: int = 1 << 20) -> str:
    """Writes df as Parquet files under shard_id=...; each shard is written by one task and fits the limit.

    Every row of df is written once, with all its columns. Returns the name of the partition column: shard_id, with
    as many underscores behind it as df has columns of such names.
    """
    name = "shard_id"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    shards = _assigned(df, key, content, max_bytes).select("_shard_hash", "shard_id").distinct()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), hash_bits(F.col(f"`{key}`"), F.col(f"`{content}`")).alias("_hash"))
    kept = rows.join(shards, F.col("_hash") == F.col("_shard_hash")).select("_row.*", F.col("shard_id").alias(name))
    kept.repartition(name).write.partitionBy(name).parquet(path)
    return name


#: DuckDB: bytes of every prefix of up to 60 bits, then for each document the shallowest that fits.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 8))::BIGINT << 28)
          | ('0x' || substr(md5(coalesce(text, chr(0))), 1, 7))::BIGINT) AS h
  FROM documents),
p AS (SELECT d.*, k.k AS depth, h >> (60 - k.k) AS q FROM d, (SELECT unnest(range(0, 61))::INT AS k) k),
s AS (SELECT depth, q, sum(n_bytes)::BIGINT AS b FROM p GROUP BY ALL),
f AS (
  SELECT p.doc_id, p.n_bytes, p.h, min(p.depth) FILTER (s.b <= {limit}) AS fit
  FROM p JOIN s USING (depth, q) GROUP BY ALL)
SELECT f.doc_id, f.n_bytes,
       CASE WHEN s.depth = 0 THEN '' ELSE lpad(bin(s.q), s.depth, '0') END AS shard_id, s.depth::INT AS shard_depth, s.b AS shard_bytes,
       (f.fit IS NULL) AS oversize
FROM f JOIN s ON s.depth = coalesce(f.fit, 60) AND s.q = f.h >> (60 - coalesce(f.fit, 60))
"""
