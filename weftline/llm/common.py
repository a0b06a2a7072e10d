"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workspace

#: Rows a side may have, as counted, before a broadcast hint is given; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet in the shared folder and returns a scan of it: recovery restarts from there."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes the files behind a cut() that no later plan reads."""
    path = getattr(df, "_weftline_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the bound of Arrow batches to 8 MiB, so that a Python worker's memory does not follow the texts' lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    m = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(key).strip().lower())
    if m is None or int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] > 8 << 20:
        spark.conf.set(key, str(8 << 20))


def model_file(path: str) -> str:
    """path where it exists on this node, else the file of its name that was shipped with SparkContext.addFile()."""
    import os

    from pyspark import SparkFiles

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same for texts of ASCII alone, and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def free(df: DataFrame, name: str) -> str:
    """name, or that with as many underscores behind it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality on the pairs of columns, as a join condition."""
    out = None
    for a, b in pairs.items():
        c = left[a].eqNullSafe(right[b])
        out = c if out is None else out & c
    return out


def numbered(df: DataFrame, name: str, *order: Column, number: str = "_n") -> DataFrame:
    """df, stored, with a running number from 1 in the given order, which must tell rows apart where the numbers are to be stable.

    Rows are dealt by range and numbered within; a range begins where those before it end, so no task sees them all.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    before, starts = 0, []
    for r in placed.groupBy(F.shiftright("_m", 33).alias("p")).count().orderBy("p").collect():  # a row for each partition
        starts.append((r["p"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "_p bigint, _s bigint")
    joined = placed.join(F.broadcast(starts), F.shiftright("_m", 33) == F.col("_p"))
    return joined.select(*df.columns, (F.col("_s") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).alias(number))
