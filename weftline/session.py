"""Sessions and shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def session(name: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, adaptive execution, skew joins. Sizes stay the cluster's."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder on a local master where it is unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or getattr(spark, "_weftline_tables", None)
    if not found:
        if not (conf.get("spark.master") or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark._weftline_tables = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return found.rstrip("/")


def workspace(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"
    if getattr(spark, "_weftline_workspace", None) != path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        spark._weftline_workspace = path
    return path


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files give fewer partitions than there are; larger inputs stay as they lie."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row.

    What stands behind an array of one row is not put into later filters and projections, which would repeat it.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


#: Rows a side may have, as counted, before a broadcast hint is given; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Rows of a group that one window may sort, as counted; larger groups are ranked by ranges.
WINDOW_ROWS = 5_000_000


def ranked(df: DataFrame, group: str, *order: Column | str, rank: str = "_r", total: str = "_n") -> DataFrame:
    """df with each row's 1-based rank within its group by rising order, and the group's rows.

    Groups that one task can sort are sorted by a window. Where one is larger, rows are range-partitioned by group and
    order, counted by partition, and numbered within each from where the partitions before it end.
    """
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if largest <= WINDOW_ROWS:
        w = Window.partitionBy(group)
        return df.withColumns({rank: F.row_number().over(w.orderBy(*order)), total: F.count("*").over(w)})
    keys = [f"_o{i}" for i in range(len(order))]
    placed = df.withColumns(dict(zip(keys, order, strict=True)))
    placed = stored(placed.repartitionByRange(group, *keys).sortWithinPartitions(group, *keys).withColumn("_p", F.spark_partition_id()), "ranked")
    counts = placed.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count("*").alias("_c"))  # a row for each group in a partition
    w = Window.partitionBy("_g")
    before = counts.select("_g", "_q", F.coalesce(F.sum("_c").over(w.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_c").over(w).alias("_t"))
    inside = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_p", group).orderBy(*keys)))
    j = inside.join(small(before, before.count()), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return j.select(*df.columns, (F.col("_b") + F.col("_i")).cast("int" if largest < 1 << 31 else "long").alias(rank), F.col("_t").alias(total))


def stored(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again (by another schema, if given): lineage ends there, and a
    lost executor costs nothing before it."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema or df.schema).parquet(path)
    out._weftline_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files behind a stored() table that no later plan reads."""
    path = getattr(df, "_weftline_path", None)
    if path:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
