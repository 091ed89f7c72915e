"""Tables cut off from their lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs on one machine (tests), a new local one.
    On a cluster executors do not share local folders, so there the setting is needed."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, under the shared folder."""
    return f"{shared_dir(spark)}/freshet-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and losing
    executors costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with its place (1, 2, 3, ...) in the order, without one task that holds all rows: rows are dealt by range and
    written with their number inside the partition; partitions' counts, one row each, give where each begins."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mine = F.monotonically_increasing_id()
    rows = keep(dealt.withColumns({"_part": F.shiftright(mine, 33), "_nth": mine.bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(begins, "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as shuffles have, which AQE does not coalesce: for rows of few bytes but much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row. The optimizer copies an expression such as a parsed text into
    every field access; behind a generator of one element it stays one, without a shuffle."""
    for name, expr in columns.items():
        df = df.select("*", F.explode(F.array(expr)).alias(name))
    return df


def drop(df: DataFrame) -> None:
    """Delete the files of a table from keep() that no later step reads."""
    spark, path = df.sparkSession, getattr(df, "kept_at", None)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most so many rows from now on: whole texts are long, and a batch is held in memory by
    Spark and by the Python worker. A smaller setting is left as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))
