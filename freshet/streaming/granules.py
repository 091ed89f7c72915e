"""Granules kept once, cut to the cells that are wanted, with a ledger of every payload that came.

A cut is not the granule: it is named by a digest of the wanted cells, so a wider set of cells finds nothing and is cut
again from the source, and a narrower cut stays readable under its own name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet.shared import keep
from freshet.streaming.operators import _has_files

KEYS = ["run", "granule"]
LEDGER = "run string, granule string, fetched_at timestamp_ntz, content string, readings long, outcome string, digest string, batch long"


def cells_digest(cells: DataFrame) -> DataFrame:
    """(digest): twelve hex digits for a set of cell_ids, whatever their order and repetition. Cells are those of one
    region's grid, so the set is small."""
    return cells.where("cell_id is not null").agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_set("cell_id")), ","), 256), 1, 12).alias("digest"))


def payloads(readings: DataFrame) -> DataFrame:
    """(run, granule, fetched_at, content, readings): one row per payload. The content is told by sums of hashes of its
    readings, which need no order and combine before the shuffle."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "cell_id", "interval_start", "rate_mm_h").cast("decimal(20,0)"))
    g = readings.groupBy(*KEYS, "fetched_at").agg(F.count("*").alias("readings"), h(1).alias("_a"), h(2).alias("_b"))
    return g.select(*KEYS, "fetched_at", F.sha2(F.concat_ws("|", "readings", "_a", "_b"), 256).alias("content"), "readings")


def judge(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found with its outcome: `stored` for the first payload of a granule that has none in stored(run, granule, content),
    `same` for a payload equal to the one that counts, `changed` for any other: the archive gave a name new numbers, which
    is reported and never adopted. First is earliest fetched, then by content."""
    first = found.groupBy(*KEYS).agg(F.min(F.struct("fetched_at", "content")).alias("_first"))
    j = found.join(first, KEYS).join(stored.select(*KEYS, F.col("content").alias("_kept")), KEYS, "left")
    new = F.col("_kept").isNull() & (F.col("fetched_at") == F.col("_first.fetched_at")) & (F.col("content") == F.col("_first.content"))
    out = F.when(new, "stored").when(F.col("content") == F.coalesce("_kept", "_first.content"), "same").otherwise("changed")
    return j.withColumn("outcome", out).drop("_first", "_kept")


def store(stream: DataFrame, cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the stream's granules, cut to cells, under path/cuts (by digest, run and granule) and path/ledger.

    stream(run, granule, fetched_at, cell_id, interval_start, rate_mm_h): a payload is what one granule of a run was at one
    fetched_at and comes whole in one micro-batch. Rows without run, granule, fetched_at or a wanted cell are left out.
    Partitions are overwritten, those of the batch alone, and a batch does not see its own ledger: one that is repeated
    after a failure writes the same again. Only granules that are new under this digest are written."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        digest = cells_digest(cells).first()[0]
        cut = batch.where("run is not null and granule is not null and fetched_at is not null").join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
        known = ledger(spark, path).where((F.col("digest") == digest) & (F.col("outcome") == "stored") & (F.col("batch") != number))
        seen = keep(judge(payloads(cut), known), "payloads")
        new = seen.where("outcome = 'stored'").select(*KEYS, "fetched_at")
        rows = cut.join(new, [*KEYS, "fetched_at"]).withColumn("digest", F.lit(digest)).repartition(*KEYS)
        whole = {"partitionOverwriteMode": "dynamic"}
        rows.write.mode("overwrite").options(**whole).partitionBy("digest", *KEYS).parquet(f"{path}/cuts")
        seen.withColumns({"digest": F.lit(digest), "batch": F.lit(number).cast("long")}).write.mode("overwrite").options(**whole).partitionBy("digest", "batch").parquet(f"{path}/ledger")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every payload that came, with its outcome; empty before the first batch."""
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger") if _has_files(spark, f"{path}/ledger") else spark.createDataFrame([], LEDGER)


def read_cuts(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """Readings of the granules that were cut to exactly these cells; other cuts are not read."""
    schema = "run string, granule string, fetched_at timestamp_ntz, cell_id string, interval_start timestamp_ntz, rate_mm_h decimal(18,6), digest string"
    if not _has_files(spark, f"{path}/cuts"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/cuts").where(F.col("digest") == cells_digest(cells).first()[0])


def missing(expected: DataFrame, spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """Granules of expected(run, granule) that are not stored under the digest of cells: what must be fetched."""
    known = ledger(spark, path).where((F.col("digest") == cells_digest(cells).first()[0]) & (F.col("outcome") == "stored"))
    return expected.join(known, KEYS, "left_anti")
