"""Crowd reports: validation, privacy, quorum, contradiction and decay."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

DEPTHS = ("dry", "ankle", "knee", "waist_plus")


def coarse(value: Column | str, places: int = 3) -> Column:
    return F.bround(value, places)


def quorum(reports: DataFrame, since: Column, least: int = 2) -> DataFrame:
    """Reports per place and depth since a time; groups below the quorum are marked, and callers withhold them."""
    g = reports.where(F.col("submitted_at") > since).groupBy("locality_id", "depth_class").agg(F.count("*").alias("reports"))
    return g.withColumn("published", F.col("reports") >= least)


def contradictions(reports: DataFrame, minutes: int = 30) -> DataFrame:
    """Reports with an opposite one (dry or not) in the same coarse cell within the minutes.

    Each side looks into its own time bucket and its neighbours, so the join is an equi-join; only flagged ids leave."""
    size = minutes * 60
    sec = F.unix_timestamp(F.col("submitted_at").cast("timestamp"))
    r = reports.withColumns({"cx": coarse("lon"), "cy": coarse("lat"), "sec": sec, "bucket": F.floor(sec / size), "dry": F.col("depth_class") == "dry"})
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    dry = r.where("dry").withColumn("_o", F.explode(near)).select("cx", "cy", (F.col("bucket") + F.col("_o")).alias("bucket"), F.col("report_id").alias("a"), F.col("submitted_at").alias("ta"))
    wet = r.where("not dry").select("cx", "cy", "bucket", F.col("report_id").alias("b"), F.col("submitted_at").alias("tb"))
    gap = F.abs(F.timestamp_diff("MICROSECOND", F.col("ta"), F.col("tb")))
    return dry.join(wet, ["cx", "cy", "bucket"]).where(gap <= minutes * 60_000_000).select("a", "b")


def flagged(reports: DataFrame, minutes: int = 30) -> DataFrame:
    """reports with contradicted: whether contradictions() has the report in a pair, without making the pairs.

    Buckets are as long as the minutes, so an opposite report in the same one is near enough; of the bucket before only
    the latest opposite time counts, of the one after only the earliest. These combine before the shuffle. Reports
    without coordinates, time or depth are not contradicted."""
    sec = F.unix_timestamp(F.col("submitted_at").cast("timestamp"))
    r = reports.select(F.struct(*reports.columns).alias("row"), coarse("lon").alias("cx"), coarse("lat").alias("cy"), F.floor(sec / (minutes * 60)).alias("bucket"), (F.col("depth_class") == "dry").alias("dry"), F.col("submitted_at").alias("at"))
    ends = r.groupBy("cx", "cy", "bucket", "dry").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    moved = ends.withColumn("step", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    seen = moved.groupBy("cx", "cy", (F.col("bucket") + F.col("step")).alias("bucket"), (~F.col("dry")).alias("dry")).agg(
        F.max(F.col("step") == 0).alias("same"), F.max(F.when(F.col("step") == 1, F.col("last"))).alias("before"), F.min(F.when(F.col("step") == -1, F.col("first"))).alias("after"),
    )
    near = lambda t: F.coalesce(F.abs(F.timestamp_diff("MICROSECOND", F.col("at"), F.col(t))) <= minutes * 60_000_000, F.lit(False))
    hit = F.coalesce("same", F.lit(False)) | near("before") | near("after")
    return r.join(seen, ["cx", "cy", "bucket", "dry"], "left").select("row.*", hit.alias("contradicted"))


def decay(age_hours: Column) -> Column:
    """1 at once, 0 from six hours on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age_hours / 6))


def validate(rows: DataFrame) -> DataFrame:
    """rows with the reasons against each submission, in order; an empty list accepts it."""
    reasons = F.filter(F.array(
        F.when(F.col("lon").isNull() | F.col("lat").isNull(), "no_place"), F.when(~(F.col("lon").between(89, 97) & F.col("lat").between(23, 29)), "outside"),
        F.when(~F.coalesce(F.col("depth_class").isin(*DEPTHS), F.lit(False)), "depth"), F.when(F.col("device_id").isNull(), "no_device"),
    ), lambda x: x.isNotNull())
    return rows.withColumn("reasons", F.array_join(reasons, ","))


def bucket_verdicts(events: DataFrame, key: str, at: str, bucket: str, limit: int) -> DataFrame:
    """Events per key and tumbling window, and how many are over the limit; each is judged by its place in time,
    so the number rejected is the excess."""
    g = events.groupBy(key, F.window(F.col(at).cast("timestamp"), bucket).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("rejected"))


def cooled_pushes(events: DataFrame, key: str, hours: int) -> DataFrame:
    """Alerts that are pushed: the first, then any at least `hours` after the last one pushed, or with a higher
    severity. Each key's events are streamed in order; of a key only the last push and the counts are held."""
    kind = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("events", T.IntegerType(), False), T.StructField("pushed", T.IntegerType()), T.StructField("last_push", T.TimestampNTZType())])
    arrow, wait = to_arrow_schema(kind), timedelta(hours=hours)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, k, n, pushed, at, sev = False, None, 0, 0, None, -1
        for batch in batches:
            done = []
            for x, t, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not open_ or x != k:
                    if open_:
                        done.append((k, n, pushed, at))
                    open_, k, n, pushed, at, sev = True, x, 0, 0, None, -1
                n += 1
                if at is None or (t is not None and t >= at + wait) or (s is not None and sev is not None and s > sev):
                    pushed, at, sev = pushed + 1, t, s
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in done], schema=arrow)
        if open_:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (k, n, pushed, at), strict=True))], schema=arrow)

    e = events.select(key, F.col("at").cast("timestamp_ntz").alias("at"), "severity", "event_id")
    return e.repartition(key).sortWithinPartitions(key, "at", "severity", "event_id").mapInArrow(fold, kind)
