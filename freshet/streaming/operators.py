"""Structured Streaming forms of the incremental operators.

Each takes a streaming DataFrame and gives one; the batch operators are their twins. Watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SEVERITIES = ("normal", "warning", "above_danger", "above_hfl")


def first_writes(readings: DataFrame, keys: list[str], at: str = "observed_at", late: str = "12 hours") -> DataFrame:
    """Readings, each key once within the watermark: late data is accepted for so long, the first write wins."""
    return readings.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def deliveries_once(deliveries: DataFrame, at: str = "ts") -> DataFrame:
    """Deliveries, each channel and id once within seven days."""
    return deliveries.withWatermark(at, "7 days").dropDuplicatesWithinWatermark(["channel", "delivery_id"])


def rate_counts(events: DataFrame, key: str, at: str = "ts", window: str = "10 minutes", limit: int = 30, late: str = "1 hour") -> DataFrame:
    """Events per key and tumbling window, and how many exceed the limit."""
    g = events.withWatermark(at, late).groupBy(key, F.window(at, window).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("window_start"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("rejected"))


def trailing_totals(obs: DataFrame, hours: int = 24, late: str = "2 hours") -> DataFrame:
    """Sliding totals per cell with the coverage gate: null unless every half hour is there."""
    g = obs.withWatermark("interval_start", late).groupBy("cell_id", F.window("interval_start", f"{hours} hours", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("rate_mm_h") / 2).alias("mm"))
    return g.select("cell_id", F.col("w.end").alias("as_of"), "n", F.when(F.col("n") == 2 * hours, F.col("mm")).alias("total_mm"))


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "24 hours", late: str = "1 day") -> DataFrame:
    """Conversation sessions: a silence of the gap ends one."""
    g = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return g.select(key, F.col("w.start").alias("started"), "events")


def alert_states(statuses: DataFrame, key: str = "gauge_id", hours: int = 6) -> DataFrame:
    """Alerts with memory per gauge: pushed at first, again after the cooldown, or at once if severity rises.

    statuses(gauge_id, observed_at, severity int), with a watermark. State is one time and one severity per gauge;
    batches of a gauge are put in order before the fold."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(k, batches, state: GroupState):
        import pandas as pd

        last, severity = state.get if state.exists else (None, -1)
        out = []
        for pdf in batches:
            for at, sev in sorted(zip(pdf["observed_at"], pdf["severity"], strict=True)):
                now = at.value // 1000
                if last is None or now >= last + hours * 3_600_000_000 or sev > severity:
                    last, severity = now, int(sev)
                    out.append((k[0], at, int(sev)))
        if last is not None:
            state.update((last, severity))
        yield pd.DataFrame(out, columns=[key, "pushed_at", "severity"])

    return statuses.groupBy(key).applyInPandasWithState(fold, f"{key} string, pushed_at timestamp, severity int", "last long, severity int", "append", GroupStateTimeout.NoTimeout)


def append_to(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: Callable) -> StreamingQuery:
    """Append first writes to a Parquet table: each micro-batch is deduplicated and anti-joined with what is stored."""
    from freshet.operators.gauges import append_new

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.schema(batch.schema).parquet(path) if _has_files(spark, path) else batch.limit(0)
        append_new(stored, batch, keys, order()).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _has_files(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
