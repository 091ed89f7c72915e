"""Gauge readings: structural gates, hour resolution, latest status and trend.

Every operator takes and returns DataFrames, takes the clock as a parameter, and yields null with a reason instead
of an estimate where data are missing, stale or contradictory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("SECOND", F.col(start) if isinstance(start, str) else start, F.col(end) if isinstance(end, str) else end)


def clock(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def plausible(observed_at: str = "observed_at", value: str = "level_m") -> Column:
    """A value above zero on the full hour; size never counts."""
    return F.coalesce((F.col(value) > 0) & (F.minute(observed_at) == 0) & (F.second(observed_at) == 0), F.lit(False))


def level_status(level: str, warning: str, danger: str, highest: str) -> Column:
    """Inclusive ladder; a null threshold is skipped, a null level gives no_data."""
    return (
        F.when(F.col(level).isNull(), "no_data").when(F.col(level) >= F.col(highest), "above_hfl").when(F.col(level) >= F.col(danger), "above_danger")
        .when(F.col(level) >= F.col(warning), "warning").otherwise("normal")
    )


def resolve_hours(rows: DataFrame) -> DataFrame:
    """(station_code, observed_at, level_m, value_source, state) from raw rows with raw_value and validated_value.

    One distinct validated value wins. Several validated values, or none and several raw ones, make the hour
    ambiguous: level null. Counts of distinct values come from minimum and maximum, which combine before the shuffle.
    """
    g = rows.groupBy("station_code", "observed_at").agg(
        F.min("validated_value").alias("v0"), F.max("validated_value").alias("v1"), F.min("raw_value").alias("r0"), F.max("raw_value").alias("r1")
    )
    state = F.when(F.col("v0") < F.col("v1"), "ambiguous").when(F.col("v0").isNotNull(), "validated").when(F.col("r0") < F.col("r1"), "ambiguous").when(F.col("r0").isNotNull(), "raw").otherwise("empty")
    g = g.withColumn("state", state)
    return g.select("station_code", "observed_at", F.when(F.col("state") == "validated", F.col("v0")).when(F.col("state") == "raw", F.col("r0")).alias("level_m"), "state")


def history_audit(rows: DataFrame) -> DataFrame:
    """One row of counters: the first rule each raw row fails, and how the hours were resolved."""
    fails = F.when(F.col("datatype_code") != "HHS", "wrong_datatype").when(F.coalesce("validated_value", "raw_value").isNull(), "no_value").when(F.coalesce("validated_value", "raw_value") <= 0, "not_positive")
    first = rows.agg(F.count("*").alias("rows_read"), *[F.count_if(fails == k).alias(k) for k in ("wrong_datatype", "no_value", "not_positive")])
    hours = resolve_hours(rows.where(fails.isNull())).agg(*[F.count_if(F.col("state") == k).alias(f"hours_{k}") for k in ("validated", "raw", "ambiguous")])
    return first.crossJoin(hours)


def append_new(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of batch to append: the first per key, of keys that are not stored yet."""
    first = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    return first.join(stored.select(*keys).distinct(), keys, "left_anti")


def latest(readings: DataFrame, key: str = "gauge_id", at: str = "observed_at", value: str = "level_m") -> DataFrame:
    """Newest reading of each key; combines before the shuffle, so a busy key is no hot partition."""
    return readings.groupBy(key).agg(F.max_by(F.struct(F.col(at), F.col(value)), F.struct(at, value)).alias("_l")).select(key, f"_l.{at}", f"_l.{value}")


def freshness_gate(rows: DataFrame, as_of: str, hours: float, at: str = "observed_at", value: str = "level_m") -> DataFrame:
    """Null the value of stale rows, keep when it was observed and its age in hours."""
    age = seconds_between(at, clock(as_of)) / 3600
    return rows.withColumn("age_hours", age).withColumn("fresh", F.coalesce(age <= hours, F.lit(False))).withColumn(value, F.when(F.col("fresh"), F.col(value)))


def snapshot(stations: DataFrame, readings: DataFrame, as_of: str, hours: float) -> DataFrame:
    """Every station with its latest gated reading and status; stations absent from the feed stay as no_data.

    The latest reading per gauge is aggregated first, so the join sees one row per station."""
    now = freshness_gate(latest(readings), as_of, hours)
    joined = stations.join(now, "gauge_id", "left")
    return joined.withColumn("status", level_status("level_m", "warning_level_m", "danger_level_m", "highest_flood_level_m"))


def status_rollup(snap: DataFrame) -> DataFrame:
    """One row: gauges per status and the sorted ids above danger, above the record, and without data."""
    ids = lambda *k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status").isin(*k), F.col("gauge_id")))), ",")
    return snap.agg(
        F.count("*").alias("gauges"), F.count_if(F.col("status") != "no_data").alias("reporting"), F.count_if(F.col("status") == "warning").alias("warning"),
        ids("above_danger", "above_hfl").alias("danger_ids"), ids("above_hfl").alias("hfl_ids"), ids("no_data").alias("no_data_ids"),
    )


def trend(readings: DataFrame, hours: int = 4, max_gap_minutes: int = 90) -> DataFrame:
    """Change per hour (cm) over the trailing window that ends at each gauge's latest reading; a gap above the
    limit, fewer than two readings, or readings of one time only give null and a reason."""
    by = Window.partitionBy("gauge_id")
    last = readings.groupBy("gauge_id").agg(F.max("observed_at").alias("_last"))
    inside = readings.join(last, "gauge_id").where(seconds_between("observed_at", "_last") <= hours * 3600)
    gap = seconds_between(F.lag("observed_at").over(by.orderBy("observed_at")), F.col("observed_at"))
    g = inside.withColumn("_gap", gap).groupBy("gauge_id").agg(
        F.count("*").alias("readings"), F.max("_gap").alias("gap"), F.min("observed_at").alias("t0"), F.max("observed_at").alias("t1"),
        F.min_by("level_m", "observed_at").alias("l0"), F.max_by("level_m", "observed_at").alias("l1"),
    )
    reason = F.when(F.col("readings") < 2, "too_few").when(F.col("gap") > max_gap_minutes * 60, "gap").when(F.col("t0") == F.col("t1"), "one_time")
    rate = F.round(F.try_divide((F.col("l1") - F.col("l0")) * 100, seconds_between("t0", "t1") / 3600), 2)
    return g.select("gauge_id", "readings", F.when(reason.isNull(), rate).alias("trend_cm_per_hour"), reason.alias("reason"))


def crossings(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Upward crossings of the danger level: previous reading below it, current one at or above it."""
    w = Window.partitionBy("gauge_id").orderBy("observed_at")
    r = readings.withColumn("previous_m", F.lag("level_m").over(w)).join(stations.select("gauge_id", "danger_level_m"), "gauge_id")
    return r.where((F.col("previous_m") < F.col("danger_level_m")) & (F.col("level_m") >= F.col("danger_level_m"))).select("gauge_id", "observed_at", "previous_m", "level_m")


def last_n_below(readings: DataFrame, stations: DataFrame, n: int = 3) -> DataFrame:
    """Whether the last n readings of a gauge are all below its danger level; only those n rows are compared."""
    rn = F.row_number().over(Window.partitionBy("gauge_id").orderBy(F.desc("observed_at")))
    r = readings.withColumn("_rn", rn).where(F.col("_rn") <= n).join(stations.where("danger_level_m is not null"), "gauge_id")
    return r.groupBy("gauge_id").agg(((F.count("*") == n) & (F.max("level_m") < F.max("danger_level_m"))).alias("all_below"))


def projection(trends: DataFrame, snap: DataFrame, within_hours: float = 12) -> DataFrame:
    """Hours until the next threshold above the level is met at the current trend, if rising."""
    levels = [F.when(F.col(c) > F.col("level_m"), F.col(c)) for c in ("warning_level_m", "danger_level_m", "highest_flood_level_m")]
    j = snap.join(trends, "gauge_id", "left").withColumn("next_threshold_m", F.least(*levels))
    hours = F.when(F.col("trend_cm_per_hour") > 0, F.round((F.col("next_threshold_m") - F.col("level_m")) * 100 / F.col("trend_cm_per_hour"), 4))
    return j.select("gauge_id", "next_threshold_m", hours.alias("hours_to_threshold"), F.coalesce(hours <= within_hours, F.lit(False)).alias("within"))


def silent_members(stations: DataFrame, readings: DataFrame, as_of: str, hours: float) -> DataFrame:
    """Stations whose last reading is older than the limit, or that have none."""
    snap = snapshot(stations, readings, as_of, hours)
    return snap.where("not coalesce(fresh, false)").select("gauge_id", "observed_at", F.round("age_hours", 4).alias("age_hours"), F.when(F.col("observed_at").isNull(), "never_reported").otherwise("stale").alias("reason"))


def next_forecast(forecasts: DataFrame, as_of: str) -> DataFrame:
    """Earliest approved forecast after the clock, one per station; equal times by issue time, newest first."""
    ok = forecasts.where((F.col("approved")) & (F.col("valid_at") > clock(as_of)))
    rn = F.row_number().over(Window.partitionBy("gauge_id").orderBy("valid_at", F.desc("issued_at")))
    return ok.withColumn("_rn", rn).where("_rn = 1").drop("_rn")
