"""Gauge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import gauges as g
from freshet.plans.bindings import AS_OF, view, with_views
from freshet.plans.registry import query

HOURS = 6
_GATED = "datatype_code = 'HHS'"


def _readings(spark, d):
    return view(spark, d, "v_readings")


def _stations(spark, d):
    return view(spark, d, "v_stations")


def _text(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@query("plausible_filter", with_views("""SELECT station_code, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS rejected
FROM (SELECT *, coalesce(raw_value > 0 AND minute(ts) = 0, false) AS ok FROM v_readings_raw JOIN events USING (event_id)) GROUP BY 1""", "v_readings_raw"))
def plausible_filter(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.date_trunc("minute", "ts").alias("observed_at"), F.col("value").alias("level_m"))
    ok = g.plausible()
    return e.groupBy(F.concat(F.lit("G_"), "event_type").alias("station_code")).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"))


@query("datatype_filter", with_views("SELECT event_id, station_code, raw_value FROM v_readings_raw WHERE datatype_code = 'HHS'", "v_readings_raw"))
def datatype_filter(spark, d):
    return view(spark, d, "v_readings_raw").where(_GATED).select("event_id", "station_code", "raw_value")


_RESOLVED = """SELECT station_code, observed_at, CASE WHEN count(DISTINCT validated_value) = 1 THEN max(validated_value) WHEN count(DISTINCT validated_value) = 0 AND count(DISTINCT raw_value) = 1 THEN max(raw_value) END AS level_m,
 CASE WHEN count(DISTINCT validated_value) > 1 THEN 'ambiguous' WHEN count(DISTINCT validated_value) = 1 THEN 'validated' WHEN count(DISTINCT raw_value) > 1 THEN 'ambiguous' WHEN count(DISTINCT raw_value) = 1 THEN 'raw' ELSE 'empty' END AS state
FROM v_readings_raw WHERE datatype_code = 'HHS' AND coalesce(validated_value, raw_value) > 0 GROUP BY 1, 2"""


@query("resolve_hours", with_views(f"SELECT station_code, {_STAMP.format('observed_at')}, level_m, state FROM ({_RESOLVED})", "v_readings_raw"))
def resolve_hours(spark, d):
    rows = view(spark, d, "v_readings_raw").where(_GATED).where("coalesce(validated_value, raw_value) > 0")
    return g.resolve_hours(rows).select("station_code", _text("observed_at"), "level_m", "state")


@query("history_audit", with_views(f"""SELECT (SELECT count(*) FROM v_readings_raw) AS rows_read, (SELECT count(*) FROM v_readings_raw WHERE datatype_code <> 'HHS') AS wrong_datatype,
 (SELECT count(*) FROM v_readings_raw WHERE datatype_code = 'HHS' AND coalesce(validated_value, raw_value) IS NULL) AS no_value,
 (SELECT count(*) FROM v_readings_raw WHERE datatype_code = 'HHS' AND coalesce(validated_value, raw_value) <= 0) AS not_positive,
 count(*) FILTER (state = 'validated') AS hours_validated, count(*) FILTER (state = 'raw') AS hours_raw, count(*) FILTER (state = 'ambiguous') AS hours_ambiguous FROM ({_RESOLVED})""", "v_readings_raw"))
def history_audit(spark, d):
    return g.history_audit(view(spark, d, "v_readings_raw"))


_CANDIDATES = """SELECT station_code, observed_at, raw_value AS level_m, 0 AS origin, event_id FROM v_readings_raw WHERE event_id % 2 = 0
UNION ALL SELECT station_code, observed_at, validated_value, 1, event_id FROM v_readings_raw WHERE validated_value IS NOT NULL"""


def _candidates(spark, d):
    raw = view(spark, d, "v_readings_raw")
    one = raw.where("event_id % 2 = 0").select("station_code", "observed_at", F.col("raw_value").alias("level_m"), F.lit(0).alias("origin"), "event_id")
    two = raw.where("validated_value is not null").select("station_code", "observed_at", F.col("validated_value").alias("level_m"), F.lit(1).alias("origin"), "event_id")
    return one.unionByName(two)


@query("candidate_union", with_views(f"SELECT origin, station_code, count(*) AS candidates, min(level_m) AS lowest, max(level_m) AS highest FROM ({_CANDIDATES}) GROUP BY 1, 2", "v_readings_raw"))
def candidate_union(spark, d):
    return _candidates(spark, d).groupBy("origin", "station_code").agg(F.count("*").alias("candidates"), F.min("level_m").alias("lowest"), F.max("level_m").alias("highest"))


@query("append_dedupe", with_views(f"""SELECT station_code, {_STAMP.format('observed_at')}, level_m, origin FROM (
 SELECT *, row_number() OVER (PARTITION BY station_code, observed_at ORDER BY origin, event_id) AS rn FROM ({_CANDIDATES})) c
 WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM v_readings_raw s WHERE s.event_id % 7 = 0 AND s.station_code = c.station_code AND s.observed_at = c.observed_at)""", "v_readings_raw"))
def append_dedupe(spark, d):
    stored = view(spark, d, "v_readings_raw").where("event_id % 7 = 0")
    new = g.append_new(stored, _candidates(spark, d), ["station_code", "observed_at"], [F.col("origin"), F.col("event_id")])
    return new.select("station_code", _text("observed_at"), "level_m", "origin")


_LATEST = "SELECT gauge_id, max(observed_at) AS observed_at, arg_max(level_m, observed_at) AS level_m FROM v_readings GROUP BY 1"
_SNAP = f"""SELECT s.*, observed_at, date_diff('second', observed_at, TIMESTAMP '{AS_OF}') / 3600.0 AS age_hours, CASE WHEN date_diff('second', observed_at, TIMESTAMP '{AS_OF}') <= {HOURS * 3600} THEN level_m END AS level_m
FROM v_stations s LEFT JOIN ({_LATEST}) l USING (gauge_id)"""
_STATUS = "CASE WHEN level_m IS NULL THEN 'no_data' WHEN level_m >= highest_flood_level_m THEN 'above_hfl' WHEN level_m >= danger_level_m THEN 'above_danger' WHEN level_m >= warning_level_m THEN 'warning' ELSE 'normal' END"


@query("latest_reading", with_views(f"SELECT gauge_id, {_STAMP.format('observed_at')}, level_m FROM ({_LATEST})", "v_readings"))
def latest_reading(spark, d):
    return g.latest(_readings(spark, d)).select("gauge_id", _text("observed_at"), "level_m")


@query("freshness_gate", with_views(f"SELECT gauge_id, level_m, round(age_hours, 4) AS age_hours, coalesce(age_hours <= {HOURS}, false) AS fresh FROM ({_SNAP}) WHERE observed_at IS NOT NULL", "v_readings", "v_stations"))
def freshness_gate(spark, d):
    return g.freshness_gate(g.latest(_readings(spark, d)), AS_OF, HOURS).join(_stations(spark, d), "gauge_id", "left_semi").select("gauge_id", "level_m", F.round("age_hours", 4).alias("age_hours"), "fresh")


@query("level_status", with_views(f"SELECT gauge_id, {_STATUS} AS status, count(*) AS hours FROM v_readings JOIN v_stations USING (gauge_id) GROUP BY 1, 2", "v_readings", "v_stations"))
def level_status(spark, d):
    r = _readings(spark, d).join(_stations(spark, d), "gauge_id")
    return r.groupBy("gauge_id", g.level_status("level_m", "warning_level_m", "danger_level_m", "highest_flood_level_m").alias("status")).agg(F.count("*").alias("hours"))


@query("snapshot_join", with_views(f"SELECT gauge_id, level_m, round(age_hours, 4) AS age_hours, {_STATUS} AS status FROM ({_SNAP})", "v_readings", "v_stations"))
def snapshot_join(spark, d):
    """The flagship: latest river status per station."""
    return g.snapshot(_stations(spark, d), _readings(spark, d), AS_OF, HOURS).select("gauge_id", "level_m", F.round("age_hours", 4).alias("age_hours"), "status")


@query("status_rollup", with_views(f"""SELECT count(*) AS gauges, count(*) FILTER (status <> 'no_data') AS reporting, count(*) FILTER (status = 'warning') AS warning,
 coalesce(string_agg(gauge_id, ',' ORDER BY gauge_id) FILTER (status IN ('above_danger', 'above_hfl')), '') AS danger_ids, coalesce(string_agg(gauge_id, ',' ORDER BY gauge_id) FILTER (status = 'above_hfl'), '') AS hfl_ids,
 coalesce(string_agg(gauge_id, ',' ORDER BY gauge_id) FILTER (status = 'no_data'), '') AS no_data_ids FROM (SELECT gauge_id, {_STATUS} AS status FROM ({_SNAP}))""", "v_readings", "v_stations"))
def status_rollup(spark, d):
    return g.status_rollup(g.snapshot(_stations(spark, d), _readings(spark, d), AS_OF, HOURS))


@query("missing_members", with_views("SELECT gauge_id FROM v_stations s WHERE NOT EXISTS (SELECT 1 FROM v_readings r WHERE r.gauge_id = s.gauge_id)", "v_readings", "v_stations"))
def missing_members(spark, d):
    return _stations(spark, d).join(_readings(spark, d), "gauge_id", "left_anti").select("gauge_id")


_TREND = """SELECT gauge_id, count(*) AS readings, CASE WHEN count(*) < 2 THEN 'too_few' WHEN max(gap) > 5400 THEN 'gap' END AS reason,
 round((arg_max(level_m, observed_at) - arg_min(level_m, observed_at)) * 100 / (date_diff('second', min(observed_at), max(observed_at)) / 3600.0), 2) AS rate
FROM (SELECT *, date_diff('second', lag(observed_at) OVER (PARTITION BY gauge_id ORDER BY observed_at), observed_at) AS gap
 FROM (SELECT *, max(observed_at) OVER (PARTITION BY gauge_id) AS t1 FROM {0}) WHERE date_diff('second', observed_at, t1) <= 14400) GROUP BY 1"""


@query("trend_window", with_views("SELECT gauge_id, readings, CASE WHEN reason IS NULL THEN rate END AS trend_cm_per_hour, reason FROM (" + _TREND.format("v_readings_sparse") + ")", "v_readings_sparse"))
def trend_window(spark, d):
    return g.trend(view(spark, d, "v_readings_sparse"))


@query("threshold_cross", with_views(f"""SELECT gauge_id, {_STAMP.format('observed_at')}, previous_m, level_m FROM (SELECT *, lag(level_m) OVER (PARTITION BY gauge_id ORDER BY observed_at) AS previous_m FROM v_readings)
 JOIN v_stations USING (gauge_id) WHERE previous_m < danger_level_m AND level_m >= danger_level_m""", "v_readings", "v_stations"))
def threshold_cross(spark, d):
    return g.crossings(_readings(spark, d), _stations(spark, d)).select("gauge_id", _text("observed_at"), "previous_m", "level_m")


@query("last_n_below", with_views("""SELECT gauge_id, count(*) = 3 AND max(level_m) < max(danger_level_m) AS all_below FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY observed_at DESC) AS rn FROM v_readings)
 JOIN v_stations USING (gauge_id) WHERE rn <= 3 AND danger_level_m IS NOT NULL GROUP BY 1""", "v_readings", "v_stations"))
def last_n_below(spark, d):
    return g.last_n_below(_readings(spark, d), _stations(spark, d))


@query("projection", with_views(f"""SELECT gauge_id, nxt AS next_threshold_m, h AS hours_to_threshold, coalesce(h <= 12, false) AS within FROM (
 SELECT gauge_id, nxt, CASE WHEN rate > 0 THEN round((nxt - level_m) * 100 / rate, 4) END AS h FROM (
  SELECT s.gauge_id, s.level_m, CASE WHEN reason IS NULL THEN rate END AS rate,
   least(CASE WHEN warning_level_m > level_m THEN warning_level_m END, CASE WHEN danger_level_m > level_m THEN danger_level_m END, CASE WHEN highest_flood_level_m > level_m THEN highest_flood_level_m END) AS nxt
  FROM ({_SNAP}) s LEFT JOIN ({_TREND.format('v_readings')}) t USING (gauge_id)))""", "v_readings", "v_stations"))
def projection(spark, d):
    r = _readings(spark, d)
    return g.projection(g.trend(r), g.snapshot(_stations(spark, d), r, AS_OF, HOURS))


@query("stream_staleness", with_views(f"""SELECT gauge_id, {_STAMP.format('observed_at')}, round(age_hours, 4) AS age_hours, CASE WHEN observed_at IS NULL THEN 'never_reported' ELSE 'stale' END AS reason
 FROM ({_SNAP}) WHERE NOT coalesce(age_hours <= {HOURS}, false)""", "v_readings", "v_stations"))
def stream_staleness(spark, d):
    return g.silent_members(_stations(spark, d), _readings(spark, d), AS_OF, HOURS).withColumn("observed_at", _text("observed_at"))


_FC = """SELECT concat('G_', event_type) AS gauge_id, ts AS issued_at, ts + INTERVAL '1' HOUR * CAST(event_id % 48 AS INTEGER) AS valid_at, event_id % 3 <> 0 AS approved, value AS level_m, event_id FROM events"""


@query("next_forecast", f"""SELECT gauge_id, event_id, level_m FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY valid_at, issued_at DESC) AS rn FROM ({_FC}) WHERE approved AND valid_at > TIMESTAMP '2024-01-30 00:00:00') WHERE rn = 1""")
def next_forecast(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    f = e.select(F.concat(F.lit("G_"), "event_type").alias("gauge_id"), F.col("ts").alias("issued_at"), F.expr("ts + make_dt_interval(0, cast(event_id % 48 as int))").alias("valid_at"), (F.col("event_id") % 3 != 0).alias("approved"), F.col("value").alias("level_m"), "event_id")
    return g.next_forecast(f, "2024-01-30 00:00:00").select("gauge_id", "event_id", "level_m")
