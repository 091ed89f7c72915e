"""Rainfall queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import rainfall as r
from freshet.plans.bindings import table, view, with_views
from freshet.plans.registry import query

AS_OF, HOURS = "2024-01-20 12:00:00", (1, 3, 6, 24, 72)
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def _obs(spark, d):
    return view(spark, d, "v_grid_obs")


def _weights(spark, d):
    return view(spark, d, "v_zone_weights")


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _spine(spark):
    return r.granule_spine(spark, "2024-01-05 00:00:00", "2024-01-25 00:00:00")


_SPINE = "SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-24 23:30:00', INTERVAL 30 MINUTE)) AS TIMESTAMP) AS interval_start"


@query("contiguity", with_views("""SELECT cell_id, count(*) AS intervals, count(*) FILTER (step = 30) AS joined, count(*) FILTER (step > 30) AS gaps, count(*) FILTER (step < 30) AS overlaps
 FROM (SELECT *, date_diff('minute', lag(interval_start) OVER (PARTITION BY cell_id ORDER BY interval_start), interval_start) AS step FROM v_grid_obs) GROUP BY 1""", "v_grid_obs"))
def contiguity(spark, d):
    return r.contiguity(_obs(spark, d))


@query("rate_accumulate", with_views("SELECT cell_id, strftime(interval_start, '%Y-%m-%d') AS day, CAST(sum(rate_mm_h * 0.5) AS DOUBLE) AS total_mm, count(*) AS intervals FROM v_grid_obs GROUP BY 1, 2", "v_grid_obs"))
def rate_accumulate(spark, d):
    return r.accumulate(_obs(spark, d), ["cell_id", F.date_format("interval_start", "yyyy-MM-dd").alias("day")]).withColumn("total_mm", F.col("total_mm").cast("double"))


_WINDOWS = " UNION ALL ".join(f"SELECT {h} AS window_hours, TIMESTAMP '{AS_OF}' - INTERVAL {h} HOUR AS window_start, TIMESTAMP '{AS_OF}' AS window_end" for h in HOURS)
_IN = f"SELECT * FROM v_grid_obs JOIN ({_WINDOWS}) ON interval_start >= window_start AND interval_start + INTERVAL 30 MINUTE <= window_end"


@query("interval_in_window", with_views(f"SELECT cell_id, window_hours, count(*) AS intervals, {_T.format('first')} FROM (SELECT *, min(interval_start) OVER (PARTITION BY cell_id, window_hours) AS first FROM ({_IN})) GROUP BY cell_id, window_hours, first", "v_grid_obs"))
def interval_in_window(spark, d):
    w = r.in_windows(_obs(spark, d), r.windows(spark, HOURS, AS_OF))
    return w.groupBy("cell_id", "window_hours").agg(F.count("*").alias("intervals"), F.min("interval_start").alias("first")).withColumn("first", _stamp("first"))


@query("zone_weight_join", with_views("SELECT zone_id, cell_id, count(*) AS intervals, round(sum(CAST(rate_mm_h AS DOUBLE) * share), 6) AS weighted FROM v_zone_weights JOIN v_grid_obs USING (cell_id) GROUP BY 1, 2", "v_zone_weights", "v_grid_obs"))
def zone_weight_join(spark, d):
    j = _obs(spark, d).join(_weights(spark, d), "cell_id")
    return j.groupBy("zone_id", "cell_id").agg(F.count("*").alias("intervals"), F.round(F.sum(F.col("rate_mm_h").cast("double") * F.col("share")), 6).alias("weighted"))


@query("zonal_total", with_views(f"""SELECT zone_id, {_T.format('interval_start')}, cells, present, CASE WHEN cells = present THEN round(t, 6) END AS total_mm FROM (
 SELECT zone_id, interval_start, count(*) AS present, sum(CAST(rate_mm_h * 0.5 AS DOUBLE) * share) AS t FROM v_zone_weights JOIN v_grid_obs USING (cell_id) GROUP BY 1, 2) JOIN (SELECT zone_id, count(*) AS cells FROM v_zone_weights GROUP BY 1) USING (zone_id)""", "v_zone_weights", "v_grid_obs"))
def zonal_total(spark, d):
    cells = r.accumulate(_obs(spark, d), ["cell_id", "interval_start"])
    return r.zone_totals(_weights(spark, d), cells, ["interval_start"]).withColumn("interval_start", _stamp("interval_start"))


_FULL = f"SELECT cell_id, interval_start, coalesce(rate_mm_h, 0) AS rate_mm_h FROM (SELECT cell_id, interval_start FROM (SELECT DISTINCT cell_id FROM v_grid_obs) CROSS JOIN ({_SPINE})) LEFT JOIN v_grid_obs USING (cell_id, interval_start) WHERE NOT (cell_id = 'C3' AND hour(interval_start) = 3) AND NOT (cell_id = 'C1' AND interval_start < TIMESTAMP '2024-01-18 00:00:00')"


def _full(spark, d):
    """The feed with quiet half hours filled in, but for a broken cell and one that starts late."""
    obs = _obs(spark, d)
    full = obs.select("cell_id").distinct().crossJoin(_spine(spark).select("interval_start")).join(obs, ["cell_id", "interval_start"], "left")
    full = full.withColumn("rate_mm_h", F.coalesce("rate_mm_h", F.lit(0).cast("decimal(18,6)")))
    return full.where("not (cell_id = 'C3' and hour(interval_start) = 3) and not (cell_id = 'C1' and interval_start < timestamp_ntz'2024-01-18 00:00:00')")


_TOTALS = f"""SELECT zone_id, window_hours, CASE WHEN reason IS NULL THEN round(mm, 6) END AS total_mm, reason AS unavailable_reason FROM (SELECT zone_id, window_hours, mm,
  CASE WHEN missing THEN 'missing_cells' WHEN broken THEN 'series_broken' WHEN short THEN 'window_not_covered' END AS reason FROM (
  SELECT zone_id, window_hours, bool_or(n IS NULL) AS missing, bool_or(coalesce(n <> date_diff('minute', t0, t1) / 30 + 1, false)) AS broken, bool_or(coalesce(t0 > window_start OR t1 + INTERVAL 30 MINUTE < window_end, false)) AS short, sum(mm * share) AS mm
  FROM v_zone_weights CROSS JOIN ({_WINDOWS}) LEFT JOIN (SELECT cell_id, window_hours, CAST(sum(rate_mm_h * 0.5) AS DOUBLE) AS mm, count(*) AS n, min(interval_start) AS t0, max(interval_start) AS t1 FROM ({_IN.replace('v_grid_obs', '{src}')}) GROUP BY 1, 2) USING (cell_id, window_hours) GROUP BY 1, 2)))"""
_ALL = _TOTALS.replace("{src}", f"({_FULL})")


@query("window_totals", with_views(_ALL[:-1], "v_zone_weights", "v_grid_obs"))
def window_totals(spark, d):
    return r.window_totals(_weights(spark, d), _full(spark, d), r.windows(spark, HOURS, AS_OF))


@query("headline_window", with_views(f"""SELECT zone_id, h.w AS headline_hours, h.t AS headline_mm, CASE WHEN h.w < 72 AND c - h.t >= 10 THEN c END AS context_mm FROM (
 SELECT zone_id, max({{'p': window_hours = 24, 'w': window_hours, 't': total_mm}}) FILTER (total_mm IS NOT NULL) AS h, max(total_mm) FILTER (window_hours = 72) AS c FROM ({_ALL[:-1]}) GROUP BY 1)""", "v_zone_weights", "v_grid_obs"))
def headline_window(spark, d):
    return r.headline(r.window_totals(_weights(spark, d), _full(spark, d), r.windows(spark, HOURS, AS_OF)))


@query("cell_except", with_views("SELECT cell_id, 'missing' AS side FROM (SELECT DISTINCT cell_id FROM v_zone_weights EXCEPT SELECT cell_id FROM v_grid_obs WHERE cell_id <> 'C2') UNION ALL SELECT cell_id, 'extra' FROM (SELECT cell_id FROM v_grid_obs WHERE cell_id <> 'C2' EXCEPT SELECT cell_id FROM v_zone_weights WHERE zone_id <> 'Z3')".replace("FROM (SELECT DISTINCT cell_id FROM v_zone_weights EXCEPT", "FROM (SELECT DISTINCT cell_id FROM v_zone_weights WHERE zone_id <> 'Z3' EXCEPT"), "v_zone_weights", "v_grid_obs"))
def cell_except(spark, d):
    return r.cell_except(_weights(spark, d).where("zone_id <> 'Z3'"), _obs(spark, d).where("cell_id <> 'C2'"))


@query("cells_distinct", with_views("SELECT count(DISTINCT cell_id) AS cells, count(DISTINCT zone_id) AS zones, round(sum(share), 6) AS shares FROM v_zone_weights", "v_zone_weights"))
def cells_distinct(spark, d):
    return _weights(spark, d).join(_obs(spark, d).select("cell_id").distinct(), "cell_id", "left_semi").agg(F.count_distinct("cell_id").alias("cells"), F.count_distinct("zone_id").alias("zones"), F.round(F.sum("share"), 6).alias("shares"))


@query("semi_keep", with_views("SELECT cell_id, count(*) AS intervals FROM v_grid_obs WHERE cell_id IN (SELECT cell_id FROM v_zone_weights WHERE zone_id = 'Z1') GROUP BY 1", "v_zone_weights", "v_grid_obs"))
def semi_keep(spark, d):
    return _obs(spark, d).join(_weights(spark, d).where("zone_id = 'Z1'"), "cell_id", "left_semi").groupBy("cell_id").agg(F.count("*").alias("intervals"))


_NAME = "printf('%04d%03d-%04d', year(interval_start), dayofyear(interval_start), hour(interval_start) * 60 + minute(interval_start))"


@query("granule_spine", with_views(f"SELECT {_NAME} AS name, count(cell_id) AS cells FROM ({_SPINE}) LEFT JOIN v_grid_obs USING (interval_start) GROUP BY 1", "v_grid_obs"))
def granule_spine(spark, d):
    return _spine(spark).join(_obs(spark, d), "interval_start", "left").groupBy("name").agg(F.count("cell_id").alias("cells"))


@query("coverage_stats", with_views(f"SELECT cell_id, count(*) AS expected, count(rate_mm_h) AS present, count(*) - count(rate_mm_h) AS absent, CAST(max(rate_mm_h) AS DOUBLE) AS highest FROM (SELECT DISTINCT cell_id FROM v_grid_obs) CROSS JOIN ({_SPINE}) LEFT JOIN v_grid_obs USING (cell_id, interval_start) GROUP BY 1", "v_grid_obs"))
def coverage_stats(spark, d):
    return r.coverage_stats(_spine(spark), _obs(spark, d))


@query("resolve_as_of", with_views(f"""SELECT {_T.format('as_of')}, complete_steps FROM (SELECT max(interval_start) AS as_of, count(*) AS complete_steps FROM (SELECT interval_start, count(*) AS n FROM ({_SPINE}) JOIN v_grid_obs USING (interval_start)
 WHERE interval_start > TIMESTAMP '2024-01-24 23:30:00' - INTERVAL 1 DAY GROUP BY 1) WHERE n = (SELECT count(DISTINCT cell_id) FROM v_grid_obs))""", "v_grid_obs"))
def resolve_as_of(spark, d):
    return r.resolve_as_of(_spine(spark), _obs(spark, d)).withColumn("as_of", _stamp("as_of"))


@query("ordered_distinct", with_views("SELECT zone_id, string_agg(cell_id, ',' ORDER BY cell_id) AS cells FROM (SELECT DISTINCT zone_id, cell_id FROM v_zone_weights JOIN v_grid_obs USING (cell_id)) GROUP BY 1", "v_zone_weights", "v_grid_obs"))
def ordered_distinct(spark, d):
    """Ids in order, each once: the set is collected, never the rows."""
    j = _obs(spark, d).select("cell_id").distinct().join(_weights(spark, d), "cell_id")
    return j.groupBy("zone_id").agg(F.array_join(F.array_sort(F.collect_set("cell_id")), ",").alias("cells"))


@query("granule_cache_plan", with_views(f"""SELECT {_NAME.replace('year(', 'year(').replace('printf', 'printf')} AS name, md5(string_agg(cell_id, ',' ORDER BY cell_id)) AS cells_digest, md5(string_agg(cell_id, ',' ORDER BY cell_id)) <> (SELECT md5(string_agg(cell_id, ',' ORDER BY cell_id)) FROM (SELECT DISTINCT cell_id FROM v_zone_weights)) AS refetch
 FROM v_grid_obs GROUP BY 1""", "v_zone_weights", "v_grid_obs"))
def granule_cache_plan(spark, d):
    """A half hour is fetched again if the digest of its cells differs from that of the cells the zones need."""
    digest = lambda c: F.md5(F.array_join(F.array_sort(F.collect_set(c)), ","))
    need = _weights(spark, d).agg(digest("cell_id").alias("need"))
    minute = F.hour("interval_start") * 60 + F.minute("interval_start")
    o = _obs(spark, d).groupBy(F.format_string("%04d%03d-%04d", F.year("interval_start"), F.dayofyear("interval_start"), minute).alias("name")).agg(digest("cell_id").alias("cells_digest"))
    return o.crossJoin(F.broadcast(need)).select("name", "cells_digest", (F.col("cells_digest") != F.col("need")).alias("refetch"))


@query("estimate_staleness", with_views("""SELECT cell_id, CASE WHEN age > 72 THEN 'dropped' WHEN age > 6 THEN 'stale' ELSE 'current' END AS wording, count(*) AS intervals FROM (SELECT cell_id, date_diff('second', interval_start, TIMESTAMP '2024-01-31 00:00:00') / 3600.0 AS age FROM v_grid_obs) GROUP BY 1, 2""", "v_grid_obs"))
def estimate_staleness(spark, d):
    age = F.timestamp_diff("SECOND", F.col("interval_start"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")) / 3600
    return _obs(spark, d).groupBy("cell_id", F.when(age > 72, "dropped").when(age > 6, "stale").otherwise("current").alias("wording")).agg(F.count("*").alias("intervals"))


@query("zone_accumulation", with_views("""SELECT zone_id, CASE WHEN refused IS NULL THEN run END AS run, CASE WHEN refused IS NULL THEN a END AS interval_start, CASE WHEN refused IS NULL THEN c + INTERVAL 30 MINUTE END AS interval_end, cells, missing, extra,
 CASE WHEN refused IS NULL THEN CAST(round(total, 6) AS DECIMAL(20, 6)) END AS total_mm, refused FROM (SELECT *, CASE WHEN given = 0 THEN 'no_observations' WHEN missing > 0 THEN 'missing_cells' WHEN extra > 0 THEN 'extra_cells' WHEN mixed THEN 'mixed_runs'
  WHEN twice THEN 'series_overlaps' WHEN gap THEN 'series_broken' WHEN run <> run1 THEN 'mixed_runs' WHEN a <> b OR c <> e THEN 'mixed_windows' END AS refused
 FROM (SELECT zone_id, count(n) AS given, count(share) AS cells, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (share IS NULL) AS extra, bool_or(r0 <> r1) AS mixed, bool_or(least_step < 30) AS twice, bool_or(most_step > 30) AS gap,
   min(r0) AS run, max(r1) AS run1, min(t0) AS a, max(t0) AS b, min(t1) AS c, max(t1) AS e, sum(mm * share) AS total
  FROM v_share FULL JOIN (SELECT zone_id, cell_id, count(*) AS n, min(run) AS r0, max(run) AS r1, min(interval_start) AS t0, max(interval_start) AS t1, min(step) AS least_step, max(step) AS most_step, CAST(sum(rate_mm_h * 0.5) AS DECIMAL(20, 7)) AS mm
   FROM (SELECT *, date_diff('minute', lag(interval_start) OVER (PARTITION BY zone_id, cell_id ORDER BY interval_start), interval_start) AS step FROM v_given) GROUP BY 1, 2) USING (zone_id, cell_id) GROUP BY 1))""", "v_share", "v_given"))
def zone_accumulation(spark, d):
    """A zone per customer, with every kind of refusal among them. A customer becomes some 15 rows, so customers are
    dealt first, at most about 20,000 to a task at any size."""
    customers = table(spark, d, "customer").select("c_custkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-customers.count() // 20_000))
    dealt = customers.repartition(tasks, "c_custkey")
    return r.zone_accumulation(view(spark, d, "v_share", customer=dealt), view(spark, d, "v_given", customer=dealt), tasks)
