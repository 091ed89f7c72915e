"""Hydrology queries: reference floods, lags, seasons and revisions over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import hydrology as h
from freshet.plans.bindings import view, with_views
from freshet.plans.registry import query



def _daily(spark, d):
    return view(spark, d, "v_daily")


def _changes(spark, d):
    return h.offset_change(_daily(spark, d), F.expr("interval 1 day"))


_CHANGES = "SELECT a.gauge_id, a.observed_at, a.level_m - b.level_m AS change_m FROM v_daily a JOIN v_daily b ON a.gauge_id = b.gauge_id AND a.observed_at = b.observed_at + INTERVAL 1 DAY"


@query("offset_change", with_views("""SELECT a.gauge_id, strftime(a.observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, round(a.level_m - b.level_m, 6) AS change_m
FROM v_readings a JOIN v_readings b ON a.gauge_id = b.gauge_id AND a.observed_at = b.observed_at + INTERVAL 6 HOUR""", "v_readings"))
def offset_change(spark, d):
    c = h.offset_change(view(spark, d, "v_readings"), F.expr("interval 6 hours"))
    return c.select("gauge_id", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), F.round("change_m", 6).alias("change_m"))


@query("exact_percentile", with_views("""SELECT gauge_id, round(quantile_cont(level_m, 0.01), 6) AS p01, round(quantile_cont(level_m, 0.25), 6) AS q1, round(quantile_cont(level_m, 0.5), 6) AS median,
 round(quantile_cont(level_m, 0.75), 6) AS q3, round(quantile_cont(level_m, 0.99), 6) AS p99 FROM v_daily GROUP BY 1""", "v_daily"))
def exact_percentile(spark, d):
    q = h.quartiles(_daily(spark, d), ["gauge_id"], "level_m")
    return q.select("gauge_id", *[F.round(c, 6).alias(c) for c in ("p01", "q1", "median", "q3", "p99")])


@query("median_point", with_views("SELECT owner_id, round(median(lon), 6) AS lon, round(median(lat), 6) AS lat, count(*) AS points FROM v_points GROUP BY 1", "v_points"))
def median_point(spark, d):
    return view(spark, d, "v_points").groupBy("owner_id").agg(F.round(F.median("lon"), 6).alias("lon"), F.round(F.median("lat"), 6).alias("lat"), F.count("*").alias("points"))


_CORR = "CASE WHEN count(*) >= 3 AND min({0}) < max({0}) AND min({1}) < max({1}) THEN round(corr({0}, {1}), 6) END"


@query("pearson", with_views(f"""SELECT a.gauge_id AS up, b.gauge_id AS down, count(*) AS pairs, {_CORR.format('a.level_m', 'b.level_m')} AS corr FROM v_daily a JOIN v_daily b ON a.observed_at = b.observed_at AND a.gauge_id < b.gauge_id GROUP BY 1, 2""", "v_daily"))
def pearson(spark, d):
    a = _daily(spark, d)
    b = a.select(F.col("gauge_id").alias("down"), "observed_at", F.col("level_m").alias("y"))
    j = a.join(b, "observed_at").where("gauge_id < down")
    return j.groupBy(F.col("gauge_id").alias("up"), "down").agg(F.count("*").alias("pairs"), F.round(h.pearson(F.col("level_m"), F.col("y")), 6).alias("corr"))


_WINS = f"""SELECT c.gauge_id, y, observed_at, least(greatest(change_m, p01), p99) AS change_m FROM (SELECT *, year(observed_at) AS y FROM ({_CHANGES})) c
 JOIN (SELECT gauge_id, year(observed_at) AS y, quantile_cont(change_m, 0.01) AS p01, quantile_cont(change_m, 0.99) AS p99 FROM ({_CHANGES}) GROUP BY 1, 2) q USING (gauge_id, y)"""


def _winsorised(spark, d):
    return h.winsorised(_changes(spark, d).withColumn("y", F.year("observed_at")), ["gauge_id", "y"])


@query("winsor_corr", with_views(f"""SELECT a.gauge_id AS up, b.gauge_id AS down, a.y, count(*) AS pairs, {_CORR.format('a.change_m', 'b.change_m')} AS corr FROM ({_WINS}) a JOIN ({_WINS}) b ON a.observed_at = b.observed_at AND a.gauge_id < b.gauge_id GROUP BY 1, 2, 3""", "v_daily"))
def winsor_corr(spark, d):
    w = _winsorised(spark, d)
    b = w.select(F.col("gauge_id").alias("down"), "observed_at", F.col("change_m").alias("v"))
    j = w.join(b, "observed_at").where("gauge_id < down")
    return j.groupBy(F.col("gauge_id").alias("up"), "down", "y").agg(F.count("*").alias("pairs"), F.round(h.pearson(F.col("change_m"), F.col("v")), 6).alias("corr"))


_STATS = """SELECT gauge_id, year(observed_at) AS year, max(level_m) FILTER (level_m <= 400) AS peak_m, count(*) FILTER (level_m <= 400) AS readings,
 count(*) FILTER (level_m <= 400 AND month(observed_at) BETWEEN 6 AND 9) AS season_readings, count(*) FILTER (level_m > 400) AS discarded,
 arg_min(observed_at, (-level_m, observed_at)) FILTER (level_m <= 400) AS peak_at FROM v_daily GROUP BY 1, 2"""


def _stats(spark, d):
    return h.yearly_stats(_daily(spark, d), F.lit(400.0), (6, 9))


@query("yearly_peak", with_views(f"SELECT gauge_id, year, peak_m, strftime(peak_at, '%Y-%m-%d') AS peak_at, readings, season_readings, discarded FROM ({_STATS})", "v_daily"))
def yearly_peak(spark, d):
    return _stats(spark, d).withColumn("peak_at", F.date_format("peak_at", "yyyy-MM-dd"))


@query("reference_years", with_views(f"""SELECT *, max(peak_m) FILTER (usable) OVER (PARTITION BY gauge_id) AS best_usable_m FROM (
 SELECT gauge_id, year, coverage, confidence, confidence <> 'sparse' AND peak_m IS NOT NULL AS usable, peak_m FROM (
  SELECT *, CASE WHEN coverage >= 0.75 THEN 'high' WHEN coverage >= 0.4 THEN 'partial' ELSE 'sparse' END AS confidence FROM (SELECT *, round(season_readings / 122, 6) AS coverage FROM ({_STATS}))))""", "v_daily"))
def reference_years(spark, d):
    return h.reference_years(_stats(spark, d), 122).select("gauge_id", "year", "coverage", "confidence", "usable", "peak_m", "best_usable_m")


@query("season_coverage", with_views("SELECT gauge_id, year(observed_at) AS year, count(DISTINCT observed_at) AS present, round(count(DISTINCT observed_at) / 184, 6) AS coverage FROM v_daily WHERE month(observed_at) BETWEEN 5 AND 10 GROUP BY 1, 2", "v_daily"))
def season_coverage(spark, d):
    return h.season_coverage(_daily(spark, d), (5, 10), 184)


LAGS = 24
_SWEEP = f"""SELECT u.gauge_id AS up, v.gauge_id AS down, year(u.observed_at) AS year, lag, count(*) AS pairs, CASE WHEN count(*) >= 3 AND min(u.change_m) < max(u.change_m) AND min(v.change_m) < max(v.change_m) THEN corr(u.change_m, v.change_m) END AS corr
 FROM ({_CHANGES}) u CROSS JOIN (SELECT unnest(range(0, {LAGS + 1})) AS lag) JOIN ({_CHANGES}) v ON v.observed_at = u.observed_at + INTERVAL 1 DAY * CAST(lag AS INTEGER)
 WHERE (u.gauge_id, v.gauge_id) IN (('A', 'N'), ('N', 'R'), ('A', 'R')) AND (abs(u.change_m) >= 5 OR abs(v.change_m) >= 5) GROUP BY 1, 2, 3, 4"""


def _sweep(spark, d):
    pairs = spark.createDataFrame([("A", "N"), ("N", "R"), ("A", "R")], "up string, down string")
    return h.lag_sweep(_changes(spark, d), pairs, LAGS, quiet=5.0)


@query("lag_sweep", with_views(f"SELECT up, down, year, CAST(lag AS INTEGER) AS lag, pairs, round(corr, 6) AS corr FROM ({_SWEEP})", "v_daily"))
def lag_sweep(spark, d):
    return _sweep(spark, d).withColumn("corr", F.round("corr", 6))


#: Three gauges, and one that repeats the first of them five days later with noise of its own.
_LAGGED = """SELECT gauge_id, observed_at, level_m FROM v_daily UNION ALL SELECT 'A5' AS gauge_id, observed_at + INTERVAL 5 DAY AS observed_at, level_m + extract('day' FROM observed_at) % 4 * 9 AS level_m FROM v_daily WHERE gauge_id = 'A'"""
_PAIRS = "(VALUES ('A', 'A5'), ('A', 'N'), ('N', 'R'), ('A', 'R'), ('N', 'none')) AS p(up, down)"
_AT = "1998-07-15"
_FIT = f"""SELECT up, down, year, best_lag, round(c, 6) AS best_corr, round(ordinary, 6) AS ordinary_corr, near_low, near_high, round(c - zero, 6) AS gain, coalesce(pairs, 0) AS pairs, rises, round(uc, 6) AS up_coverage, round(dc, 6) AS down_coverage, reasons, reasons = '' AS eligible FROM (
 SELECT *, concat_ws(',', CASE WHEN NOT (year < 1998 OR (year = 1998 AND 7 > 10)) THEN 'year_in_progress' END, CASE WHEN uc < 0.75 THEN 'upstream_coverage' END, CASE WHEN dc < 0.75 THEN 'downstream_coverage' END, CASE WHEN still THEN 'no_changes' END,
  CASE WHEN NOT still AND c IS NULL THEN 'no_variance' END, CASE WHEN pairs < 100 THEN 'few_pairs' END, CASE WHEN c IS NOT NULL AND rises < 5 THEN 'few_rises' END) AS reasons FROM (
  SELECT y.up, y.down, y.year, coalesce(ku.coverage, 0) AS uc, coalesce(kd.coverage, 0) AS dc, coalesce(ku.rises, 0) AS rises, ku.moves IS NULL OR kd.moves IS NULL AS still, f.* EXCLUDE (up, down, year)
  FROM (SELECT DISTINCT up, down, year FROM {_PAIRS} JOIN (SELECT DISTINCT gauge_id, year(observed_at) AS year FROM lg) g ON gauge_id IN (up, down)) y
  LEFT JOIN kn ku ON ku.gauge_id = y.up AND ku.year = y.year LEFT JOIN kn kd ON kd.gauge_id = y.down AND kd.year = y.year LEFT JOIN (
   SELECT up, down, year, min(lag) FILTER (c = best) AS best_lag, max(best) AS c, arg_min(ordinary, lag) FILTER (c = best) AS ordinary, arg_min(pairs, lag) FILTER (c = best) AS pairs, max(c) FILTER (lag = 0) AS zero,
    min(lag) FILTER (c >= best - 0.02) AS near_low, max(lag) FILTER (c >= best - 0.02) AS near_high FROM (SELECT *, max(c) OVER (PARTITION BY up, down, year) AS best FROM sw WHERE c IS NOT NULL) GROUP BY 1, 2, 3) f ON f.up = y.up AND f.down = y.down AND f.year = y.year))"""
_FIT_WITH = f"""WITH lg AS ({_LAGGED}), ch AS (SELECT a.gauge_id, year(a.observed_at) AS year, a.observed_at, a.level_m - b.level_m AS change_m FROM lg a JOIN lg b ON a.gauge_id = b.gauge_id AND a.observed_at = b.observed_at + INTERVAL 2 DAY WHERE month(a.observed_at) BETWEEN 5 AND 10),
bd AS (SELECT gauge_id, year, quantile_cont(change_m, 0.01) AS p01, quantile_cont(change_m, 0.99) AS p99, greatest(5, quantile_cont(change_m, 0.9) FILTER (change_m > 0)) AS bound FROM ch GROUP BY 1, 2),
ri AS (SELECT gauge_id, year, observed_at FROM ch JOIN bd USING (gauge_id, year) WHERE change_m >= bound),
ev AS (SELECT gauge_id, year, min(observed_at) AS last, 1 AS n FROM ri GROUP BY 1, 2 UNION ALL SELECT e.gauge_id, e.year, min(ri.observed_at), e.n + 1 FROM ev e JOIN ri ON ri.gauge_id = e.gauge_id AND ri.year = e.year AND ri.observed_at >= e.last + INTERVAL 3 DAY GROUP BY e.gauge_id, e.year, e.n),
kn AS (SELECT * FROM (SELECT gauge_id, year(observed_at) AS year, count(DISTINCT observed_at) FILTER (month(observed_at) BETWEEN 5 AND 10) / 184 AS coverage FROM lg GROUP BY 1, 2) LEFT JOIN (SELECT gauge_id, year, true AS moves FROM bd) USING (gauge_id, year) LEFT JOIN (SELECT gauge_id, year, max(n) AS rises FROM ev GROUP BY 1, 2) USING (gauge_id, year)),
cl AS (SELECT ch.*, least(greatest(change_m, p01), p99) AS clipped FROM ch JOIN bd USING (gauge_id, year)),
sw AS (SELECT up, down, u.year, CAST(lag AS INTEGER) AS lag, count(*) AS pairs, CASE WHEN count(*) >= 3 AND min(u.clipped) < max(u.clipped) AND min(d.clipped) < max(d.clipped) THEN round(corr(u.clipped, d.clipped), 8) END AS c,
 CASE WHEN count(*) >= 3 AND min(u.change_m) < max(u.change_m) AND min(d.change_m) < max(d.change_m) THEN corr(u.change_m, d.change_m) END AS ordinary
 FROM {_PAIRS} JOIN cl u ON u.gauge_id = up CROSS JOIN (SELECT unnest(range(0, {LAGS + 1})) AS lag) JOIN cl d ON d.gauge_id = down AND d.year = u.year AND d.observed_at = u.observed_at + INTERVAL 1 DAY * CAST(lag AS INTEGER) WHERE abs(u.change_m) >= 5 OR abs(d.change_m) >= 5 GROUP BY 1, 2, 3, 4)
"""


def _recursive(sql):
    return with_views(sql, "v_daily").replace("WITH v_daily", "WITH RECURSIVE v_daily", 1)


def _fits(spark, d):
    daily = _daily(spark, d)
    later = daily.where("gauge_id = 'A'").select(F.lit("A5").alias("gauge_id"), (F.col("observed_at") + F.expr("interval 5 days")).alias("observed_at"), (F.col("level_m") + F.day("observed_at") % 4 * 9).alias("level_m"))
    pairs = spark.createDataFrame([("A", "A5"), ("A", "N"), ("N", "R"), ("A", "R"), ("N", "none")], "up string, down string")
    return h.lag_years(daily.unionByName(later), pairs, _AT, "DAY", 2, LAGS, quiet=5.0, least_pairs=100, rise=5.0, apart=3)


@query("lag_year_fit", _recursive(_FIT_WITH + _FIT))
def lag_year_fit(spark, d):
    return _fits(spark, d)


@query("lag_quality", _recursive(_FIT_WITH + f"""SELECT *, CASE WHEN failed = '' THEN 'review' ELSE 'reject' END AS recommendation FROM (
 SELECT up, down, years, eligible_years, recommended_lag, lowest_lag, highest_lag, lag_iqr, median_corr, median_gain, round(corr_part, 6) AS correlated_share, round(stable_part, 6) AS stable_share, concat_ws(',',
  CASE WHEN eligible_years < 3 THEN 'enough_completed_years' END, CASE WHEN NOT coalesce(median_corr >= 0.35, false) THEN 'median_correlation' END, CASE WHEN corr_part < 0.7 THEN 'correlated_year_fraction' END, CASE WHEN NOT coalesce(lag_iqr <= 12, false) THEN 'lag_iqr' END,
  CASE WHEN stable_part < 0.7 THEN 'stable_year_fraction' END, CASE WHEN NOT coalesce(recommended_lag >= 1, false) THEN 'positive_lead_time' END, CASE WHEN NOT coalesce(median_gain >= 0.02, false) THEN 'improves_on_zero_lag' END) AS failed
 FROM (SELECT *, coalesce(n_corr / nullif(eligible_years, 0), 0.0) AS corr_part, coalesce(len(list_filter(lags, lambda x: abs(x - recommended_lag) <= 12)) / nullif(eligible_years, 0), 0.0) AS stable_part FROM (
  SELECT up, down, count(*) AS years, count(*) FILTER (eligible) AS eligible_years, quantile_cont(CAST(best_lag AS DOUBLE), 0.5) FILTER (eligible) AS recommended_lag, min(best_lag) FILTER (eligible) AS lowest_lag, max(best_lag) FILTER (eligible) AS highest_lag,
   quantile_cont(CAST(best_lag AS DOUBLE), 0.75) FILTER (eligible) - quantile_cont(CAST(best_lag AS DOUBLE), 0.25) FILTER (eligible) AS lag_iqr, round(median(best_corr) FILTER (eligible), 6) AS median_corr, round(median(gain) FILTER (eligible), 6) AS median_gain,
   count(*) FILTER (eligible AND best_corr >= 0.35) AS n_corr, list(best_lag) FILTER (eligible) AS lags FROM ({_FIT}) GROUP BY 1, 2)))"""))
def lag_quality(spark, d):
    return h.lag_quality(_fits(spark, d))


@query("rise_events", with_views(f"""WITH RECURSIVE c AS (SELECT *, year(observed_at) AS year FROM ({_CHANGES})), b AS (SELECT gauge_id, year, greatest(0.02, quantile_cont(change_m, 0.9)) AS bound FROM c WHERE change_m > 0 GROUP BY 1, 2),
r AS (SELECT gauge_id, year, observed_at FROM c JOIN b USING (gauge_id, year) WHERE change_m >= bound),
f AS (SELECT gauge_id, year, min(observed_at) AS last, 1 AS n FROM r GROUP BY 1, 2 UNION ALL
 SELECT f.gauge_id, f.year, (SELECT min(r.observed_at) FROM r WHERE r.gauge_id = f.gauge_id AND r.year = f.year AND r.observed_at >= f.last + INTERVAL 3 DAY), n + 1 FROM f
 WHERE EXISTS (SELECT 1 FROM r WHERE r.gauge_id = f.gauge_id AND r.year = f.year AND r.observed_at >= f.last + INTERVAL 3 DAY))
SELECT gauge_id, year, (SELECT count(*) FROM r WHERE r.gauge_id = f.gauge_id AND r.year = f.year) AS candidates, max(n) AS events FROM f GROUP BY 1, 2""", "v_daily").replace("WITH v_daily", "WITH RECURSIVE v_daily").replace(", RECURSIVE c", ", c"))
def rise_events(spark, d):
    return h.rise_events(_changes(spark, d), 0.02, F.expr("interval 3 days"))


@query("asof_last", with_views("SELECT entity_id, arg_max(metric, (fetched_at, metric)) AS metric, strftime(max(fetched_at), '%Y-%m-%d') AS fetched_at FROM v_revisions WHERE fetched_at <= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1", "v_revisions"))
def asof_last(spark, d):
    r = h.asof_last(view(spark, d, "v_revisions"), "entity_id", "fetched_at", "metric", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return r.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd"))


_PREV = "SELECT revision_id, entity_id, metric, lag(revision_id) OVER w AS previous_id, lag(metric) OVER w AS previous_metric FROM v_revisions WINDOW w AS (PARTITION BY entity_id ORDER BY report_date, fetched_at, revision_id)"


@query("asof_previous", with_views(f"SELECT revision_id, previous_id, previous_metric FROM ({_PREV})", "v_revisions"))
def asof_previous(spark, d):
    return h.asof_previous(view(spark, d, "v_revisions")).select("revision_id", "previous_id", "previous_metric")


@query("summary_delta", with_views(f"SELECT revision_id, round(metric - previous_metric, 4) AS delta FROM ({_PREV})", "v_revisions"))
def summary_delta(spark, d):
    """Period over period; null where there is no earlier report."""
    return h.asof_previous(view(spark, d, "v_revisions")).select("revision_id", F.round(F.col("metric") - F.col("previous_metric"), 4).alias("delta"))


@query("day_streak", with_views("""SELECT publication_state, max(n) AS longest, arg_max(n, last) AS last_run, strftime(max(last), '%Y-%m-%d') AS last_day FROM (SELECT publication_state, run, count(*) AS n, max(day) AS last FROM (
 SELECT *, day - CAST(row_number() OVER (PARTITION BY publication_state ORDER BY day) AS INTEGER) AS run FROM (SELECT DISTINCT publication_state, CAST(fetched_at AS DATE) AS day FROM v_revisions)) GROUP BY 1, 2) GROUP BY 1""", "v_revisions"))
def day_streak(spark, d):
    days = view(spark, d, "v_revisions").select("publication_state", F.to_date("fetched_at").alias("day"))
    return h.day_streaks(days, "publication_state", "day").withColumn("last_day", F.date_format("last_day", "yyyy-MM-dd"))


_MONTHS = """SELECT entity_id % 5 AS entity, CAST(report_date AS DATE) AS day, round(arg_max(metric, (fetched_at, revision_id)), 2) AS amount FROM v_revisions WHERE publication_state <> 'quarantined' AND month(report_date) <> 4 GROUP BY 1, 2"""


@query("season_losses", with_views(f"""SELECT entity, strftime(day, '%Y-%m-%d') AS day, amount, CAST(gaps AS BIGINT) AS gaps, CASE WHEN gaps = 0 THEN round(cum, 2) END AS cumulative FROM (
 SELECT entity, day, amount, count(*) FILTER (amount IS NULL) OVER w AS gaps, sum(amount) OVER w AS cum FROM (SELECT DISTINCT entity_id % 5 AS entity FROM v_revisions) CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS DATE) AS day)
 LEFT JOIN ({_MONTHS}) USING (entity, day) WINDOW w AS (PARTITION BY entity ORDER BY day))""", "v_revisions"))
def season_losses(spark, d):
    r = view(spark, d, "v_revisions").withColumns({"entity": F.col("entity_id") % 5, "day": F.to_date("report_date")}).where("publication_state <> 'quarantined' and month(report_date) <> 4")
    monthly = r.groupBy("entity", "day").agg(F.round(F.max_by("metric", F.struct("fetched_at", "revision_id")), 2).alias("amount"))
    entities = view(spark, d, "v_revisions").select((F.col("entity_id") % 5).alias("entity")).distinct()
    full = monthly.unionByName(entities.withColumns({"day": F.lit("1900-01-01").cast("date"), "amount": F.lit(None).cast("double")}))
    return h.season_losses(full, "1997-01-01", "1997-12-01").withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "cumulative": F.round("cumulative", 2)})
