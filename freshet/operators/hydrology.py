"""Reference floods and upstream travel lags, from regular series.

The lag sweep is an equi-join on a shifted time key, so no range join is needed; refusals carry reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offset_change(series: DataFrame, step: Column) -> DataFrame:
    """v(t) - v(t - step), only where both exist: an equi self-join on the shifted time."""
    before = series.select("gauge_id", (F.col("observed_at") + step).alias("observed_at"), F.col("level_m").alias("before_m"))
    return series.join(before, ["gauge_id", "observed_at"]).select("gauge_id", "observed_at", (F.col("level_m") - F.col("before_m")).alias("change_m"))


def quartiles(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact linearly interpolated quartiles and the 1 % and 99 % bounds."""
    p = lambda q: F.percentile(value, F.lit(q))
    return series.groupBy(*keys).agg(p(0.01).alias("p01"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"), p(0.99).alias("p99"))


def pearson(x: Column, y: Column, at_least: int = 3) -> Column:
    """Correlation aggregate; null with fewer pairs than at_least or a constant side. Not corr(), which fails on a constant
    side in ANSI mode even where its result is not asked for."""
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    return F.when((F.count_if(both) >= at_least) & (F.min(u) < F.max(u)) & (F.min(v) < F.max(v)), F.try_divide(F.covar_pop(u, v), F.stddev_pop(u) * F.stddev_pop(v)))


def yearly_stats(series: DataFrame, ceiling: Column, season: tuple[int, int]) -> DataFrame:
    """Peak and its first time, readings, readings in season, and what is above the ceiling (null: no ceiling)."""
    kept = ceiling.isNull() | (F.col("level_m") <= ceiling)
    month = F.month("observed_at")
    d = series.withColumns({"year": F.year("observed_at"), "_ok": kept, "_in": month.between(*season)})
    level = F.when(F.col("_ok"), F.col("level_m"))
    return d.groupBy("gauge_id", "year").agg(
        F.max(level).alias("peak_m"), F.min_by("observed_at", F.when(F.col("_ok"), F.struct(-F.col("level_m"), "observed_at"))).alias("peak_at"),
        F.count_if("_ok").alias("readings"), F.count_if(F.col("_ok") & F.col("_in")).alias("season_readings"), F.count_if(~F.col("_ok")).alias("discarded"),
    )


def reference_years(stats: DataFrame, season_steps: int) -> DataFrame:
    """Coverage class of each year (high from 0.75, partial from 0.40, else sparse), whether it is usable, and the
    highest peak of usable years per gauge."""
    share = F.round(F.col("season_readings") / season_steps, 6)
    s = stats.withColumn("coverage", share).withColumn("confidence", F.when(share >= 0.75, "high").when(share >= 0.4, "partial").otherwise("sparse"))
    usable = (F.col("confidence") != "sparse") & F.col("peak_m").isNotNull()
    best = F.max(F.when(usable, F.col("peak_m"))).over(Window.partitionBy("gauge_id"))
    return s.withColumns({"usable": usable, "best_usable_m": best})


def winsorised(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes clipped to the 1 % and 99 % bounds of their series and year."""
    q = quartiles(changes, keys, "change_m").select(*keys, "p01", "p99")
    return changes.join(q, keys).withColumn("change_m", F.least(F.greatest("change_m", "p01"), "p99"))


def lag_sweep(changes: DataFrame, pairs: DataFrame, lags: int, day: bool = True, quiet: float = 0.0) -> DataFrame:
    """(up, down, year, lag, pairs, corr): u(t) against d(t + lag) for each lag from 0; pairs whose sides both move
    less than quiet are left out. Only the upstream side is repeated per lag; the join is on (down, time)."""
    unit = "make_dt_interval(lag)" if day else "make_dt_interval(0, lag)"
    up = changes.join(pairs, F.col("gauge_id") == F.col("up")).select("up", "down", F.year("observed_at").alias("year"), "observed_at", F.col("change_m").alias("u"))
    moved = up.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("observed_at", F.expr(f"observed_at + {unit}"))
    down = changes.select(F.col("gauge_id").alias("down"), "observed_at", F.col("change_m").alias("d"))
    both = moved.join(down, ["down", "observed_at"]).where((F.abs("u") >= quiet) | (F.abs("d") >= quiet))
    return both.groupBy("up", "down", "year", "lag").agg(F.count("*").alias("pairs"), pearson(F.col("u"), F.col("d")).alias("corr"))


def lag_years(
    series: DataFrame, pairs: DataFrame, as_of: str, unit: str = "HOUR", change: int = 6, lags: int = 72, season: tuple[int, int] = (5, 10), quiet: float = 0.005, near: float = 0.02, least_coverage: float = 0.75,
    least_pairs: int = 800, least_rises: int = 5, rise: float = 0.02, apart: int = 24,
) -> DataFrame:
    """The best lag of every pair(up, down) in every year of either gauge, and why a year counts against a stable lag.

    Changes over `change` units within the season, of both gauges in the same year, are clipped to their 1 % and 99 %
    bounds and correlated for each lag; pairs whose sides both move less than quiet are left out. best_lag has the highest
    correlation (rounded to 8 places; the smallest of equals), near_low to near_high are within `near` of it, gain is
    over lag 0 (null where lag 0 has none), ordinary_corr is without clipping.

    reasons: year_in_progress, upstream_coverage and downstream_coverage (too few times of the season), no_changes (of
    either gauge), no_variance (no lag can be correlated), few_pairs (at the best lag), few_rises (of the upstream
    gauge, `apart` units from each other). eligible: none of them. Years of a gauge are aggregated before any join, and
    only the upstream changes are repeated per lag; the joins are on gauge, year and time."""
    step = lambda n: F.expr(f"make_dt_interval({n})" if unit == "DAY" else f"make_dt_interval(0, {n})")
    of = lambda d, role: d.withColumnsRenamed({c: f"{role}_{c}" for c in d.columns if c not in ("gauge_id", "year")}).withColumnRenamed("gauge_id", role)
    day = lambda month: F.make_date("year", F.lit(month), F.lit(1))
    inside = F.month("observed_at").between(*season)
    last = F.when(F.lit(season[1] == 12), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))).otherwise(day(season[1] % 12 + 1))
    dated = series.withColumn("year", F.year("observed_at"))
    steps = F.date_diff(last, day(season[0])) * (1 if unit == "DAY" else 24)
    years = dated.groupBy("gauge_id", "year").agg(F.count_distinct(F.when(inside, F.col("observed_at"))).alias("n")).select("gauge_id", "year", (F.col("n") / steps).alias("coverage"))
    changes = offset_change(series, step(change)).where(inside).withColumn("year", F.year("observed_at"))
    bounds = changes.groupBy("gauge_id", "year").agg(F.percentile("change_m", F.lit(0.01)).alias("p01"), F.percentile("change_m", F.lit(0.99)).alias("p99"))
    rises = rise_events(changes, rise, step(apart)).select("gauge_id", "year", F.col("events").alias("rises"))
    known = years.join(bounds.select("gauge_id", "year", F.lit(True).alias("moves")), ["gauge_id", "year"], "left").join(rises, ["gauge_id", "year"], "left")
    spans = pairs.join(years.select(F.col("gauge_id").alias("up"), "year"), "up").select("up", "down", "year").union(pairs.join(years.select(F.col("gauge_id").alias("down"), "year"), "down").select("up", "down", "year")).distinct()
    frame = spans.join(of(known, "up"), ["up", "year"], "left").join(of(known, "down"), ["down", "year"], "left")

    clipped = changes.join(bounds, ["gauge_id", "year"]).withColumn("clipped", F.least(F.greatest("change_m", "p01"), "p99"))
    up = clipped.join(pairs, F.col("gauge_id") == F.col("up")).select("up", "down", "year", "observed_at", F.col("change_m").alias("u"), F.col("clipped").alias("cu"))
    moved = up.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("observed_at", F.col("observed_at") + F.expr("make_dt_interval(lag)" if unit == "DAY" else "make_dt_interval(0, lag)"))
    down = clipped.select(F.col("gauge_id").alias("down"), "year", "observed_at", F.col("change_m").alias("d"), F.col("clipped").alias("cd"))
    both = moved.join(down, ["down", "year", "observed_at"]).where((F.abs("u") >= quiet) | (F.abs("d") >= quiet))
    sweep = both.groupBy("up", "down", "year", "lag").agg(F.count("*").alias("pairs"), F.round(pearson(F.col("cu"), F.col("cd")), 8).alias("c"), pearson(F.col("u"), F.col("d")).alias("ordinary"))
    best = sweep.where("c is not null").groupBy("up", "down", "year").agg(
        F.max_by(F.struct("lag", "c", "ordinary", "pairs"), F.struct("c", -F.col("lag"))).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("c"))).alias("zero"), F.collect_list(F.struct("lag", "c")).alias("lags"),
    )
    close = F.transform(F.filter("lags", lambda x: x["c"] >= F.col("b.c") - near), lambda x: x["lag"])
    fitted = frame.join(best, ["up", "down", "year"], "left").withColumn("close", close)
    month = F.month(F.lit(as_of).cast("date"))
    done = (F.col("year") < F.year(F.lit(as_of).cast("date"))) | ((F.col("year") == F.year(F.lit(as_of).cast("date"))) & (month > season[1]))
    cover = lambda role: F.coalesce(F.col(f"{role}_coverage"), F.lit(0.0))
    still = F.col("up_moves").isNull() | F.col("down_moves").isNull()
    reasons = F.concat_ws(
        ",", F.when(~done, "year_in_progress"), F.when(cover("up") < least_coverage, "upstream_coverage"), F.when(cover("down") < least_coverage, "downstream_coverage"), F.when(still, "no_changes"),
        F.when(~still & F.col("b").isNull(), "no_variance"), F.when(F.col("b.pairs") < least_pairs, "few_pairs"), F.when(F.col("b").isNotNull() & (F.coalesce("up_rises", F.lit(0)) < least_rises), "few_rises"),
    )
    return fitted.select(
        "up", "down", "year", F.col("b.lag").alias("best_lag"), F.round("b.c", 6).alias("best_corr"), F.round("b.ordinary", 6).alias("ordinary_corr"), F.array_min("close").alias("near_low"), F.array_max("close").alias("near_high"),
        F.round(F.col("b.c") - F.col("zero"), 6).alias("gain"), F.coalesce("b.pairs", F.lit(0)).alias("pairs"), F.coalesce("up_rises", F.lit(0)).alias("rises"), F.round(cover("up"), 6).alias("up_coverage"),
        F.round(cover("down"), 6).alias("down_coverage"), reasons.alias("reasons"), (reasons == "").alias("eligible"),
    )


def lag_quality(
    fits: DataFrame, least_years: int = 3, least_corr: float = 0.35, corr_share: float = 0.7, stable: float = 12, stable_share: float = 0.7, most_iqr: float = 12, least_lead: float = 1, least_gain: float = 0.02,
) -> DataFrame:
    """Seven gates over the eligible years of a pair, the names of those that fail, and a recommendation: review only if
    none does. The recommended lag is the years' median (null without an eligible year); lags, their spread and `stable`
    share the unit of the sweep. Without an eligible year shares are 0 and every gate fails."""
    ok = F.col("eligible")
    of = lambda c: F.when(ok, F.col(c))
    g = fits.groupBy("up", "down").agg(
        F.count("*").alias("years"), F.count_if(ok).alias("eligible_years"), F.percentile(of("best_lag"), F.lit(0.5)).alias("recommended_lag"), F.min(of("best_lag")).alias("lowest_lag"), F.max(of("best_lag")).alias("highest_lag"),
        (F.percentile(of("best_lag"), F.lit(0.75)) - F.percentile(of("best_lag"), F.lit(0.25))).alias("lag_iqr"), F.round(F.median(of("best_corr")), 6).alias("median_corr"), F.round(F.median(of("gain")), 6).alias("median_gain"),
        F.count_if(ok & (F.col("best_corr") >= least_corr)).alias("_corr"), F.collect_list(of("best_lag")).alias("_lags"),
    )
    share = lambda n: F.coalesce(F.try_divide(n, F.col("eligible_years")), F.lit(0.0))
    g = g.withColumns({"_corr": share(F.col("_corr")), "_stable": share(F.size(F.filter("_lags", lambda x: F.abs(x - F.col("recommended_lag")) <= stable)))})
    gates = {
        "enough_completed_years": F.col("eligible_years") >= least_years, "median_correlation": F.col("median_corr") >= least_corr, "correlated_year_fraction": F.col("_corr") >= corr_share,
        "lag_iqr": F.col("lag_iqr") <= most_iqr, "stable_year_fraction": F.col("_stable") >= stable_share, "positive_lead_time": F.col("recommended_lag") >= least_lead, "improves_on_zero_lag": F.col("median_gain") >= least_gain,
    }
    failed = F.concat_ws(",", *[F.when(~F.coalesce(passes, F.lit(False)), name) for name, passes in gates.items()])
    g = g.withColumns({"failed": failed, "correlated_share": F.round("_corr", 6), "stable_share": F.round("_stable", 6)})
    return g.drop("_corr", "_lags", "_stable").withColumn("recommendation", F.when(F.col("failed") == "", "review").otherwise("reject"))


def rise_events(changes: DataFrame, least: float, apart: Column) -> DataFrame:
    """Rises of at least max(least, 90 % of positive changes), counted greedily: the next one counted is at least
    `apart` after the last one counted. The fold runs over one gauge-year's candidate times."""
    years = changes.withColumn("year", F.year("observed_at"))
    bound = years.where("change_m > 0").groupBy("gauge_id", "year").agg(F.greatest(F.lit(least), F.percentile("change_m", F.lit(0.9))).alias("bound"))
    rises = years.join(bound, ["gauge_id", "year"]).where("change_m >= bound").groupBy("gauge_id", "year").agg(F.array_sort(F.collect_list("observed_at")).alias("at"))
    none = F.lit(None).cast("timestamp_ntz")
    count = F.aggregate("at", F.struct(F.lit(0).alias("n"), none.alias("last")), lambda a, t: F.when(a["last"].isNull() | (t >= a["last"] + apart), F.struct((a["n"] + 1).alias("n"), t.alias("last"))).otherwise(a), lambda a: a["n"])
    return rises.select("gauge_id", "year", F.size("at").alias("candidates"), count.alias("events"))


def season_coverage(series: DataFrame, season: tuple[int, int], steps: int) -> DataFrame:
    inside = series.where(F.month("observed_at").between(*season))
    return inside.groupBy("gauge_id", F.year("observed_at").alias("year")).agg(F.count_distinct("observed_at").alias("present"), F.round(F.count_distinct("observed_at") / steps, 6).alias("coverage"))


def asof_last(events: DataFrame, key: str, at: str, value: str, as_of: Column) -> DataFrame:
    """Last value of each key at the clock."""
    return events.where(F.col(at) <= as_of).groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value), F.max(at).alias(at))


def asof_previous(revisions: DataFrame) -> DataFrame:
    """For each revision, the newest earlier one of the same entity (by report date, fetch time, id)."""
    w = Window.partitionBy("entity_id").orderBy("report_date", "fetched_at", "revision_id")
    return revisions.withColumn("previous_id", F.lag("revision_id").over(w)).withColumn("previous_metric", F.lag("metric").over(w))


def day_streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """Longest and last run of consecutive days per key: days minus their rank are constant within a run."""
    d = days.select(key, day).distinct()
    rn = F.row_number().over(Window.partitionBy(key).orderBy(day))
    runs = d.withColumn("run", F.date_sub(F.col(day), rn)).groupBy(key, "run").agg(F.count("*").alias("n"), F.max(day).alias("end"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "end").alias("last_run"), F.max("end").alias("last_day"))


def season_losses(daily: DataFrame, first: str, last: str) -> DataFrame:
    """Cumulative sums on a complete date spine; a missing date leaves a null and is listed as a gap."""
    spine = daily.select("entity").distinct().withColumn("day", F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 1 month)")))
    j = spine.join(daily, ["entity", "day"], "left")
    w = Window.partitionBy("entity").orderBy("day")
    gaps = F.count_if(F.col("amount").isNull()).over(w)
    return j.select("entity", "day", "amount", gaps.alias("gaps"), F.when(gaps == 0, F.sum("amount").over(w)).alias("cumulative"))
