"""Gridded rainfall: contiguity, accumulation, area-weighted zone totals and trailing windows.

Totals are all or nothing. A refused window names the first reason that holds: a cell is missing, its series is
broken, or the window is not covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_HOUR = "interval 30 minutes"


def contiguity(obs: DataFrame) -> DataFrame:
    """Per cell: steps whose predecessor ends where they start, gaps and overlaps."""
    w = Window.partitionBy("cell_id").orderBy("interval_start")
    step = F.timestamp_diff("MINUTE", F.lag("interval_start").over(w), F.col("interval_start"))
    d = obs.withColumn("_step", step)
    return d.groupBy("cell_id").agg(F.count("*").alias("intervals"), F.count_if(F.col("_step") == 30).alias("joined"), F.count_if(F.col("_step") > 30).alias("gaps"), F.count_if(F.col("_step") < 30).alias("overlaps"))


def accumulate(obs: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Rate times duration in decimal arithmetic."""
    return obs.groupBy(*keys).agg(F.sum(F.col("rate_mm_h") * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(20,4)").alias("total_mm"), F.count("*").alias("intervals"))


def windows(spark, hours: tuple[int, ...], as_of: str) -> DataFrame:
    """A handful of trailing windows that end at the clock."""
    w = spark.createDataFrame([(h,) for h in hours], "window_hours int")
    end = F.lit(as_of).cast("timestamp_ntz")
    return w.select("window_hours", (end - F.make_dt_interval(hours=F.col("window_hours"))).alias("window_start"), end.alias("window_end"))


def in_windows(obs: DataFrame, win: DataFrame) -> DataFrame:
    """Observations with each window that holds their whole interval. The windows are a constant handful, so
    they are broadcast; observations older than the longest window never leave the scan."""
    end = F.col("interval_start") + F.expr(HALF_HOUR)
    return obs.join(F.broadcast(win), (F.col("interval_start") >= F.col("window_start")) & (end <= F.col("window_end")))


def zone_totals(weights: DataFrame, cell_totals: DataFrame, by: list[str], total: str = "total_mm") -> DataFrame:
    """Area-weighted zone totals, null unless every cell of the zone has one. Weights are one row per zone and cell."""
    cells = weights.groupBy("zone_id").agg(F.count("*").alias("cells"))
    j = weights.join(cell_totals, "cell_id").groupBy("zone_id", *by).agg(F.count(total).alias("present"), F.sum(F.col(total).cast("double") * F.col("share")).alias("_t"))
    out = j.join(cells, "zone_id")
    return out.select("zone_id", *by, "cells", "present", F.when(F.col("cells") == F.col("present"), F.round("_t", 6)).alias("total_mm"))


def window_totals(weights: DataFrame, obs: DataFrame, win: DataFrame) -> DataFrame:
    """Total per zone and window, or why there is none. Two levels of aggregation: cell and window, then zone."""
    cell = in_windows(obs, win).groupBy("cell_id", "window_hours").agg(
        F.sum(F.col("rate_mm_h") * F.lit("0.5").cast("decimal(2,1)")).cast("double").alias("mm"), F.count("*").alias("n"), F.min("interval_start").alias("t0"), F.max("interval_start").alias("t1"),
    )
    wanted = weights.crossJoin(F.broadcast(win))
    j = wanted.join(cell, ["cell_id", "window_hours"], "left")
    broken = F.col("n") != F.timestamp_diff("MINUTE", "t0", "t1") / 30 + 1
    short = (F.col("t0") > F.col("window_start")) | (F.col("t1") + F.expr(HALF_HOUR) < F.col("window_end"))
    g = j.groupBy("zone_id", "window_hours").agg(
        F.bool_or(F.col("n").isNull()).alias("missing"), F.bool_or(F.coalesce(broken, F.lit(False))).alias("broken"), F.bool_or(F.coalesce(short, F.lit(False))).alias("short"),
        F.sum(F.col("mm") * F.col("share")).alias("mm"),
    )
    reason = F.when(F.col("missing"), "missing_cells").when(F.col("broken"), "series_broken").when(F.col("short"), "window_not_covered")
    return g.select("zone_id", "window_hours", F.when(reason.isNull(), F.round("mm", 6)).alias("total_mm"), reason.alias("unavailable_reason"))


def headline(totals: DataFrame, preferred: int = 24, context: int = 72, more: float = 10.0) -> DataFrame:
    """The preferred window if it has a total, else the longest that has one; the long window as context if it
    holds at least `more` mm beyond the headline."""
    have = F.when(F.col("total_mm").isNotNull(), F.struct((F.col("window_hours") == preferred).alias("p"), F.col("window_hours"), F.col("total_mm")))
    g = totals.groupBy("zone_id").agg(F.max(have).alias("h"), F.max(F.when(F.col("window_hours") == context, F.col("total_mm"))).alias("c"))
    ctx = F.when((F.col("h.window_hours") < context) & (F.col("c") - F.col("h.total_mm") >= more), F.col("c"))
    return g.select("zone_id", F.col("h.window_hours").alias("headline_hours"), F.col("h.total_mm").alias("headline_mm"), ctx.alias("context_mm"))


def granule_spine(spark, start: str, end: str) -> DataFrame:
    """Half-hour starts from start up to, not including, end, with day of year and minute of day."""
    s = spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ'{start}', TIMESTAMP_NTZ'{end}' - interval 30 minutes, interval 30 minutes)) AS interval_start")
    minute = F.hour("interval_start") * 60 + F.minute("interval_start")
    return s.withColumn("name", F.format_string("%04d%03d-%04d", F.year("interval_start"), F.dayofyear("interval_start"), minute))


def coverage_stats(spine: DataFrame, obs: DataFrame) -> DataFrame:
    """Expected, present and absent half hours of each cell. The spine is bounded by its dates (48 rows a day)."""
    cells = obs.select("cell_id").distinct()
    expected = cells.crossJoin(F.broadcast(spine))
    j = expected.join(obs, ["cell_id", "interval_start"], "left")
    return j.groupBy("cell_id").agg(F.count("*").alias("expected"), F.count("rate_mm_h").alias("present"), (F.count("*") - F.count("rate_mm_h")).alias("absent"), F.max("rate_mm_h").cast("double").alias("highest"))


def resolve_as_of(spine: DataFrame, obs: DataFrame, steps: int = 48) -> DataFrame:
    """Newest half hour with all cells present among the last `steps` of the spine; null if there is none."""
    last = spine.agg(F.max("interval_start").alias("end"))
    recent = spine.crossJoin(F.broadcast(last)).where(F.timestamp_diff("MINUTE", F.col("interval_start"), F.col("end")) < 30 * steps)
    cells = obs.agg(F.count_distinct("cell_id").alias("cells"))
    full = recent.join(obs, "interval_start").groupBy("interval_start").agg(F.count("*").alias("n")).crossJoin(F.broadcast(cells)).where("n = cells")
    return full.agg(F.max("interval_start").alias("as_of"), F.count("*").alias("complete_steps"))


def cell_except(weights: DataFrame, obs: DataFrame) -> DataFrame:
    """Cells that zones need and the feed lacks, and the other way round."""
    need, have = weights.select("cell_id").distinct(), obs.select("cell_id").distinct()
    return need.subtract(have).withColumn("side", F.lit("missing")).unionByName(have.subtract(need).withColumn("side", F.lit("extra")))


def _first_reason(reasons: list[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds; null if none does."""
    return F.coalesce(*[F.when(holds, name) for holds, name in reasons])


def zone_accumulation(weights: DataFrame, given: DataFrame, tasks: int | None = None) -> DataFrame:
    """(zone_id, run, interval_start, interval_end, cells, missing, extra, total_mm, refused): the area-weighted total of
    a zone from the half hours that it was given, or the first reason why there is none.

    weights(zone_id, cell_id, share), one row per zone and cell; given(zone_id, cell_id, interval_start, rate_mm_h, run).
    Reasons, in order: no_observations, missing_cells, extra_cells (given but not in the zone), mixed_runs of a cell,
    series_overlaps (a half hour twice, or one that does not begin on the cell's own half hours), series_broken (a gap),
    mixed_runs of the zone, mixed_windows (cells begin or end at different times). Rows without a rate, run or start
    are no readings. Sums are exact decimals; shares keep twelve digits. A zone without weights has extra cells only.

    Half hours of a cell hardly repeat, so rows are dealt to so many tasks (as many as shuffles have) before they are
    grouped: grouping where they are read would sort a whole file in one task and merge next to nothing."""
    tasks = tasks or int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ok = given.where("rate_mm_h is not null and interval_start is not null and run is not null").repartition(tasks, "zone_id", "cell_id")
    half = F.col("rate_mm_h").cast("decimal(18,6)") * F.lit("0.5").cast("decimal(2,1)")
    once = ok.groupBy("zone_id", "cell_id", "interval_start").agg(F.count("*").alias("_n"), F.sum(half).alias("_mm"), F.min("run").alias("_r0"), F.max("run").alias("_r1"))
    minutes = F.unix_seconds(F.col("interval_start").cast("timestamp")) / 60
    cell = once.groupBy("zone_id", "cell_id").agg(
        F.sum("_n").alias("_n"), F.count("*").alias("_d"), F.sum("_mm").cast("decimal(20,7)").alias("_mm"), F.min("_r0").alias("_r0"), F.max("_r1").alias("_r1"), F.min("interval_start").alias("_t0"), F.max("interval_start").alias("_t1"),
        (F.min(minutes % 30) != F.max(minutes % 30)).alias("_off"),
    )
    j = weights.select("zone_id", "cell_id", F.col("share").cast("decimal(13,12)").alias("_share")).join(cell, ["zone_id", "cell_id"], "full")
    inside = F.col("_share").isNotNull() & F.col("_n").isNotNull()
    g = j.repartition(tasks, "zone_id").groupBy("zone_id").agg(
        F.count("_n").alias("_given"), F.count("_share").alias("cells"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_share").isNull()).alias("extra"),
        F.bool_or(inside & (F.col("_r0") != F.col("_r1"))).alias("_mixed"), F.bool_or(inside & ((F.col("_n") > F.col("_d")) | F.col("_off"))).alias("_twice"),
        F.bool_or(inside & (F.timestamp_diff("MINUTE", "_t0", "_t1") != 30 * (F.col("_d") - 1))).alias("_gap"),
        F.min("_r0").alias("run"), F.max("_r1").alias("_run"), F.min("_t0").alias("_a"), F.max("_t0").alias("_b"), F.min("_t1").alias("_c"), F.max("_t1").alias("_e"), F.sum(F.col("_mm") * F.col("_share")).alias("_total"),
    )
    why = _first_reason([
        (F.col("_given") == 0, "no_observations"), (F.col("missing") > 0, "missing_cells"), (F.col("extra") > 0, "extra_cells"), (F.col("_mixed"), "mixed_runs"), (F.col("_twice"), "series_overlaps"),
        (F.col("_gap"), "series_broken"), (F.col("run") != F.col("_run"), "mixed_runs"), ((F.col("_a") != F.col("_b")) | (F.col("_c") != F.col("_e")), "mixed_windows"),
    ])
    g = g.withColumn("refused", why)
    good = lambda c: F.when(F.col("refused").isNull(), c)
    return g.select("zone_id", good(F.col("run")).alias("run"), good(F.col("_a")).alias("interval_start"), good(F.col("_c") + F.expr(HALF_HOUR)).alias("interval_end"), "cells", "missing", "extra", good(F.round("_total", 6).cast("decimal(20,6)")).alias("total_mm"), "refused")
