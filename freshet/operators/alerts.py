"""Alerts, headline sentences and place states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_threshold(level: str, *thresholds: str) -> Column:
    """Smallest threshold above the level; null above all of them or without a level."""
    return F.least(*[F.when(F.col(t) > F.col(level), F.col(t)) for t in thresholds])


def river_sentence(gauge: str, level: str, status: str, trend: str) -> Column:
    """One line per gauge; a missing level says so instead of a number, a missing trend leaves the trend out."""
    moving = F.when(F.col(trend) > 0, F.format_string(", rising %.2f cm per hour", F.col(trend))).when(F.col(trend) < 0, F.format_string(", falling %.2f cm per hour", -F.col(trend))).when(F.col(trend) == 0, ", steady").otherwise("")
    known = F.concat(F.format_string("%s stands at %.2f m (", F.col(gauge), F.col(level)), F.col(status), F.lit(")"), moving)
    return F.when(F.col(level).isNull(), F.concat(F.col(gauge), F.lit(" has no current reading"))).otherwise(known)


def rain_sentence(zone: str, hours: str, mm: str, context: str) -> Column:
    """Amounts are cut to tenths, never rounded up."""
    down = lambda c: F.floor(F.col(c) * 10) / 10
    tail = F.when(F.col(context).isNull(), "").otherwise(F.format_string(", %.1f mm in 72 hours", down(context)))
    return F.when(F.col(mm).isNull(), F.concat(F.col(zone), F.lit(": no complete rainfall window"))).otherwise(F.concat(F.format_string("%s: %.1f mm in %d hours", F.col(zone), down(mm), F.col(hours)), tail))


def locality_states(places: DataFrame, snap: DataFrame, ungauged: Column) -> DataFrame:
    """State of each place through its gauge; "ungauged" by decision is not the same as a gauge without reading."""
    j = places.join(snap.select("gauge_id", "status", "level_m"), "gauge_id", "left")
    state = F.when(ungauged, "ungauged").when(F.coalesce("status", F.lit("no_data")) == "no_data", "no_data").otherwise(F.col("status"))
    return j.withColumn("state", state)


def overview(states: DataFrame, group: str) -> DataFrame:
    """Places per state and group; the readable share leaves out those without a gauge by decision."""
    n = lambda *k: F.count_if(F.col("state").isin(*k))
    g = states.groupBy(group).agg(n("above_danger", "above_hfl").alias("danger"), n("warning").alias("warning"), n("normal").alias("normal"), n("no_data").alias("no_data"), n("ungauged").alias("ungauged"))
    gauged = F.col("danger") + F.col("warning") + F.col("normal") + F.col("no_data")
    return g.withColumn("readable", F.when(gauged > 0, F.round((gauged - F.col("no_data")) / gauged, 6)))
