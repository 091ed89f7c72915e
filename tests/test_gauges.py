from datetime import datetime, timedelta

import pytest
from freshet.operators import gauges as g
from freshet.operators import hydrology as h
from pyspark.sql import functions as F

T0 = datetime(2024, 7, 1)


def readings(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(hours=t), v) for k, t, v in rows], "gauge_id string, observed_at timestamp_ntz, level_m double")


@pytest.mark.parametrize("level,want", [(None, "no_data"), (9.9, "normal"), (10.0, "warning"), (12.0, "above_danger"), (14.0, "above_hfl")])
def test_thresholds_are_inclusive(spark, level, want):
    df = spark.createDataFrame([(level, 10.0, 12.0, 14.0)], "l double, w double, d double, h double")
    assert df.select(g.level_status("l", "w", "d", "h")).first()[0] == want


def test_validated_wins_whatever_the_order(spark):
    rows = [("a", 0, 3.0, None), ("a", 0, 4.0, 3.5), ("a", 1, 3.0, 3.1), ("a", 1, 3.0, 3.2), ("a", 2, 5.0, None), ("a", 2, 6.0, None), ("a", 3, 7.0, None), ("a", 3, 7.0, None)]
    df = spark.createDataFrame([(s, T0 + timedelta(hours=t), r, v) for s, t, r, v in rows], "station_code string, observed_at timestamp_ntz, raw_value double, validated_value double")
    for d in (df, df.orderBy(F.desc("raw_value")).repartition(3)):
        got = {r["observed_at"].hour: (r["level_m"], r["state"]) for r in g.resolve_hours(d).collect()}
        assert got == {0: (3.5, "validated"), 1: (None, "ambiguous"), 2: (None, "ambiguous"), 3: (7.0, "raw")}


def test_stale_and_silent_stations_stay(spark):
    st = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 1.0, 2.0, 3.0), ("c", 1.0, 2.0, 3.0)], "gauge_id string, warning_level_m double, danger_level_m double, highest_flood_level_m double")
    snap = g.snapshot(st, readings(spark, [("a", 0, 2.5), ("b", 9, 2.5)]), "2024-07-01 10:00:00", 6)
    assert {r["gauge_id"]: (r["level_m"], r["status"]) for r in snap.collect()} == {"a": (None, "no_data"), "b": (2.5, "above_danger"), "c": (None, "no_data")}


def test_trend_and_its_refusals(spark):
    rows = [("up", i, 10 + i / 10) for i in range(6)] + [("gap", 0, 1.0), ("gap", 3, 2.0), ("one", 0, 1.0)]
    got = {r["gauge_id"]: (r["trend_cm_per_hour"], r["reason"]) for r in g.trend(readings(spark, rows)).collect()}
    assert got == {"up": (10.0, None), "gap": (None, "gap"), "one": (None, "too_few")}


def test_first_write_wins(spark):
    stored = readings(spark, [("a", 0, 1.0)])
    batch = readings(spark, [("a", 0, 9.0), ("a", 1, 2.0), ("a", 1, 3.0)])
    got = g.append_new(stored, batch, ["gauge_id", "observed_at"], [F.col("level_m")]).collect()
    assert [(r["observed_at"].hour, r["level_m"]) for r in got] == [(1, 2.0)]


def test_mistyped_level_is_excluded_and_listed(spark):
    df = readings(spark, [("a", 0, 33.0), ("a", 1, 102.99), ("a", 2, 33.4)])
    r = h.yearly_stats(df, F.lit(37.43), (6, 9)).first()
    assert (r["peak_m"], r["readings"], r["discarded"], r["peak_at"].hour) == (33.4, 2, 1, 2)
    assert h.yearly_stats(df, F.lit(None).cast("double"), (6, 9)).first()["peak_m"] == 102.99


@pytest.mark.parametrize("share,want", [(75, "high"), (74, "partial"), (40, "partial"), (39, "sparse")])
def test_coverage_classes(spark, share, want):
    s = spark.createDataFrame([("a", 2020, 1.0, T0, 1, share, 0)], "gauge_id string, year int, peak_m double, peak_at timestamp_ntz, readings long, season_readings long, discarded long")
    assert h.reference_years(s, 100).first()["confidence"] == want


def levels(name, first, values, step=timedelta(hours=1)):
    return [(name, first + i * step, float(v)) for i, v in enumerate(values)]


def test_years_are_fitted_and_refused_for_every_reason(spark):
    import math

    wave = lambda i: 10 + math.sin(i / 17) + 0.4 * math.sin(i / 5.3) + (2 if i % 311 < 9 else 0)
    whole, may = [wave(i) for i in range(184 * 24)], datetime(2020, 5, 1)
    rows = levels("u", may, whole) + levels("d", may + timedelta(hours=9), whole)  # 2020: eligible
    rows += levels("u", may.replace(2021), whole[:2000]) + levels("d", may.replace(2021), [5.0] * 4416)  # few times, no variance
    rows += levels("u", may.replace(2022), [wave(min(i, 300)) for i in range(4416)]) + levels("d", may.replace(2022), [wave(min(max(i - 9, 0), 300)) for i in range(4416)])  # hardly moves
    rows += levels("u", may.replace(2023), whole) + levels("d", datetime(2023, 1, 1), [1.0])  # nothing in season
    rows += levels("u", may.replace(2024), whole) + levels("d", may.replace(2024), whole)  # the year of the clock
    series = spark.createDataFrame(rows, "gauge_id string, observed_at timestamp_ntz, level_m double")
    pairs = spark.createDataFrame([("u", "d"), ("x", "d")], "up string, down string")
    got = {(r.up, r.year): r for r in h.lag_years(series, pairs, "2024-10-31 23:00:00", lags=24, rise=0.5).collect()}
    assert {k[1]: r.reasons for k, r in got.items() if k[0] == "u"} == {2020: "", 2021: "upstream_coverage,no_variance", 2022: "few_pairs,few_rises", 2023: "downstream_coverage,no_changes", 2024: "year_in_progress"}
    fit = got["u", 2020]
    assert (fit.best_lag, fit.near_low <= 9 <= fit.near_high, fit.eligible) == (9, True, True) and fit.best_corr > 0.99 and fit.gain > 0.02 and fit.rises >= 5
    assert (got["u", 2024].best_lag, got["u", 2024].gain) == (0, 0.0)
    assert all("upstream_coverage" in r.reasons and not r.eligible for k, r in got.items() if k[0] == "x") and ("x", 2020) in got


def test_rise_events_are_apart_from_the_last_one_counted(spark):
    at = [0, 2, 3, 4, 7, 9]
    df = spark.createDataFrame([("a", T0 + timedelta(days=t), 5.0) for t in at], "gauge_id string, observed_at timestamp_ntz, change_m double")
    assert h.rise_events(df, 0.02, F.expr("interval 3 days")).first()["events"] == 3
