"""Zone totals and each reason for none."""

from datetime import datetime, timedelta
from decimal import Decimal

from freshet.operators import rainfall as r

T0 = datetime(2024, 1, 1)


def given(zone, cell, starts, rate="1.5", run="late"):
    return [(zone, cell, T0 + timedelta(minutes=m), None if rate is None else Decimal(rate), run) for m in starts]


def test_every_reason_in_order(spark):
    full = (0, 30, 60)
    rows = {
        "good": given("good", "a", full) + given("good", "b", full, "0.1"), "missing": given("missing", "a", full), "null": given("null", "a", full) + given("null", "b", full, None),
        "extra": given("extra", "a", full) + given("extra", "b", full) + given("extra", "x", full), "both": given("both", "a", full) + given("both", "x", full),
        "cellrun": given("cellrun", "a", (0, 30)) + given("cellrun", "a", (60,), run="early") + given("cellrun", "b", full), "twice": given("twice", "a", (0, 30, 30, 60)) + given("twice", "b", full),
        "off": given("off", "a", (0, 30, 50)) + given("off", "b", full), "gap": given("gap", "a", (0, 60)) + given("gap", "b", full), "zonerun": given("zonerun", "a", full) + given("zonerun", "b", full, run="early"),
        "begin": given("begin", "a", full) + given("begin", "b", (30, 60)), "end": given("end", "a", full) + given("end", "b", (0, 30)), "stranger": given("stranger", "q", full),
    }
    w = [(z, c, s) for z in [*rows, "silent"] if z != "stranger" for c, s in (("a", 0.75), ("b", 0.25))]
    weights = spark.createDataFrame(w, "zone_id string, cell_id string, share double")
    obs = spark.createDataFrame([x for v in rows.values() for x in v], "zone_id string, cell_id string, interval_start timestamp_ntz, rate_mm_h decimal(18,6), run string")
    got = {x.zone_id: x for x in r.zone_accumulation(weights, obs).collect()}
    assert {z: x.refused for z, x in got.items()} == {
        "good": None, "missing": "missing_cells", "null": "missing_cells", "extra": "extra_cells", "both": "missing_cells", "cellrun": "mixed_runs", "twice": "series_overlaps", "off": "series_overlaps",
        "gap": "series_broken", "zonerun": "mixed_runs", "begin": "mixed_windows", "end": "mixed_windows", "stranger": "extra_cells", "silent": "no_observations",
    }
    g = got["good"]
    assert g.total_mm == Decimal("1.725") and (g.run, g.interval_start, g.interval_end) == ("late", T0, T0 + timedelta(minutes=90))
    assert got["both"].missing == 1 and got["both"].extra == 1 and got["twice"].total_mm is None
    assert r.zone_accumulation(weights.limit(0), obs.limit(0)).count() == 0


def test_rows_are_dealt_before_they_are_grouped(spark):
    weights = spark.createDataFrame([("z", "a", 1.0)], "zone_id string, cell_id string, share double")
    obs = spark.createDataFrame(given("z", "a", (0, 30)), "zone_id string, cell_id string, interval_start timestamp_ntz, rate_mm_h decimal(18,6), run string")
    plan = r.zone_accumulation(weights, obs)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.rpartition("Exchange hashpartitioning(zone_id")
    assert "Aggregate" in above and "Filter" in below and "Aggregate" not in below
