import copy
import json

from freshet.sources import contracts as k

RAIN = {"units": "mm/hour", "product_version": "07", "run": "late", "product_short_name": "GPM_3IMERGHHL.07", "observations": [
    {"grid_cell_id": "c1", "longitude": 91.05, "latitude": "26.05", "precipitation_rate": 0, "interval_start": "2024-07-01T00:00:00Z", "interval_end": "2024-07-01T05:30:00+05:00"}]}
FORE = {"dataset": "cems-glofas-forecast", "system_version": "4.5", "forecast_horizon_days": 30, "units": "m3/s", "ensemble_statistic": "ensemble_mean", "issued_at": "2024-07-01T00:00:00Z", "grid_points": [
    {"grid_cell_id": "g", "coordinates": [91, 26.5], "values": [{"valid_at": f"2024-07-{d}T00:00:00Z", "discharge_m3_per_second": 5} for d in ("01", "16", "17", "31")]}]}


def change(doc, path, value):
    doc = copy.deepcopy(doc)
    spot = doc
    for p in path[:-1]:
        spot = spot[p]
    if value is KeyError:
        del spot[path[-1]]
    else:
        spot[path[-1]] = value
    return json.dumps(doc)


def test_every_breach_of_rain_payloads(spark):
    o = ("observations", 0)
    cases = [
        (json.dumps(RAIN), []), (change(RAIN, ("units",), "mm"), ["$.units"]), (change(RAIN, ("product_version",), KeyError), ["$.product_version"]),
        (change(RAIN, ("run",), "early"), ["$.product_short_name"]), (change(RAIN, ("run",), "final"), ["$.run", "$.product_short_name"]),
        (change(RAIN, ("observations",), []), ["$.observations"]), (change(RAIN, ("observations",), {}), ["$.observations"]), (None, ["$"]), ("{", ["$"]), ("7", None),
        (change(RAIN, (*o, "latitude"), 91), ["$.observations[0].latitude"]), (change(RAIN, (*o, "precipitation_rate"), "-1"), ["$.observations[0].precipitation_rate"]),
        (change(RAIN, (*o, "precipitation_rate"), "NaN"), ["$.observations[0].precipitation_rate"]), (change(RAIN, (*o, "grid_cell_id"), KeyError), ["$.observations[0].grid_cell_id"]),
        (change(RAIN, (*o, "interval_start"), "2024-07-01T00:00:00"), ["$.observations[0].interval_start"]), (change(RAIN, (*o, "interval_end"), "2024-07-01T00:00:00Z"), ["$.observations[0].interval_end"]),
        (change(RAIN, ("observations",), [RAIN["observations"][0], 5, None]), None), (change(RAIN, (*o, "longitude"), None), ["$.observations[0].longitude"]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, body string")
    judged = k.judge(df, "body", k.RAIN_GRID)
    got = {r.id: [b.path for b in r.breaches] for r in judged.collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want if want is not None else got[i], (i, got[i])
    (one,) = k.rows(judged, "body", k.RAIN_GRID, ("id",)).collect()
    assert (one.id, one.run, one.latitude, one.precipitation_rate) == (0, "late", 26.05, 0.0)
    assert k.rows(judged.limit(0), "body", k.RAIN_GRID).count() == 0


def test_forecasts_keep_horizon_order_and_tier(spark):
    g = ("grid_points", 0)
    v = lambda day: {"valid_at": f"{day}T00:00:00Z", "discharge_m3_per_second": 1}
    at = "$.grid_points[0].values"
    cases = [
        (json.dumps(FORE), []), (change(FORE, ("forecast_horizon_days",), 15), ["$.forecast_horizon_days"]), (change(FORE, (*g, "coordinates"), [1]), ["$.grid_points[0].coordinates"]),
        (change(FORE, (*g, "coordinates"), [1, 2, 3]), ["$.grid_points[0].coordinates"]), (change(FORE, (*g, "values"), []), [at]), (change(FORE, (*g, "values"), KeyError), [at]),
        (change(FORE, (*g, "values"), [v("2024-07-03"), v("2024-07-02")]), [at]), (change(FORE, (*g, "values"), [v("2024-06-30"), v("2024-08-01")]), [f"{at}[0].valid_at", f"{at}[1].valid_at"]),
        (change(FORE, (*g, "values", 1, "discharge_m3_per_second"), "wet"), [f"{at}[1].discharge_m3_per_second"]), (change(FORE, ("issued_at",), "2024-07-01"), ["$.issued_at"]),
        (change(FORE, (*g, "values"), [v("2024-07-02"), v("2024-07-02")]), []),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, body string")
    judged = k.judge(df, "body", k.DISCHARGE_FORECAST)
    got = {r.id: [b.path for b in r.breaches] for r in judged.collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}
    tiers = [r.tier for r in k.rows(judged.where("id = 0"), "body", k.DISCHARGE_FORECAST).orderBy("valid_at").collect()]
    assert tiers == ["medium_range"] * 2 + ["extended_range"] * 2
