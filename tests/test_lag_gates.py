from freshet.functions import text
from freshet.operators import hydrology
from pyspark.sql import functions as F

FITS = "up string, down string, year int, best_lag int, best_corr double, gain double, eligible boolean"


def gates(spark, years):
    rows = [("A", "B", 2000 + i, *y) for i, y in enumerate(years)]
    return hydrology.lag_quality(spark.createDataFrame(rows, FITS)).first()


def test_all_gates_pass(spark):
    r = gates(spark, [(10, 0.5, 0.1, True), (12, 0.6, 0.2, True), (14, 0.4, 0.1, True), (70, 0.9, 0.5, False)])
    assert (r["failed"], r["recommendation"], r["recommended_lag"], r["lowest_lag"], r["highest_lag"], r["lag_iqr"]) == ("", "review", 12.0, 10, 14, 2.0)
    assert (r["years"], r["eligible_years"], r["correlated_share"], r["stable_share"]) == (4, 3, 1.0, 1.0)


def test_each_gate_fails_by_itself(spark):
    good = (10, 0.5, 0.1, True)
    assert gates(spark, [good] * 2)["failed"] == "enough_completed_years"
    assert gates(spark, [(10, 0.3, 0.1, True)] * 3)["failed"] == "median_correlation,correlated_year_fraction"
    assert gates(spark, [good] * 2 + [(10, 0.3, 0.1, True)])["failed"] == "correlated_year_fraction"
    assert gates(spark, [good] * 2 + [(40, 0.5, 0.1, True)])["failed"] == "lag_iqr,stable_year_fraction"
    assert gates(spark, [(0, 0.5, 0.1, True)] * 3)["failed"] == "positive_lead_time"
    assert gates(spark, [(10, 0.5, None, True)] * 3)["failed"] == "improves_on_zero_lag"
    none = gates(spark, [(10, 0.5, 0.1, False)])
    assert none["failed"].count(",") == 6 and (none["recommended_lag"], none["stable_share"], none["recommendation"]) == (None, 0.0, "reject")


def test_names_are_expanded_and_folded(spark):
    df = spark.createDataFrame([("Borjan L.P.S.", "Dhansiri Nadi"), ("HS No 2", "Jan"), (None, None)], "a string, b string")
    got = [tuple(r) for r in df.select(text.expand(F.col("a")), text.fold_river(F.col("b"))).collect()]
    assert got == [("borjan lower primary school", ["dhansiri"]), ("high school no 2", []), (None, None)]
