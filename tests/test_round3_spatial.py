import math

import duckdb
from freshet.operators import spatial
from freshet.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def sql_rows(name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.execute(registry.ORACLES[name]).fetchall())


def test_decision_problems_equal_sql_beyond_a_hundred_places(spark):
    got = sorted(tuple(r) for r in registry.QUERIES["decision_problems"](spark, SF).collect())
    assert got == sql_rows("decision_problems", "supplier", "nation", "region")


def test_limits_hold_for_the_rounded_distance(spark):
    """A point 60.0000003 km off rounds to 60."""
    off = math.degrees(60.0000003 / spatial.EARTH_KM)
    left = spark.createDataFrame([(1, 91.0, 26.0), (2, None, 26.0)], "a int, lon double, lat double")
    right = spark.createDataFrame([(5, 91.0, 26.0 + off), (4, 91.0, 26.0 - off), (6, 91.0, 27.0), (7, None, 1.0)], "b int, lon double, lat double")
    assert sorted(map(tuple, spatial.nearest(left, right, "a", "b", 60).collect())) == [(1, 4, 60.0), (2, None, None)]
    assert sorted((r["a"], r["b"], r["km"]) for r in spatial.near(left, right, 60, exact=False).collect()) == [(1, 4, 60.0), (1, 5, 60.0)]


def test_copies_of_a_position_are_measured_once(spark):
    n = 3000
    left = spark.range(n).select(F.col("id").alias("a"), F.lit(91.0).alias("lon"), F.lit(26.0).alias("lat"))
    right = spark.range(n).select(F.col("id").alias("b"), F.lit(91.0).alias("lon"), (F.col("id") % 2 * 0.1 + 26).alias("lat"))
    got = spatial.nearest(left, right, "a", "b", 60)
    assert got.agg(F.count("*"), F.sum("b"), F.sum("km")).first() == (n, 0, 0.0)
    pairs = spatial.near(left.limit(50), right, 60)
    assert pairs.count() == 50 * n and pairs.where("lat2 = 26").agg(F.count_distinct("a", "b")).first()[0] == 25 * n
    assert spatial._by_position(right, "ids").agg(F.max(F.size("ids"))).first()[0] < 1500  # no position whole in one row


def test_pairs_of_one_key_are_spread(spark):
    got = registry.QUERIES["haversine"](spark, "/root/testdata/sf0.01")
    by = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by) > 4 and max(by) < sum(by) / 2
    one = spark.range(500).select(F.lit(7).alias("k"), "id")
    both = spatial.pairs_of(one, one.withColumnRenamed("id", "other"), "k")
    assert both.agg(F.count("*"), F.count_distinct("id", "other")).first() == (250_000, 250_000)
