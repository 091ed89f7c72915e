import pathlib

from freshet.operators import spatial
from freshet.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_distances_of_many_copies_are_short_to_write(spark, tmp_path):
    """Copies whose keys are shifted by 16,800 have the same positions."""
    for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        copies = spark.read.parquet(f"{SF}/{table}.parquet").crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
        copies.withColumn(key, F.col(key) + 16800 * F.col("copy")).drop("copy").write.parquet(f"{tmp_path}/{table}.parquet")
    for table in ("nation", "region"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    registry.QUERIES["haversine"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    back = out.groupBy(F.pmod("locality_id", F.lit(16800)).alias("locality_id"), F.pmod("point_id", F.lit(16800)).alias("point_id"), "km").agg(F.count("*").alias("n"), F.count_distinct("locality_id", "point_id").alias("d"))
    own = registry.QUERIES["haversine"](spark, SF)
    assert back.where("n = 400 and d = 400").drop("n", "d").exceptAll(own).isEmpty() and back.count() == own.count()
    size = sum(f.stat().st_size for f in pathlib.Path(tmp_path, "out").glob("*.parquet"))
    assert size < 1.0 * out.count(), size / out.count()


def test_distances_are_those_of_all_pairs(spark):
    """Nulls and repeated rows too; a task makes few pairs, also where a position or a key has most rows."""
    at = lambda i, n: F.when(i % 19 != 0, F.when(i % 3 == 0, 26.0).otherwise(i % n / 10 + 20))
    side = lambda n, name: spark.range(n).select(F.when(F.col("id") % 50 < 40, 7).when(F.col("id") % 50 < 49, F.col("id") % 3).alias("k"), F.when(F.col("id") % 17 != 0, F.floor(F.col("id") / 2)).alias(name), (at(F.col("id"), 7) + 65).alias("lon"), at(F.col("id"), 11).alias("lat"))
    left, right = side(200, "a"), side(900, "b")
    plain = left.join(right.withColumnsRenamed({"lon": "lon2", "lat": "lat2"}), "k").select("a", "b", spatial.rounded_km(spatial.haversine_km("lon", "lat", "lon2", "lat2")).alias("km"))
    got = spatial.distances(left, right, "a", "b", "k", most=5000)
    assert got.count() == plain.count() and got.exceptAll(plain).isEmpty() and plain.where("km is null or a is null or b is null").count() > 0
    by = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by) > plain.count() / 5000 * 0.8 and max(by) < 4 * 5000
    assert spatial.distances(left.limit(0), right, "a", "b", "k").isEmpty()
