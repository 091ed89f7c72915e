from freshet.operators import bulletins
from freshet.plans import payloads

SF = "/root/testdata/sf0.001"


def test_the_vocabulary_of_headers_is_broadcast(spark):
    cells = spark.range(10).selectExpr("id doc", "if(id % 2 = 0, 'A', 'N') header", "id position")
    aliases = spark.createDataFrame([("A", "accepted")], "header string, logical string")
    plan = bulletins.resolve_headers(cells, aliases, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_payloads_are_spread_before_they_are_judged(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert payloads._granules(spark, SF).rdd.getNumPartitions() == n
    assert payloads._bulletins(spark, SF).rdd.getNumPartitions() == n
