"""Stream and file queries: the driver's events and orders, landed as files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.plans.bindings import table, view, with_views
from freshet.plans.registry import query
from freshet.shared import new_path
from freshet.sources import files
from freshet.streaming import operators as s


def _drained(stream, spark, name):
    """Run a stream over all its input once and read what it wrote."""
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _landed(df, spark, name):
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("stream_readings", "SELECT station_code, count(*) AS readings FROM (SELECT DISTINCT concat('G_', event_type) AS station_code, date_trunc('minute', ts) AS t FROM events) GROUP BY 1")
def stream_readings(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("G_"), "event_type").alias("station_code"), F.date_trunc("minute", "ts").alias("observed_at"), F.col("value").alias("level_m"))
    once = s.first_writes(_landed(e, spark, "readings"), ["station_code", "observed_at"], late="60 days")
    return _drained(once, spark, "stream-readings").groupBy("station_code").agg(F.count("*").alias("readings"))


@query("stream_append", "SELECT concat('G_', event_type) AS station_code, date_trunc('hour', ts) AS hour, 1 AS rows FROM events GROUP BY 1, 2".replace("date_trunc('hour', ts) AS hour", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour"))
def stream_append(spark, d):
    """foreachBatch appends: a key that is stored is not written again."""
    e = table(spark, d, "events").select(F.concat(F.lit("G_"), "event_type").alias("station_code"), F.date_trunc("hour", "ts").alias("observed_at"), F.col("value").alias("level_m"), "event_id").repartition(8, "event_id")
    out, state = new_path(spark, "appended"), new_path(spark, "appended-state")
    s.append_to(_landed(e, spark, "raw"), out, state, ["station_code", "observed_at"], lambda: [F.col("event_id")]).awaitTermination()
    got = spark.read.parquet(out)
    return got.groupBy("station_code", F.date_format("observed_at", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").cast("int").alias("rows"))


@query("scan_series", with_views("SELECT gauge_id, count(*) AS readings, max(level_m) AS highest FROM v_readings GROUP BY 1", "v_readings"))
def scan_series(spark, d):
    """JSON lines written and scanned again."""
    path = new_path(spark, "series")
    r = view(spark, d, "v_readings").select("gauge_id", "level_m", F.concat(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("observed_at"), F.lit(1).alias("schema_version"), F.lit("feed").alias("source"))
    r.write.json(path)
    good, _ = files.series(spark, path)
    return good.groupBy("gauge_id").agg(F.count("*").alias("readings"), F.max("level_m").alias("highest"))


@query("scan_gauge_csv", with_views("SELECT gauge_id, count(*) AS readings, min(level_m) AS lowest FROM v_readings WHERE level_m < 300 GROUP BY 1", "v_readings"))
def scan_gauge_csv(spark, d):
    """Levels from 300 on are written as text that is no number, and skipped when scanned."""
    path = new_path(spark, "csv")
    r = view(spark, d, "v_readings")
    r.select("gauge_id", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), F.when(F.col("level_m") < 300, F.col("level_m").cast("string")).otherwise("n/a").alias("level_m")).write.option("header", True).csv(path)
    return files.gauge_csv(spark, path).groupBy("gauge_id").agg(F.count("*").alias("readings"), F.min("level_m").alias("lowest"))


@query("scan_alias_csv", "SELECT c_nationkey AS district, count(*) AS schools FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def scan_alias_csv(spark, d):
    path = new_path(spark, "alias")
    c = table(spark, d, "customer")
    c.select(F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_custkey").cast("string")).alias("udise_code"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("school"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).alias("school_name"), F.col("c_nationkey").alias("district")).write.option("header", True).csv(path)
    got = files.alias_csv(spark, path, {"code": ("udise_code", "code"), "name": ("school", "school_name"), "district": ("district",)}, ("code", "name"))
    return got.groupBy(F.col("district").cast("long").alias("district")).agg(F.count("*").alias("schools"))


@query("inbox_split", "SELECT 'accepted' AS route, count(*) AS records FROM events WHERE event_type = 'view' AND user_id % 7 <> 3 UNION ALL SELECT 'rejected', count(*) FROM events WHERE event_type = 'view' AND user_id % 7 = 3")
def inbox_split(spark, d):
    """One file per group of senders; a file with an unknown kind of record is rejected whole."""
    path = new_path(spark, "inbox")
    e = table(spark, d, "events").where("event_type = 'view'").withColumn("k", F.col("user_id") % 7)
    kind = F.when((F.col("k") == 3) & (F.col("event_id") >= 0), "unknown").otherwise("report")
    e.select("k", F.to_json(F.struct(kind.alias("record_type"), "event_id")).alias("r")).groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")).select("value").repartition(7).write.option("maxRecordsPerFile", 1).text(path)
    got = files.inbox(spark, path, ("report", "high_water_mark"))
    return got.groupBy(F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("route")).agg(F.count("*").alias("records"))
