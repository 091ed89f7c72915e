"""Landed files as tables: explicit schemas, bad rows counted or set aside, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = "gauge_id string, level_m double, observed_at string, schema_version int, source string, source_revision string, _bad string"


def series(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of readings: (rows with parsed times, quarantined lines)."""
    raw = spark.read.schema(SERIES).option("columnNameOfCorruptRecord", "_bad").json(path)
    at = F.expr("cast(try_to_timestamp(observed_at) as timestamp)")
    rows = raw.withColumn("_at", at)
    bad = rows.where("_bad is not null or _at is null or level_m is null").select(F.coalesce("_bad", F.to_json(F.struct("gauge_id", "observed_at", "level_m"))).alias("line"))
    good = rows.where("_bad is null and _at is not null and level_m is not null").withColumn("observed_at", F.col("_at")).drop("_at", "_bad")
    return good, bad


def gauge_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("gauge_id", "observed_at", "level_m")) -> DataFrame:
    """Readings from CSV with a header that holds the required columns; rows with a bad number or time are left out."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    t = raw.select("gauge_id", F.expr("try_to_timestamp(observed_at)").alias("observed_at"), F.expr("try_cast(level_m as double)").alias("level_m"))
    return t.where("gauge_id is not null and observed_at is not null and level_m is not null")


def coalesced(df: DataFrame, aliases: tuple[str, ...]) -> Column:
    """First alias column with a non-blank value; null if none of them is there."""
    have = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in aliases if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def alias_csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], needed: tuple[str, ...]) -> DataFrame:
    """CSV whose columns go by several names; rows without a needed value are left out."""
    raw = spark.read.option("header", True).csv(path)
    out = raw.select(*[coalesced(raw, names).alias(c) for c, names in columns.items()])
    return out.where(" and ".join(f"{c} is not null" for c in needed))


def inbox(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    """Mixed records of whole JSON files (an object, an array, or {"submissions": [...]}): (file, record, record_type,
    accepted). A file is accepted only if all its records are of a known kind."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("v")).where("v <> ''")
    many = F.coalesce(F.get_json_object("v", "$.submissions"), F.when(F.col("v").startswith("["), F.col("v")), F.concat(F.lit("["), "v", F.lit("]")))
    parsed = F.from_json(many, "array<map<string,string>>")
    rows = files.select("file", F.explode_outer(parsed).alias("record"))
    rows = rows.withColumn("record_type", F.try_element_at("record", F.lit("record_type")))
    ok = rows.groupBy("file").agg(F.bool_and(F.coalesce(F.col("record_type").isin(*kinds), F.lit(False))).alias("accepted"))
    return rows.join(ok, "file")


def grid_text(spark: SparkSession, path: str, fill: float = -9999.9) -> DataFrame:
    """Grid text files ("lon, ...", "lat, ...", then one line per latitude) as (file, lon, lat, rate); the fill value
    is missing, a matrix of another shape than its axes gives no rows."""
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    after = lambda parts, n: F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0)))
    numbers = lambda line: F.transform(after(F.split(line, ","), 1), lambda x: x.cast("double"))
    f = f.withColumns({"lons": numbers(F.try_element_at("lines", F.lit(1))), "lats": numbers(F.try_element_at("lines", F.lit(2))), "rows": after(F.col("lines"), 2)})
    f = f.where(F.size("rows") == F.size("lats"))
    r = f.select("file", "lons", F.explode(F.arrays_zip("lats", "rows")).alias("r")).select("file", "lons", F.col("r.lats").alias("lat"), F.col("r.rows").alias("line"))
    r = r.withColumn("vals", F.transform(F.split("line", ","), lambda x: x.cast("double"))).where(F.size("vals") == F.size("lons"))
    c = r.select("file", "lat", F.explode(F.arrays_zip("lons", "vals")).alias("c"))
    return c.select("file", F.col("c.lons").alias("lon"), "lat", F.when(F.col("c.vals") != fill, F.col("c.vals")).alias("rate"))
