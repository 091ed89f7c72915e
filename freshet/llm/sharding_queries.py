"""op6: all documents in eight shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.llm.sharding import Ring, assign


def op6_consistent_hash_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(text).alias("key"))
    out = assign(slim, F.col("key"), F.col("size"), ("doc_id", "text_crc32"), Ring())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_consistent_hash_shards": op6_consistent_hash_shards}
ORACLES: dict[str, str] = {}
