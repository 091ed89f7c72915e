"""op9: pages written to WARC archives and read back, one row per capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.llm import warc
from freshet.shared import keep, new_path


def op9_warc_captures(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    records = warc.read_records(spark, path)
    response = F.col("record_type") == "response"
    length = F.regexp_extract("http_head", r"Content-Length: (\d+)", 1).try_cast("long")
    measured = records.withColumns({
        "payload_bytes": F.when(response, F.octet_length("payload").cast("long")).otherwise(length),
        "payload_digest": F.when(response, warc.base32_sha1(F.col("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)),
        "payload": F.when(F.col("record_type") == "metadata", F.col("payload")),
    })
    slim = keep(measured.select("record_id", "record_type", "concurrent_to", "refers_to", "payload_bytes", "payload_digest", "payload"), "records")
    page = F.regexp_extract(F.decode("metadata.payload", "UTF-8"), r"page-id: (-?\d+)", 1)
    own = F.when(page != "", page.cast("long")).alias("page_id")
    rows = keep(warc.captures(slim).select("capture_id", own, *[f"response.{c}" for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")]), "captures")
    first = rows.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("first"))
    return rows.join(first, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first").alias("refers_to"))


QUERIES = {"op9_warc_captures": op9_warc_captures}
ORACLES = {
    "op9_warc_captures": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INTEGER))) % 32 AS INTEGER), 1)), 'string_agg', '') AS payload_digest
  FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM f
"""
}
