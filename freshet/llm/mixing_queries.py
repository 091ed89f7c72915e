"""op5: the mix of all documents by source weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.llm.mixing import count_words, mix
from freshet.shared import keep


def op5_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the counts are read twice, for the targets and for the draws
    sizes = keep(docs.select("doc_id", "source", count_words(F.col("text")).alias("words")), "sizes")
    return mix(sizes, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mix_sources": op5_mix_sources}
ORACLES = {
    "op5_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM d GROUP BY source
), c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0.0)) AS level
  FROM c WINDOW below AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), w AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, docs, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM w),
r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS draw,
    CAST('0x' || substr(md5('stratum:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % CAST(ceil(docs / 2000.0) AS BIGINT) AS stratum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS part,
    row_number() OVER (PARTITION BY source, stratum ORDER BY size, draw, doc_id) AS rk,
    CAST('0x' || substr(md5('seed|' || coalesce(source, '') || '|' || CAST(stratum AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS seed
  FROM r
)
SELECT doc_id, size, source_size, target, CAST(whole + floor(rk * part + seed) - floor((rk - 1) * part + seed) AS BIGINT) * size AS taken FROM k
"""
}
