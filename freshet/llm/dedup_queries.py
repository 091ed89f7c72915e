"""op8: near-duplicate components of all documents."""

from __future__ import annotations

from freshet.llm.minhash import Threshold, near_duplicates


def op8_minhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, limit=Threshold(part=80, whole=100, shingle=4))


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
ORACLES: dict[str, str] = {}
