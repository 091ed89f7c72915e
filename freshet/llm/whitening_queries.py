"""op13: all embeddings on the first components of their covariance."""

from __future__ import annotations

from freshet.llm.whitening import whiten


def op13_embedding_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLES: dict[str, str] = {}
