"""op1: the 20 nearest rows of every twentieth embedding."""

from __future__ import annotations

from freshet.llm.ann import nearest


def op1_multiprobe_neighbours(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "pmod(id, 20) = 0", k=20)


QUERIES = {"op1_multiprobe_neighbours": op1_multiprobe_neighbours}
ORACLES: dict[str, str] = {}
