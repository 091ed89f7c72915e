"""Extracted bulletin rows: headers carried down, continuation rows stitched, records and review reasons.

Rows are ordered within their document only, so windows never span documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_down(rows: DataFrame, doc: str, order: str, header: Column, out: str) -> DataFrame:
    """Carry the last non-null header down within each document."""
    return rows.withColumn(out, F.last(header, ignorenulls=True).over(Window.partitionBy(doc).orderBy(order)))


def stitch(rows: DataFrame, doc: str, order: str, starts: Column, text: str) -> DataFrame:
    """Continuation rows joined to the record they continue: a running count of starts is the record's number.
    Rows before the first start belong to record 0, which is reported as unfinished."""
    numbered = rows.withColumn("record", F.sum(starts.cast("int")).over(Window.partitionBy(doc).orderBy(order)))
    g = numbered.groupBy(doc, "record").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_p"))
    return g.select(doc, "record", F.array_join(F.transform("_p", lambda p: p[text]), " ").alias("text"), F.size("_p").alias("rows"), (F.col("record") == 0).alias("unfinished"))


def resolve_headers(cells: DataFrame, aliases: DataFrame, doc: str) -> DataFrame:
    """Logical column of each header cell; a logical column must be met exactly once per document.

    The alias table is a fixed vocabulary, so it is broadcast."""
    j = cells.join(F.broadcast(aliases), "header")
    return j.groupBy(doc, "logical").agg(F.min("position").alias("position"), F.count("*").alias("times")).withColumn("resolved", F.col("times") == 1)


def long_metrics(rows: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """One row per key and metric; null metrics are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
    return rows.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value").where("value is not null")
