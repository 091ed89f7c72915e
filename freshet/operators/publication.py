"""Revisions, publication states and reconciled hierarchies.

Revisions never change; a small pointer does. A check that cannot be made is not passed: it is not applicable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PUBLISHABLE = ("validated", "validated_partial")


def newest(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest revision per key by (report date, fetch time, id). Whole rows go through one grouped maximum, so
    there is no window over a busy key."""
    rest = [c for c in revisions.columns if c not in (*keys, "report_date", "fetched_at", "revision_id")]
    row = F.struct("report_date", "fetched_at", "revision_id", *rest)
    g = revisions.groupBy(*keys).agg(F.max(row).alias("_r"))
    return g.select(*keys, "_r.*")


def states(revisions: DataFrame) -> DataFrame:
    """quarantined, current, superseded (an older fetch of the newest report) or historical, per revision."""
    last = newest(revisions.where(F.col("publication_state").isin(*PUBLISHABLE)), ["entity_id"]).select("entity_id", F.col("report_date").alias("_d"), F.col("revision_id").alias("_id"))
    j = revisions.join(last, "entity_id", "left")
    state = (
        F.when(~F.col("publication_state").isin(*PUBLISHABLE), "quarantined").when(F.col("revision_id") == F.col("_id"), "current")
        .when(F.col("report_date") == F.col("_d"), "superseded").otherwise("historical")
    )
    return j.withColumn("state", state).drop("_d", "_id")


def status(revisions: DataFrame) -> DataFrame:
    """Per entity: the latest attempt, the latest valid one, and whether a newer attempt is quarantined."""
    key = F.struct("report_date", "fetched_at", "revision_id")
    ok = F.col("publication_state").isin(*PUBLISHABLE)
    g = revisions.groupBy("entity_id").agg(F.max(key).alias("a"), F.max(F.when(ok, key)).alias("v"), F.count_if(~ok).alias("quarantined"))
    newer = F.col("v").isNull() | (F.col("a.revision_id") != F.col("v.revision_id"))
    return g.select("entity_id", F.col("a.revision_id").alias("latest_attempt"), F.col("v.revision_id").alias("latest_valid"), "quarantined", newer.alias("newer_quarantined"))


def read_through(pointer: DataFrame, revisions: DataFrame) -> DataFrame:
    """The revisions that pointers name; a pointer whose target does not exist gives no row."""
    return pointer.join(revisions, ["entity_id", "revision_id"])


def verify_pointers(pointer: DataFrame, revisions: DataFrame) -> DataFrame:
    """Problems of each pointer: its target is missing, not publishable, or of another date."""
    r = revisions.select("revision_id", F.col("publication_state").alias("_s"), F.col("report_date").alias("_d"))
    j = pointer.join(r, "revision_id", "left")
    found = F.filter(F.array(
        F.when(F.col("_s").isNull(), "missing"), F.when(~F.col("_s").isin(*PUBLISHABLE), "not_publishable"), F.when(F.col("_d") != F.col("report_date"), "other_date"),
    ), lambda x: x.isNotNull())
    return j.select("entity_id", "revision_id", F.array_join(found, ",").alias("problems"))


def content_revision(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, revision): a digest of the sorted row digests, so row order and partitioning do not matter. The sorted
    digests of a key are streamed through the hash, so none of its size is held."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    kind = T.StructType([*(rows.schema[k] for k in keys), T.StructField("rows", T.LongType(), False), T.StructField("revision", T.StringType())])
    arrow = to_arrow_schema(kind)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, state = None, 0, None
        for batch in batches:
            done = []
            for *k, h in zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 1)), strict=True):
                if state is None or k != at:
                    if state is not None:
                        done.append((*at, n, state.hexdigest()))
                    at, n, state = k, 0, hashlib.sha256()
                n += 1
                state.update(h.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in done], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*at, n, state.hexdigest()), strict=True))], schema=arrow)

    return rows.select(*keys, digest.alias("_h")).repartition(*keys).sortWithinPartitions(*keys, "_h").mapInArrow(fold, kind)


def reconcile(parts: DataFrame, declared: DataFrame, key: str, value: str, total: str, expected: str, tolerance: float = 1e-6) -> DataFrame:
    """Declared totals against the sum of their parts, only where as many parts exist as are expected."""
    g = parts.groupBy(key).agg(F.count("*").alias("parts"), F.sum(value).alias("summed"))
    j = declared.join(g, key, "left")
    complete = F.coalesce(F.col("parts"), F.lit(0)) == F.col(expected)
    verdict = F.when(~complete, "not_applicable").when(F.abs(F.col("summed") - F.col(total)) <= tolerance, "pass").otherwise("fail")
    return j.select(key, F.coalesce("parts", F.lit(0)).alias("parts"), verdict.alias("verdict"))


def failing_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `failed`: the names of the rules that do not hold, in order; a null rule fails."""
    return rows.withColumn("failed", F.array_join(F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull()), ","))


def class_break(value: str, steps: tuple[float, ...]) -> Column:
    """-1 without a value, 0 for zero, then the step that holds the value."""
    out = F.when(F.col(value).isNull(), -1).when(F.col(value) == 0, 0)
    for i, top in enumerate(steps):
        out = out.when(F.col(value) <= top, i + 1)
    return out.otherwise(len(steps) + 1)


def rank_within(rows: DataFrame, group: str, value: str, tie: str, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), tie))).where(F.col("rank") <= k)
