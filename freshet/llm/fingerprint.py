"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever its low bits are all set; each piece gives one
signature character. The block size is the smallest power of two whose signature fits 64 characters; the
fingerprint holds the signatures at that block size and at twice it: "<size>:<signature>:<signature>". Two
fingerprints are compared by edit distance at the block sizes they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.text import U64, mix, raw_bytes, span_hashes
from freshet.shared import small_batches

WINDOW, LENGTH, RUN = 7, 64, 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_TABLE = (mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)


def _rolling(raw: np.ndarray) -> np.ndarray:
    """Hash of the bytes at i-6 .. i (fewer at the start) for every i."""
    own = _TABLE[raw]
    out = own.copy()
    with np.errstate(over="ignore"):
        for j in range(1, WINDOW):
            out[j:] += own[:-j] * np.uint32((2 * j + 1) * 0x9E3779B1 & 0xFFFFFFFF)
        return out ^ (out >> np.uint32(15))


def _signature(raw: np.ndarray, cuts: np.ndarray) -> str:
    """One character for each piece; pieces end after each cut, what is left over is the last piece."""
    ends = cuts[: LENGTH - 1] + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.concatenate([ends, np.array([len(raw)])])
    starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]])
    return _ALPHABET[(span_hashes(raw, starts, ends) & U64(63)).astype(np.int64)].tobytes().decode()


@lru_cache(maxsize=4)
def fingerprint(text: str | None) -> str:
    """Null counts as empty; the empty text has the fingerprint "1::"."""
    raw = raw_bytes(text)
    if not len(raw):
        return "1::"
    level = max(0, (len(raw) // LENGTH).bit_length() - 2)
    h = _rolling(raw)
    cuts = np.flatnonzero((h & np.uint32((1 << level) - 1)) == (1 << level) - 1)
    while len(cuts) > LENGTH - 1 and (1 << level) < len(raw):
        level += 1
        cuts = cuts[(h[cuts] & np.uint32((1 << level) - 1)) == (1 << level) - 1]
    double = cuts[(h[cuts] & np.uint32((2 << level) - 1)) == (2 << level) - 1]
    return f"{1 << level}:{_signature(raw, cuts)}:{_signature(raw, double)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 - edit distance (insertions and deletions) / both lengths; 0 without a common run of seven characters
    (of the whole shorter signature, if that is shorter)."""
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run:
        return 0.0
    seen = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in seen for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; fingerprints whose block sizes differ by more than a factor of two have likeness 0."""
    (size_a, one_a, two_a), (size_b, one_b, two_b) = a.split(":"), b.split(":")
    x, y = int(size_a), int(size_b)
    if x == y:
        return max(_alike(one_a, one_b), _alike(two_a, two_b))
    if x == 2 * y:
        return _alike(one_a, two_b)
    return _alike(two_a, one_b) if y == 2 * x else 0.0


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of every whole text, in one pass and without a shuffle."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype=object)

    return docs.withColumn(out_col, run(F.col(text_col)))


def with_next(docs: DataFrame, per_row, schema: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000) -> DataFrame:
    """per_row(id, text, next_text) of every row, the next row being that with the next smaller id (of equal ids,
    by text; after the last row the first one). Returns a table of schema.

    Rows go by id quantiles into groups of about `rows`, in one shuffle, and each group is read in order; a group
    also gets a copy of the first row of the group after it. Only id ranges and one row per group are compared
    across groups. Null texts are empty; rows with a null id come last.
    """
    small_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    groups = max(1, min(20_000, ids.count() // rows))
    parts = [i / groups for i in range(1, groups)] or [0.5]
    splits = ids.agg(F.percentile_approx("id", parts, max(10_000, 10 * groups))).first()[0] or []

    @F.pandas_udf("long")
    def range_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(splits, np.int64), v.to_numpy(), side="left"))

    group = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(range_of(F.coalesce("id", F.lit(0))))
    rank = F.coalesce("id", F.lit(-(1 << 63)))
    placed = ids.withColumn("group", group)
    heads = placed.groupBy("group").agg(F.max(F.struct(rank.alias("r"), F.md5("text").alias("m"))).alias("head"))
    after = Window.orderBy(F.desc("group"))
    heads = heads.select(F.lead("group").over(after).alias("from"), F.first("group").over(after).alias("first"), F.col("group").alias("to"), "head")
    # the group after `to` is `from`; the last group is followed by the first one
    order = heads.select("to", F.coalesce("from", "first").alias("from"))
    tails = order.join(heads.select(F.col("to").alias("from"), "head"), "from").select(F.col("head.r").alias("r"), F.col("head.m").alias("m"), "to")
    extra = placed.withColumns({"r": rank, "m": F.md5("text")}).join(F.broadcast(tails), ["r", "m"])
    extra = extra.dropDuplicates(["r", "m", "to"]).select("id", "text", F.col("to").alias("group"), F.lit(1).alias("tail"))
    both = placed.withColumn("tail", F.lit(0)).unionByName(extra)
    sorted_rows = both.repartition("group").sortWithinPartitions(F.desc("group"), "tail", F.desc_nulls_last("id"), F.desc(F.md5("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for i, text, g, tail in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if last is not None and last[2] == g:
                    out.append(per_row(last[0], last[1], text))
                last = None if tail else (i, text, g)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return sorted_rows.mapInArrow(run, schema)
