"""Embedding whitening: vectors projected on the eigenvectors of their covariance, each divided by its deviation.

Components are cut to integers x = floor(scale * c) + offset, so that sums are exact. Rows with the same x are one group;
the fit takes each group once, or with the number of its rows as weight. Tasks multiply centred blocks (one matrix
product per block), the d x d parts are added up in Spark, and only their sum comes to the driver, which solves for the
eigenvectors. Each distinct vector is whitened once and joined back to its rows by a SHA-256 of its x.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.text import release
from freshet.shared import keep

#: Eigenvalues below this part of the largest belong to no component: nothing varies there but rounding.
LEAST = 1e-12
#: A group of more than this part of all rows is dealt over several tasks when it is joined back; there are at most
#: 1 / HOT of them.
HOT = 1 / 500
#: Rows of a block that is multiplied at a time.
ROWS = 8192


def integers(df: DataFrame, vector: str, scale: float, offset: int) -> DataFrame:
    """df with x and key; without rows whose vector is null, empty or holds a null or a number that is not finite."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))
    x = F.transform(c, lambda v: F.floor(v * scale) + F.lit(offset).cast("long"))
    return kept.withColumn("x", x).withColumn("key", F.unhex(F.sha2(F.col("x").cast("string"), 256)))


def _arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches with their column x as a matrix."""
    for b in batches:
        for lo in range(0, len(b), ROWS):
            part = b.slice(lo, ROWS)
            yield part, part.column("x").flatten().to_numpy().reshape(-1, width)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from whole numbers: what the mean's whole part leaves is divided last."""
    whole, rest = sums // n, sums % n
    return (x - whole.astype(np.int64)).astype(np.float64) - np.array([int(r) / n for r in rest])


def _product(shared, pick):
    """Sum of weight times the outer product of what pick makes of the rows, one row of the matrix per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, width = None, len(shared.value["sums"])
        for b, x in _arrays(batches, width):
            y = pick(x, shared.value)
            y = np.column_stack([y, np.ones(len(y))])  # the last row and column hold sums
            part = (y * b.column("weight").to_numpy()[:, None]).T @ y
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"])
        release()

    return run


def _summed(vectors: DataFrame, shared, pick, width: int) -> np.ndarray:
    """The matrix of _product over all rows, brought to the driver: (width + 1) squared numbers."""
    parts = vectors.select("x", "weight").mapInArrow(_product(shared, pick), "i int, part array<double>")
    rows = parts.groupBy("i").agg(F.array(*[F.sum(F.element_at("part", j + 1)) for j in range(width + 1)]).alias("row"))
    return np.array([r["row"] for r in sorted(rows.collect(), key=lambda r: r["i"])])


def _project(x: np.ndarray, fit: dict) -> np.ndarray:
    return _centred(x, fit["n"], fit["sums"]) @ fit["matrix"]


def _whitener(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        for b, x in _arrays(batches, len(fit["sums"])):
            off = _centred(x, 1, fit["sums"] // fit["n"])
            # n x - sums in whole numbers, as objects only where 64 bits might not do
            large = np.abs(off).max(initial=0.0) * fit["n"] * np.sqrt(x.shape[1]) >= 3e9
            y = x.astype(object) * fit["n"] - fit["sums"] if large else x * fit["n"] - fit["sums"].astype(np.int64)
            deviation = [int(v) for v in (y * y).sum(1)]
            deviation = [v if v < 1 << 63 else None for v in deviation]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(deviation, pa.int64()), pa.array(list(_project(x, fit)), pa.list_(pa.float64()))], ["key", "deviation", "values"])
        release()

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: float = 64.0, offset: int = 1_000_000, weights: str = "one") -> DataFrame:
    """One row per row of df and component: (<id_col>, component, n, deviation, whitened, explained, identity_error).

    n: weight of the fit, the number of distinct x with weights="one", of rows with "counts". sums: weighted sums of x.
    deviation: sum over dimensions of (n x - sums)^2, exact; null where that needs more than 63 bits. whitened:
    x - sums / n on the component, over the root of its eigenvalue. explained: its eigenvalue's part of the trace.
    identity_error: greatest entry of |covariance of whitened - identity| over the fit, computed from the whitened.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry are left out. Vectors of several lengths:
    those of the length that most distinct vectors have are taken (of equals the longest), the others left out. Null
    ids and repeated rows are whitened like any others. Components whose eigenvalue is (nearly) zero are left out, so
    one distinct vector, like an empty table, gives no rows. Other columns are not read, so names cannot clash.
    What the driver holds is d x d numbers for vectors of length d, never vectors.
    """
    spark = df.sparkSession
    key_of = integers(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v", scale, offset)
    weight = F.count("*") if weights == "counts" else F.lit(1)
    vectors = keep(key_of.groupBy("x", "key").agg(F.count("*").alias("copies"), weight.cast("long").alias("weight")), "vectors")
    shape = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = spark.createDataFrame([], shape).select(F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), "*")
    widths = vectors.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("many"), F.sum("weight").alias("n"), F.sum("copies").alias("rows"))
    most = widths.orderBy(F.desc("many"), F.desc("width")).first()
    if most is None:
        return none
    width, n = most["width"], most["n"]
    vectors = vectors.where(F.size("x") == width)
    wide = "decimal(38,0)"
    sums = vectors.select(*[F.sum((F.col("x")[j].cast(wide) * F.col("weight")).cast("decimal(28,0)")).alias(f"d{j}") for j in range(width)]).first()
    sums = np.array([int(s) for s in sums], object)

    shared = spark.sparkContext.broadcast({"n": n, "sums": sums})
    total = _summed(vectors, shared, lambda x, fit: _centred(x, fit["n"], fit["sums"]), width)
    covariance = total[:width, :width] / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    taken = int((values[:components] > LEAST * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    if not taken:
        return none
    shared = spark.sparkContext.broadcast({"n": n, "sums": sums, "matrix": directions[:, :taken] / np.sqrt(values[:taken])})
    second = _summed(vectors, shared, _project, taken)
    mean = second[taken, :taken] / n
    error = float(np.abs(second[:taken, :taken] / n - np.outer(mean, mean) - np.eye(taken)).max())
    parts = [float(v) for v in values[:taken] / values.sum()]

    whitened = vectors.select("key", "x").mapInArrow(_whitener(shared), "key binary, deviation long, values array<double>")
    back = _joined_back(key_of.select("id", "key"), whitened, vectors, most["rows"])
    each = back.select("id", "deviation", F.posexplode("values").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("at") + 1)
    out = each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
    return out


def _joined_back(rows: DataFrame, whitened: DataFrame, vectors: DataFrame, total: int) -> DataFrame:
    """rows(id, key) with the columns of their vector. Groups of more than HOT of all rows are dealt over several
    salts, and their vector is given out once per salt."""
    limit = max(1, int(total * HOT))
    hot = vectors.where(F.col("copies") > limit).select("key", F.ceil(F.col("copies") / limit).cast("int").alias("salts"))
    few = F.broadcast(hot)  # at most 1 / HOT rows
    salted = rows.join(few, "key", "left").withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    given = whitened.join(few, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(given, ["key", "salt"]).drop("key", "salt")
