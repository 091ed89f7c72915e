"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by K functions floor((a.x + b) / w) with Gaussian a; equal K-tuples form a bucket. A
query visits its own bucket and then perturbed ones (one step up or down in some of the K coordinates) in the
order of their estimated success, the squared distance to the bucket borders that were crossed. The candidates of
all tables are reranked by the exact measure.

For the largest inner product, vectors are scaled by the largest norm and get one more coordinate that fills them
up to the unit sphere, which makes the largest inner product the smallest distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.text import U64, mix


@dataclass(frozen=True)
class Settings:
    """tables: hash tables. width: bucket width w on the unit sphere. bucket: rows of a bucket aimed at, and most
    rows of a block; larger buckets are split. probes: most buckets visited per table. recall: aimed at when K and
    the number of probes are chosen on `sample` queries, whose true neighbours are found by brute force."""

    tables: int = 4
    width: float = 2.0
    bucket: int = 1024
    probes: int = 96
    recall: float = 0.96
    sample: int = 64
    seed: int = 11


@dataclass
class Hashing:
    a: np.ndarray
    b: np.ndarray
    width: float
    scale: float

    @staticmethod
    def draw(dim: int, k: int, scale: float, s: Settings) -> Hashing:
        g = np.random.default_rng(s.seed)
        return Hashing(g.normal(size=(s.tables, k, dim + 1)), g.uniform(0, s.width, (s.tables, k)), s.width, scale)

    def positions(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, tables, K) positions in units of the bucket width."""
        if query:
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            more = np.zeros((len(x), 1))
        else:
            x = x / self.scale
            more = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
        return (np.einsum("nd,tkd->ntk", np.hstack([x, more]), self.a) + self.b) / self.width


def bucket_keys(cells: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of integer cells."""
    key = np.full(len(cells), cells.shape[1] + 1, U64)
    with np.errstate(over="ignore"):
        for j in range(cells.shape[1]):
            key = mix(key * U64(0x9E3779B97F4A7C15) + cells[:, j].astype(np.int64).view(U64))
    return key.view(np.int64)


def probes(position: np.ndarray, most: int) -> np.ndarray:
    """Cells of the buckets to visit, own bucket first, then by rising sum of squared border distances."""
    base = np.floor(position).astype(np.int64)
    inside = position - base
    steps = sorted([(float(d * d), j, -1) for j, d in enumerate(inside)] + [(float((1 - d) ** 2), j, 1) for j, d in enumerate(inside)])
    out = [base]
    heap = [(steps[0][0], (0,))] if steps else []
    while heap and len(out) < most:
        cost, held = heapq.heappop(heap)
        last = held[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*held[:-1], last + 1)))
            heapq.heappush(heap, (cost + steps[last + 1][0], (*held, last + 1)))
        moved = [steps[i][1] for i in held]
        if len(set(moved)) == len(moved):
            cell = base.copy()
            for i in held:
                cell[steps[i][1]] += steps[i][2]
            out.append(cell)
    return np.stack(out)


def best(block: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best rows of a block, itself left out; ties to the smaller id."""
    rough = queries @ block.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    n = len(ids)
    least = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(queries), -np.inf)
    # rounding of the product grows with the vectors
    slack = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(block, axis=1).max(initial=0)
    i, j = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
    # the same sum for equal vectors, whatever their place in the block
    exact = (queries[i] * block[j]).sum(axis=1)
    return _cut(query_ids[i], ids[j], exact, k)


def _cut(q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((v, -score, q))
    q, v, score = q[order], v[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, score = q[new], v[new], score[new]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(q)), bool), q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return q[rank < k], v[rank < k], score[rank < k]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(rows: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner product with each query row.

    is_query is a SQL condition on `id`. A query's own id is no candidate; of rows that share an id and a vector
    one counts. Ties go to the smaller id. With fewer candidates than k, all that are found are returned.
    Rows with a null id, and vectors that are null, empty, zero, of another than the commonest length, or hold null
    or non-finite components take no part, as queries or candidates. Empty table: empty result. Other columns are
    not read.

    Bucket rows and the queries that visit them meet in blocks of at most settings.bucket rows, each compared as a
    matrix product; only each block's k best are passed on, so no pair is materialised beyond them, and a hot
    bucket is as many blocks as it needs. All rows are indexed; K and the number of probes come from a sample.
    """
    spark, s = rows.sparkSession, settings
    # floats travel as floats: they become doubles without loss where they are compared
    kind = "float" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    fine = v.where("id is not null and size(vec) > 0 and forall(vec, x -> x is not null and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    lengths = fine.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top"))
    common = lengths.orderBy(F.desc("n"), "dim").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    fine = fine.where(F.size("vec") == common["dim"])
    asked = fine.where(is_query)
    hashing, count = _tuned(fine, asked, common, k, s)
    share = spark.sparkContext.broadcast(hashing)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cells = np.floor(share.value.positions(_matrix(part.column(1)), False))
                for t in range(cells.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, t, np.int32)), pa.array(bucket_keys(cells[:, t])), part.column(0), part.column(1)], ["t", "key", "id", "vec"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                where = share.value.positions(_matrix(part.column(1)), True)
                for t in range(where.shape[1]):
                    keys = [bucket_keys(probes(p, count)) for p in where[:, t]]
                    take = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
                    n = len(take)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.concatenate(keys)), part.column(0).take(take), part.column(1).take(take)], ["t", "key", "id", "vec"])

    schema = f"t int, key long, id long, vec array<{kind}>"
    placed = fine.mapInArrow(index, schema)
    sizes = placed.groupBy("t", "key").agg(F.ceil(F.count("*") / s.bucket).cast("int").alias("blocks"))
    split = placed.join(sizes.where("blocks > 1"), ["t", "key"], "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    visits = asked.mapInArrow(visit, schema).join(sizes, ["t", "key"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["t", "key", "block", "kind", "id", "vec"]
    both = split.withColumn("kind", F.lit(0)).select(*names).unionByName(visits.withColumn("kind", F.lit(1)).select(*names))
    met = both.repartition("t", "key", "block").sortWithinPartitions("t", "key", "block", "kind")
    found = met.mapInArrow(lambda batches: _compare(batches, k), "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, candidates before queries. Holds one block, and the best found so far."""
    block: tuple | None = None
    ids, vecs = [], []
    found, held = [], 0

    def given() -> pa.RecordBatch:
        q, v, score = _cut(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(score)], ["query_id", "vec_id", "score"])

    for batch in batches:
        t, key, part, kind, own = (batch.column(i).to_numpy() for i in range(5))
        matrix = _matrix(batch.column(5))
        change = (np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)
        edges = [0, *(np.flatnonzero(change) + 1), len(t)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            name = (t[lo], key[lo], part[lo])
            if name != block:
                block, ids, vecs = name, [], []
            if kind[lo] == 0:
                ids.append(own[lo:hi])
                vecs.append(matrix[lo:hi])
            elif ids:
                ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                for at in range(lo, hi, 2048):
                    found.append(best(vecs[0], ids[0], matrix[at : min(hi, at + 2048)], own[at : min(hi, at + 2048)], k))
                    held += len(found[-1][0])
        if held > 400_000:
            found = [_cut(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
            held = len(found[0][0])
            if held > 200_000:
                yield given()
                found, held = [], 0
    if found:
        yield given()


def _tuned(fine: DataFrame, asked: DataFrame, common, k: int, s: Settings) -> tuple[Hashing, int]:
    """K and the number of probes: the fewest that find s.recall of the true neighbours of a sample of queries."""
    scale = float(np.sqrt(common["top"]))
    some = asked.orderBy(F.xxhash64("id"), "id").limit(s.sample).toArrow()
    most = max(1, int(np.ceil(np.log2(max(1, common["n"] / s.bucket)) / 1.2)))
    if not some.num_rows:
        return Hashing.draw(common["dim"], most, scale, s), 1
    q_ids, q = some["id"].to_numpy(), _matrix(some["vec"].combine_chunks())

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, c = best(_matrix(batch.column(1)), batch.column(0).to_numpy(), q, q_ids, k)
                at = {x: i for i, x in enumerate(batch.column(0).to_pylist())}
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), batch.column(1).take(pa.array([at[x] for x in b.tolist()], pa.int64()))], ["q", "id", "score", "vec"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    true = fine.mapInArrow(brute, f"q long, id long, score double, {fine.schema['vec'].simpleString().replace(':', ' ', 1)}").withColumn("r", rank).where(F.col("r") <= k).select("q", "vec").toArrow()
    if not true.num_rows:
        return Hashing.draw(common["dim"], most, scale, s), 1
    of = {x: i for i, x in enumerate(q_ids.tolist())}
    owner, near = np.array([of[x] for x in true["q"].to_pylist()]), _matrix(true["vec"].combine_chunks())
    # where even one function of this width is too fine, wider buckets are tried
    for n, width in [*((n, s.width) for n in range(most, 0, -1)), *((1, s.width * 4**i) for i in range(1, 5))]:
        hashing = Hashing.draw(common["dim"], n, scale, replace(s, width=width))
        there, here = np.floor(hashing.positions(near, False)), hashing.positions(q, True)
        first = np.full(len(owner), s.probes + 1)
        for t in range(s.tables):
            keys = bucket_keys(there[:, t])
            for i in range(len(q)):
                order = {x: r for r, x in enumerate(bucket_keys(probes(here[i, t], s.probes)).tolist())}
                mine = np.flatnonzero(owner == i)
                first[mine] = np.minimum(first[mine], [order.get(x, s.probes + 1) for x in keys[mine].tolist()])
        reach = np.sort(first)[max(0, int(np.ceil(s.recall * len(first))) - 1)]
        if reach < s.probes:
            break
    return hashing, int(min(reach, s.probes - 1)) + 1
