"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch has 128 coordinates. In round i each shingle is thrown into one hashed bin with a value that starts
with i, and a bin keeps its smallest value; after 128 rounds any bin that is still empty takes the smallest
value of its own round over all shingles. So every coordinate is filled, and about 128 ln 128 + n hash values
are needed instead of 128 n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.components import components
from freshet.llm.text import U64, mix, release, shingles
from freshet.shared import drop, keep, small_batches

COORDINATES, BANDS = 128, 32
#: Rounds in which a document outside a bucket's largest component is compared with a few of its members only.
ROUNDS = 2
#: Coordinates of the finer sketch, of one bit each, that documents in buckets of several components get.
FINE = 4096
_FILTER_BITS = 24


def sketch(values: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes: t coordinates, two of them equal with probability J."""
    empty = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, empty, U64)
    done, step = 0, max(1, min(t, max(1024, t) // len(values)))
    while done < t and (out == empty).any():
        rounds = np.arange(done, min(t, done + step), dtype=U64)[:, None]
        with np.errstate(over="ignore"):
            h = mix(values[None, :] + (rounds + U64(1)) * U64(0x9E3779B97F4A7C15))
        np.minimum.at(out, (h & U64(t - 1)).astype(np.int64).ravel(), ((rounds << U64(48)) | (h >> U64(16))).ravel())
        done += len(rounds)
    for j in np.flatnonzero(out == empty):
        i = U64(t + int(j))
        with np.errstate(over="ignore"):
            h = mix(values + (i + U64(1)) * U64(0x9E3779B97F4A7C15))
        out[j] = ((i << U64(48)) | (h >> U64(16))).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of four coordinates."""
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=U64) * U64(0xD1342543DE82EF95)
        for part in coordinates.reshape(BANDS, -1).T:
            key = mix(key * U64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def packed(coordinates: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate in eight 64-bit numbers, to estimate a similarity from."""
    nibbles = (mix(coordinates) & U64(15)).reshape(8, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=U64) * U64(4)), axis=1).view(np.int64)


def fine_bits(coordinates: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, in 64-bit numbers."""
    return np.packbits((mix(coordinates) & U64(1)).astype(np.uint8)).view(np.int64)


def _fine_sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fine_bits(sketch(own, FINE)) if len(own := shingles(t, k)) else np.zeros(FINE // 64, np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["id", "fine"])
        release()

    return run


def _sketcher(k: int):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                own = shingles(text, k)
                if len(own):
                    s = sketch(own)
                    rows.append((len(own), hashlib.md5(own.tobytes()).digest(), band_keys(s), packed(s)))
                else:
                    rows.append((0, None, None, None))
            n, key, bands, bits = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["id", "n", "key", "bands", "bits"],
            )
        release()

    return run


def _likeness(a: str, b: str) -> F.Column:
    """Estimated similarity from two packed sketches: the share of equal four-bit parts, less chance."""
    unequal = F.lit(0)
    for i in range(8):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        unequal = unequal + F.bit_count(x)
    return ((1 - unequal / COORDINATES) - 1 / 16) * (16 / 15)


def _fine_likeness(a: str, b: str) -> F.Column:
    """Estimated similarity from two fine sketches: bits of unlike coordinates differ half of the time."""
    unequal = F.lit(0)
    for i in range(FINE // 64):
        unequal = unequal + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return 1 - 2 * unequal / FINE


@dataclass(frozen=True)
class Threshold:
    """Documents are linked if whole * |A and B| >= part * |A or B|."""

    part: int = 4
    whole: int = 5
    shingle: int = 5

    @property
    def least(self) -> float:
        """Estimates below this are over four and a half standard deviations under the threshold."""
        j = self.part / self.whole
        return j - 4.5 * (j * (1 - j) / COORDINATES) ** 0.5

    @property
    def least_fine(self) -> float:
        """The same for the fine sketch, whose bits agree with probability (1 + J) / 2."""
        j = (1 + self.part / self.whole) / 2
        return 2 * j - 1 - 4.5 * 2 * (j * (1 - j) / FINE) ** 0.5


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: Threshold = Threshold()) -> DataFrame:
    """One row per row of docs: (<id_col>, n_shingles, component_id, kept).

    n_shingles is the size of the document's set of distinct word shingles (A-Z lower-cased words). component_id
    is the smallest id reachable over links, kept is true on the row that carries it.

    - Null, empty or blank text: n_shingles 0, linked with nothing, own component.
    - Fewer words than a shingle: the whole sequence is the only shingle.
    - Equal sets (exact copies, also by case or white space): one class, linked through its smallest id.
    - Null id: the row is counted but not linked; component_id is null and kept is true.
    - Repeated ids are one document: all their rows get the same component, and count as linked.
    - Empty table: empty result. Other columns of docs are not read, so their names cannot clash.

    Plan: sketches are written once; classes of equal sets by a grouped minimum; band buckets with two or more
    classes; each class against the smallest member of most of its buckets, the links found being confirmed on full
    sets; in two more rounds each member outside the largest component of its buckets against the likeliest of one
    member of it from each bucket; then, in buckets that still hold several components, every member outside the
    largest against all members of others. So a bucket whose g members make one component costs about g rows, not
    g*g, and pairs are enumerated only between components.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, key binary, bands array<long>, bits array<long>"
    sk = keep(d.mapInArrow(_sketcher(limit.shingle), schema), "sketches")
    known = sk.where("n > 0 and id is not null")
    classes = known.groupBy("key").agg(F.min("id").alias("rep"))
    reps = known.join(classes.withColumnRenamed("rep", "id"), ["key", "id"], "left_semi").dropDuplicates(["key", "id"])
    slim = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    ends = slim.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")
    members = keep(slim.join(ends, "bucket"), "members")
    bits = known.select("id", "n", "bits", F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("marks"))

    # each class against the one that leads most of its buckets
    led = members.where("id <> low").groupBy("id", "low").agg(F.count("*").alias("times"))
    star = led.groupBy("id").agg(F.max_by("low", F.struct("times", -F.col("low"))).alias("other"))
    links = keep(_confirmed(_best(star, bits, limit), d, limit), "links")
    same = known.join(classes, "key").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = keep(components(links), "components")

    # then what is outside the largest component of its buckets, against one member of it from each bucket
    for turn in range(ROUNDS):
        more = keep(_confirmed(_best(_led(members, comp, turn), bits, limit), d, limit), "links")
        links = links.unionByName(more)
        drop(comp)
        comp = keep(components(links), "components")

    rest = keep(_across(members, comp, bits, d, limit), "pairs")
    if not rest.isEmpty():
        links = links.unionByName(_confirmed(rest, d, limit))
    # A document with several texts joins their classes; other documents reach their class through its smallest id.
    several = known.groupBy("id").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).where("k1 <> k2").select("id")
    links = links.unionByName(same.join(several.withColumnRenamed("id", "a"), "a", "left_semi"))
    final = keep(components(links), "components")
    for t in (members, comp, rest):
        drop(t)

    of_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("c"))
    out = sk.select("id", "n", "key").join(of_class, "key", "left")
    c = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("c", "id")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), c.alias("component_id"), F.coalesce(F.col("id") == c, F.lit(True)).alias("kept"))


def _best(pairs: DataFrame, bits: DataFrame, limit: Threshold) -> DataFrame:
    """Of the pairs (id, other) whose sketches and set sizes do not rule a link out, the likeliest of each id."""
    other = bits.select(F.col("id").alias("other"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    found = pairs.join(bits.select("id", "n", "bits"), "id").join(other, "other")
    likely = found.withColumn("est", _likeness("bits", "bits2")).where((F.col("est") >= limit.least) & _sizes("n", "n2", limit))
    return likely.groupBy("id").agg(F.max_by("other", F.struct("est", -F.col("other"))).alias("other"))


def _sizes(a: str, b: str, limit: Threshold) -> F.Column:
    return limit.whole * F.least(a, b) >= limit.part * F.greatest(a, b)


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of buckets with several components: (bucket, band, id, c, main), main being the largest component."""
    own = members.select("bucket", "band", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("c"))
    sizes = own.groupBy("bucket", "c").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", "main")
    return own.join(main, "bucket")


def _led(members: DataFrame, comp: DataFrame, turn: int) -> DataFrame:
    """Each member outside its bucket's largest component with one member of that component, drawn by a hash."""
    full = _mixed(members, comp)
    lead = full.where("c = main").groupBy("bucket").agg(F.min_by("id", F.xxhash64(F.lit(turn), "id")).alias("other"))
    return full.where("c <> main").select("bucket", "id").join(lead, "bucket").select("id", "other").distinct()


def _across(members: DataFrame, comp: DataFrame, bits: DataFrame, d: DataFrame, limit: Threshold) -> DataFrame:
    """Likely pairs between different components that share a bucket, each taken in the first bucket they share.

    These documents get a finer sketch, so that few pairs below the threshold are left to confirm."""
    full = keep(_mixed(members, comp), "mixed")
    wanted = _id_filter(full.select("id"))
    texts = d.where(wanted("id")).join(full.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    fine = texts.select("id", "text").mapInArrow(_fine_sketcher(limit.shingle), "id long, fine array<long>")
    full = full.join(bits.select("id", "n", "marks"), "id").join(fine, "id")
    left = full.where("c <> main").select("bucket", F.col("id").alias("other"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("fine").alias("fine2"), F.col("marks").alias("marks2"))
    earlier = F.expr("exists(slice(zip_with(marks, marks2, (x, y) -> x = y), 1, band), x -> x)")
    mixed = full.join(
        left,
        (full["bucket"] == left["bucket"]) & (F.col("c") != F.col("c2")) & ((F.col("c") == F.col("main")) | (F.col("id") < F.col("other")))
        & _sizes("n", "n2", limit) & (_fine_likeness("fine", "fine2") >= limit.least_fine) & ~earlier,
    )
    return mixed.select("id", "other").distinct()


def _confirmed(pairs: DataFrame, d: DataFrame, limit: Threshold) -> DataFrame:
    """Of pairs (id, other), those linked by their full sets, as (a, b)."""
    pairs = keep(pairs.select("id", "other"), "candidates")
    wanted = _id_filter(pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))))
    texts = d.where(wanted("id"))
    both = (
        pairs.join(texts.select("id", F.col("text").alias("text_a")), "id")
        .join(texts.select(F.col("id").alias("other"), F.col("text").alias("text_b")), "other")
        .select(F.col("id").alias("a"), F.col("other").alias("b"), "text_a", "text_b")
    )
    return both.mapInArrow(_verifier(limit), "a long, b long").distinct()


def _id_filter(ids: DataFrame):
    """A test that passes every id of the table and few others, so that other texts are not shuffled.

    Its size is fixed (2 MB); over many more ids than bits it passes everything, which costs time only."""
    word = F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS))
    found = ids.groupBy(F.shiftright(word, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    table = found.toArrow()
    bits = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    bits[table["w"].to_numpy()] = table["bits"].to_numpy()

    @F.pandas_udf(T.BooleanType())
    def test(h: pd.Series) -> pd.Series:
        v = h.to_numpy()
        return pd.Series((bits[v >> 6] >> (v & 63)) & 1 == 1)

    return lambda col: test(F.pmod(F.xxhash64(col), F.lit(1 << _FILTER_BITS)))


def _verifier(limit: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {}

        def own(side: str, text: str | None) -> np.ndarray:
            if side not in last or last[side][0] != text:
                last[side] = (text, shingles(text, limit.shingle))
            return last[side][1]

        for batch in batches:
            hit = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = own("a", x), own("b", y)
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common and limit.whole * common >= limit.part * (len(a) + len(b) - common):
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64())), batch.column(1).take(pa.array(hit, pa.int64()))], ["a", "b"])
        last.clear()
        release()

    return run
