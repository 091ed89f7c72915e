"""Mixing sources to target weights by repetition rates.

Tokens are summed per source, targets shared out by weight, and each document is emitted floor(rate) times plus
one hash-seeded Bernoulli copy whose probability is the fraction of the rate. The draws of one source are spread
evenly over its documents in order of size (systematic draws): each document keeps that probability, while the
tokens taken stay close to the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of one source that are ordered together, on average; a source of more is split by hash.
STRATUM = 2000


def _hash(text: F.Column, digits: int = 8) -> F.Column:
    """An integer below 16**digits from md5, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, size, ...) -> (source, source_size, docs, target), one row per source.

    Sources in code point order, null last, get the weights in turn. Together they are to hold share times all
    tokens; a target stops at most times its source's size and the excess is shared again by weight, which is
    the water level at which capped and weighted targets add up. The ordered windows run over one row per
    source, not over documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("docs"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.element_at(cycle, ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size"))
    below = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    by = by.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    by = by.withColumn("water", F.max(free).over(everything))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return by.select("source", "source_size", "docs", target.alias("target"))


def count_words(text: F.Column) -> F.Column:
    """Runs of characters other than space and U+0009-U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, size: F.Column, id_col: str = "doc_id", source_col: str = "source", keep: tuple[str, ...] = (), **shares) -> DataFrame:
    """One row per row of docs: (<id_col>, <keep...>, source, size, source_size, target, copies, taken).

    copies is how often the mix holds the document, taken = copies * size. A null source is a source of its own.
    Rows of size 0 are part of the mix like others but take nothing; with no tokens at all every target is 0.
    Null ids and repeated rows are drawn like any others; equal rows are interchangeable. Reruns agree: draws
    depend on ids and sizes only. Column names of docs other than those read do not matter.

    A source with many documents is split by hash into strata of about STRATUM, so a hot source is not one task.
    """
    d = docs.select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(source_col).alias("source"), size.cast("long").alias("size")
    )
    targets = source_targets(d, **shares)
    rated = d.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    name = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    split = F.ceil(F.col("docs") / STRATUM)
    rated = rated.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    rated = rated.withColumn("draw", _hash(F.concat(F.lit("mix:"), name))).withColumn("stratum", F.pmod(_hash(F.concat(F.lit("stratum:"), name)), split))
    seed = _hash(F.concat_ws("|", F.lit("seed"), F.coalesce("source", F.lit("")), F.col("stratum").cast("string"))) / F.lit(float(16**8))
    rank = F.row_number().over(Window.partitionBy("source", "stratum").orderBy("size", "draw", "_id"))
    extra = F.floor(rank * F.col("part") + seed) - F.floor((rank - 1) * F.col("part") + seed)
    copies = (F.col("whole") + extra).cast("long")
    return rated.select(
        F.col("_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep], "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def emit(docs: DataFrame, size: F.Column, id_col: str = "doc_id", source_col: str = "source", **shares) -> DataFrame:
    """The mix itself: every row of docs as often as it is to be held, with the columns of docs, whatever their names."""
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    counted = docs.select(*[F.col(c).alias(n) for c, n in at.items()], size.alias("words"))
    mixed = mix(counted, F.col("words"), at[id_col], at[source_col], keep=tuple(n for c, n in at.items() if c not in (id_col, source_col)), **shares)
    often = mixed.where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return often.select(*[F.col("source" if c == source_col else n).alias(c) for c, n in at.items()])
