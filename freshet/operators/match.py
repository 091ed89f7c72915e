"""Names, places and reviewed decisions matched by equi-joins on folded keys; scores only within blocks."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from freshet.functions.similarity import best_two, token_set_ratio
from freshet.functions.text import alnum, names_agree
from freshet.shared import small_batches

#: Words of which one makes a name that of a school.
SCHOOL_WORDS = ("school", "primary", "secondary", "middle english", "college")


def alias_lookup(rows: DataFrame, name: str, aliases: DataFrame, suffix: str = " district") -> DataFrame:
    """rows with the id of the alias their folded name meets, first as it is, then without the suffix.

    aliases(id, alias). An alias that several ids claim belongs to the smallest."""
    table = aliases.groupBy(alnum(F.col("alias")).alias("_k")).agg(F.min("id").alias("_id"))
    plain = alnum(F.col(name))
    short = alnum(F.regexp_replace(F.lower(name), f"{suffix}$", ""))
    one = rows.withColumns({"_k1": plain, "_k2": short}).join(table.select(F.col("_k").alias("_k1"), F.col("_id").alias("_a")), "_k1", "left")
    two = one.join(table.select(F.col("_k").alias("_k2"), F.col("_id").alias("_b")), "_k2", "left")
    return two.withColumn("id", F.coalesce("_a", "_b")).drop("_k1", "_k2", "_a", "_b")


def unique_claims(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows whose key only one owner claims."""
    one = rows.groupBy(key).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi")).where("_lo = _hi").select(key)
    return rows.join(one, key, "left_semi")


def tiered(left: DataFrame, right: DataFrame, name: str, district: str) -> DataFrame:
    """left(id, name, district) against right(rid, name, district): matched by name and district, else by name
    alone if it is unique there, else ambiguous or unresolved."""
    r = right.select(F.col("rid"), F.col(name).alias("_n"), F.col(district).alias("_d"))
    by_name = r.groupBy(F.col("_n").alias(name)).agg(F.count("*").alias("_names"), F.min("rid").alias("_only"))
    exact = r.groupBy(F.col("_n").alias(name), F.col("_d").alias(district)).agg(F.min("rid").alias("_exact"), F.count("*").alias("_same"))
    j = left.join(by_name, name, "left").join(exact, [name, district], "left")
    state = F.when(F.col("_same") == 1, "matched").when(F.col("_same") > 1, "ambiguous").when(F.col("_names") == 1, "other_district").when(F.col("_names") > 1, "ambiguous").otherwise("unresolved")
    return j.select("id", state.alias("state"), F.when(state == "matched", F.col("_exact")).when(state == "other_district", F.col("_only")).alias("rid"))


def fuzzy(left: DataFrame, right: DataFrame, block: str, gap: float = 5.0, high: float = 90.0, medium: float = 75.0) -> DataFrame:
    """Best match of each left(id, name) among right(rid, name) of its block by token-set ratio, for names without
    villages and small blocks: school_match has the villages, and does not make all pairs of a block.

    Ambiguous if the runner-up is within `gap`; else high, medium or unverified. Blocks are equi-joined, scores run
    in Arrow batches, and only the best two scores of each row leave the aggregation."""
    j = left.join(right.withColumnRenamed("name", "_name"), block, "left").withColumn("score", F.round(token_set_ratio("name", "_name"), 6))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "rid")
    top = j.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    g = top.groupBy("id").agg(F.max(F.when(F.col("_k") == 1, F.struct("score", "rid"))).alias("a"), F.max(F.when(F.col("_k") == 2, F.col("score"))).alias("second"))
    close = F.coalesce(F.col("a.score") - F.col("second") <= gap, F.lit(False))
    level = F.when(close, "ambiguous").when(F.col("a.score") >= high, "high").when(F.col("a.score") >= medium, "medium").otherwise("unverified")
    return g.select("id", F.when(level.isin("high", "medium"), F.col("a.rid")).alias("rid"), F.col("a.score").alias("score"), level.alias("confidence"))


def school_match(left: DataFrame, right: DataFrame, block: str, words: tuple[str, ...] = SCHOOL_WORDS, gap: float = 5.0, high: float = 92.0, medium: float = 80.0, bonus: float = 5.0, size: int = 1000) -> DataFrame:
    """(id, rid, score, village_match, ambiguous, confidence): the best of right(rid, name, village) in the block of each
    left(id, name, village), names being normalised.

    Only names with one of the words are matched. A village that agrees (ratio of 90) adds the bonus to the order; the
    score is without it. Ambiguous if the runner-up is within the gap. High needs the village too; medium does not. rid is
    the best also where nothing is confident; ties go to the smallest rid.

    Equal names of a block are scored once, with their two smallest rids. Distinct names are dealt into chunks of about
    `size`, all villages of a name into the same one, each pair of chunks is one row, and the two best of each name leave
    every task (group limit before the shuffle). Two names are scored once, not once per pair of villages. No pair is left
    unscored unless an exact bound puts it below two others."""
    small_batches(left.sparkSession, 50)
    gate = F.lit(False)
    for w in words:
        gate = gate | F.col("name").contains(w)
    key, village = ["_b", "name", "_v"], F.coalesce("village", F.lit("")).alias("_v")
    l = left.select("id", F.col(block).alias("_b"), F.coalesce("name", F.lit("")).alias("name"), village)
    r = right.select("rid", F.col(block).alias("_b"), F.coalesce("name", F.lit("")).alias("name"), village).where("_b is not null")
    asked = l.where(gate & F.col("_b").isNotNull()).select(*key).distinct()
    w = Window.partitionBy(*key).orderBy("rid")
    held = r.withColumn("_k", F.row_number().over(w)).where("_k <= 2").groupBy(*key).agg(F.min("rid").alias("one"), F.when(F.count("*") > 1, F.max("rid")).alias("two"))

    def chunks(rows: DataFrame, names: str, number: str, what: Column) -> tuple[DataFrame, DataFrame]:
        n = rows.groupBy("_b").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
        at = rows.join(n, "_b").withColumn(number, F.pmod(F.xxhash64("name"), F.col("_n")).cast("int"))
        return n.withColumnRenamed("_n", f"{number}_n"), at.groupBy("_b", number).agg(F.collect_list(what).alias(names))

    rid = right.schema["rid"].dataType
    nl, cl = chunks(asked, "_l", "_i", F.struct("name", "_v"))
    nr, cr = chunks(held, "_r", "_j", F.struct("name", "_v", "one", "two"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = nl.join(nr, "_b").withColumn("_i", each("_i_n")).withColumn("_j", each("_j_n")).select("_b", "_i", "_j")
    rows = pairs.join(cl, ["_b", "_i"]).join(cr, ["_b", "_j"]).select("_b", "_l", "_r")
    # Few bytes but much work: a fixed number of partitions, which AQE does not coalesce.
    rows = rows.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ls, rs = [(x["name"], x["_v"]) for x in row["_l"]], sorted(row["_r"], key=lambda x: x["one"])
                out, tops = [], {}
                for (name, v), found in zip(ls, best_two(ls, [(x["name"], x["_v"]) for x in rs], bonus), strict=True):
                    if id(found) not in tops:
                        # of equal totals those with the smallest rids come first, and two rows hold the two best
                        kept = nsmallest(2, ((-round(s, 6), rs[i]["one"], agreed, i) for s, agreed, i in found))
                        tops[id(found)] = sorted((s, rid, agreed) for s, _, agreed, i in kept for rid in (rs[i]["one"], rs[i]["two"]) if rid is not None)[:2]
                    out += [{"_b": row["_b"], "name": name, "_v": v, "total": -s, "agreed": agreed, "rid": rid} for s, rid, agreed in tops[id(found)]]
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    schema = T.StructType([T.StructField("_b", left.schema[block].dataType), T.StructField("name", T.StringType()), T.StructField("_v", T.StringType()), T.StructField("total", T.DoubleType()), T.StructField("agreed", T.BooleanType()), T.StructField("rid", rid)])
    kinds = to_arrow_schema(schema)
    best = Window.partitionBy(*key).orderBy(F.desc("total"), "rid")
    top = rows.mapInArrow(run, schema).withColumn("_k", F.row_number().over(best)).where("_k <= 2").withColumn("_m", F.struct("total", "agreed", "rid"))
    g = top.groupBy(*key).agg(F.max(F.when(F.col("_k") == 1, F.col("_m"))).alias("a"), F.max(F.when(F.col("_k") == 2, F.col("total"))).alias("second"))
    j = l.join(g, key, "left")
    score = F.round(F.col("a.total") - F.when(F.col("a.agreed"), bonus).otherwise(0.0), 6)
    close = F.coalesce(F.round(F.col("a.total") - F.col("second"), 6) <= gap, F.lit(False))
    level = F.when(close, "unverified").when((score >= high) & F.col("a.agreed"), "high").when(score >= medium, "medium").otherwise("unverified")
    return j.select("id", F.col("a.rid").alias("rid"), score.alias("score"), F.coalesce("a.agreed", F.lit(False)).alias("village_match"), close.alias("ambiguous"), level.alias("confidence"))


def decided(defaults: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """The reviewed gauge of a place before the default; `ungauged` is a decision too."""
    j = defaults.join(decisions, key, "left")
    gauge = F.when(F.col("decision") == "ungauged", None).when(F.col("decision") == "replace", F.col("gauge")).otherwise(F.col("default_gauge"))
    return j.select(key, gauge.alias("gauge_id"), F.coalesce("decision", F.lit("default")).alias("basis"))


def subset_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) where one token set holds the other. Pairs meet on a shared token, and on the empty set apart."""
    a = left.select("a", "ta", F.explode_outer("ta").alias("t"))
    b = right.select("b", "tb", F.explode_outer("tb").alias("t"))
    return a.join(b, F.col("ta").isNotNull() & (a["t"] == b["t"])).where(names_agree(F.col("ta"), F.col("tb"))).select("a", "b").distinct()


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
