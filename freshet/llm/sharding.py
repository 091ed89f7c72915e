"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into equal sectors; a key belongs to the sector its hash falls in. A sector goes clockwise to the
first virtual node whose shard still has room, so no shard exceeds (1 + slack) times the mean load, while only
sectors that meet a full shard move on. Sectors are placed largest first, which is one fixed order of arrival.

The narrower the slack, the more sectors move on: at 0.002 shards are even within 0.2 %, and where a ninth shard was
added, 14 % of the bytes moved (measured in review on even and on skewed loads), against 11 % for the new shard's share
alone; at 0.25 and more only about that share moves (see the tests).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ring:
    """(sectors + 2 * shards * salts) * strips bounds what the driver sees (load sums only), however many rows there
    are. strips: parts of a unit whose rows are numbered apart, so that many equal texts are not one task."""

    shards: int = 8
    nodes: int = 64
    slack: float = 0.002
    sectors: int = 4096
    salts: int = 64
    strips: int = 16


def _point(name: str) -> int:
    return int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "big")


def place(loads: dict[tuple[int, int], int], ring: Ring) -> dict[tuple[int, int], int]:
    """(sector, salt) -> shard. Each unit goes clockwise to the first virtual node whose shard has room for it, the
    largest units first; one that fits nowhere goes to the shard with the least load."""
    nodes = sorted((_point(f"shard {s} node {v}"), s) for s in range(ring.shards) for v in range(ring.nodes))
    room = (1 + ring.slack) * sum(loads.values()) / ring.shards
    used, out = [0] * ring.shards, {}
    for (sector, salt), load in sorted(loads.items(), key=lambda u: (-u[1], u[0])):
        start = bisect_left(nodes, ((sector << 64) // ring.sectors, -1))
        walk = dict.fromkeys(nodes[(start + i) % len(nodes)][1] for i in range(len(nodes)))
        shard = next((s for s in walk if used[s] + load <= room), None)
        shard = min(range(ring.shards), key=lambda s: (used[s], s)) if shard is None else shard
        used[shard] += load
        out[sector, salt] = shard
    return out


def assign(rows: DataFrame, key: F.Column, load: F.Column, order: tuple[str, ...], ring: Ring = Ring()) -> DataFrame:
    """rows with shard and slot (0, 1, 2, ... within a shard), columns of these names replaced.

    Equal keys share a shard, unless one key alone holds over half of a shard's room: such hot keys, fewer than twice
    the shards, are split by a hash of the row into salts, and no other key is. Loads are non-negative integers; null
    loads count 0. A null key is a key. Equal rows are interchangeable. An empty table gives an empty table. Other
    columns keep their names and values.

    Slots come from row counts per (sector, salt, strip) and a row number within each, so no window spans a shard.
    """
    spark = rows.sparkSession
    named = [c for c in rows.columns if c not in ("shard", "slot")]
    text = F.md5(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null")))
    d = rows.select(F.struct(*named).alias("row"), text.alias("key"), F.coalesce(load.cast("long"), F.lit(0)).alias("load"), F.xxhash64(F.lit("salt"), *order).alias("spread"), F.struct(*order).alias("order"))
    by_key = d.groupBy("key").agg(F.sum("load").alias("load"))
    total = by_key.agg(F.sum("load")).first()[0] or 0
    hot = [r["key"] for r in by_key.where(F.col("load") * 2 * ring.shards > (1 + ring.slack) * total).select("key").collect()]
    sector = F.shiftrightunsigned(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - (ring.sectors.bit_length() - 1)).cast("int")
    salt = F.when(F.col("key").isin(hot), 1 + F.pmod("spread", F.lit(ring.salts))).otherwise(0) if hot else F.lit(0)
    d = d.withColumns({"sector": sector, "salt": salt.cast("int"), "strip": F.pmod(F.xxhash64(F.lit("strip"), "spread"), F.lit(ring.strips)).cast("int")})
    parts = {(r["sector"], r["salt"], r["strip"]): (r["load"], r["n"]) for r in d.groupBy("sector", "salt", "strip").agg(F.sum("load").alias("load"), F.count("*").alias("n")).collect()}
    units: dict[tuple[int, int], int] = {}
    for (at, nth, _), (own, _) in parts.items():
        units[at, nth] = units.get((at, nth), 0) + own
    shard_of = place(units, ring)
    before, table = [0] * ring.shards, []
    for k in sorted(parts):
        shard = shard_of[k[:2]]
        table.append((*k, shard, before[shard]))
        before[shard] += parts[k][1]
    placed = spark.createDataFrame(table, "sector int, salt int, strip int, shard int, first long")
    within = Window.partitionBy("sector", "salt", "strip").orderBy("order")
    numbered = d.withColumn("nth", F.row_number().over(within)).join(F.broadcast(placed), ["sector", "salt", "strip"])
    return numbered.select("row.*", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))
