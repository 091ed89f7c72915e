"""Shares of grid cells in shapes, interior points, lines inside shapes and ranked place search."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators import outlines
from freshet.operators.spatial import haversine_km, points_in_shapes, rasterize, vertex_edges


def cell_weights(vertices: DataFrame, step: float, sliver: float = 1e-9) -> DataFrame:
    """`outlines.cell_weights` of rings given as vertices."""
    return outlines.cell_weights(vertex_edges(vertices), step, sliver)


def interior_points(edges: DataFrame, centroids: DataFrame, step: float) -> DataFrame:
    """The centroid where it lies inside, else the middle of the longest run of raster cells."""
    at = centroids.select(F.col("shape_id").alias("owner"), F.col("cx").alias("lon"), F.col("cy").alias("lat"))
    inside = points_in_shapes(at, edges).where("owner = shape_id").select("shape_id", F.lit(True).alias("ok"))
    w = Window.partitionBy("shape_id", "row").orderBy("col")
    runs = rasterize(edges, step).withColumn("g", F.col("col") - F.row_number().over(w)).groupBy("shape_id", "row", "g").agg(F.count("*").alias("n"), F.min("col").alias("a"), F.max("col").alias("b"))
    mid = runs.groupBy("shape_id").agg(F.max(F.struct("n", "row", "a", "b")).alias("m"))
    j = centroids.join(inside, "shape_id", "left").join(mid, "shape_id", "left")
    lon, lat = (F.col("m.a") + F.col("m.b") + 1) / 2 * step, (F.col("m.row") + 0.5) * step
    return j.select("shape_id", F.when(F.col("ok"), F.col("cx")).otherwise(lon).alias("lon"), F.when(F.col("ok"), F.col("cy")).otherwise(lat).alias("lat"), F.coalesce("ok", F.lit(False)).alias("centroid"))


def line_inside(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Kilometres of each line(line_id, seq, lon, lat) in each shape: consecutive vertices inside are joined, also
    across an exit in between."""
    v = points_in_shapes(lines, edges)
    w = Window.partitionBy("line_id", "shape_id").orderBy("seq")
    p = v.withColumns({"lon0": F.lag("lon").over(w), "lat0": F.lag("lat").over(w)})
    return p.groupBy("line_id", "shape_id").agg(F.count("*").alias("vertices"), F.coalesce(F.sum(haversine_km("lon0", "lat0", "lon", "lat")), F.lit(0.0)).alias("km"))


def skeleton(name: Column) -> Column:
    """Consonants of a name, doubled letters once."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z]", ""), r"(.)\1+", "$1")
    return F.concat(F.substring(s, 1, 1), F.regexp_replace(F.substring(s, 2, 100), "[aeiouy]", ""))


def search(queries: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """The k best places of each query: equal, prefix, inside, same skeleton, among the names with the query's first
    letter or skeleton only. ranked_search has all matches and the reference's ranks."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    q = queries.withColumns({"fq": fold(F.col("q")), "key": F.explode(F.array(F.substring(fold(F.col("q")), 1, 1), skeleton(F.col("q"))))})
    p = places.withColumns({"fp": fold(F.col("name")), "key": F.explode(F.array(F.substring(fold(F.col("name")), 1, 1), skeleton(F.col("name"))))})
    rank = F.when(F.col("fp") == F.col("fq"), 0).when(F.col("fp").startswith(F.col("fq")), 1).when(F.col("fp").contains(F.col("fq")), 2).when(skeleton(F.col("name")) == skeleton(F.col("q")), 3)
    j = q.join(p, "key").withColumn("rank", rank).where("rank is not null").select("q", "place_id", "name", "rank").distinct()
    w = Window.partitionBy("q").orderBy("rank", F.length("name"), "name", "place_id")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


#: Respellings, in order: what a name is folded by.
FOLDS = tuple((re.compile(a), b) for a, b in (("sh", "s"), ("([bcdfgjklmnpqrstx])h", r"\1"), ("[vw]", "b"), ("z", "j"), ("y", "i"), ("ck|q", "k"), ("ee|ie", "i"), ("oo|ou", "u"), (r"(.)\1+", r"\1")))
#: Query forms up to this number are broadcast; more are joined by shuffle.
BROADCAST_FORMS = 100_000


def search_forms(name: str | None) -> tuple[str, str, str]:
    """A name's letters and digits, those folded by spelling, and the fold without vowels."""
    plain = folded = re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", (name or "").lower()))
    for what, by in FOLDS:
        folded = what.sub(by, folded)
    return plain, folded, re.sub("[aeiou]", "", folded)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _forms(names: pd.Series) -> pd.Series:
    return pd.Series([list(search_forms(n)) for n in names], dtype=object)


def _grams(form: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct substrings of these lengths."""
    cut = lambda n: F.when(F.length(form) >= n, F.transform(F.sequence(F.lit(1), F.length(form) - n + 1), lambda i: F.substring(form, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[cut(n) for n in sizes])))


def ranked_search(queries: DataFrame, places: DataFrame, k: int, broadcast: int = BROADCAST_FORMS) -> DataFrame:
    """The k best of all places(place_id, name) that match each query(q), by rank, length, name and id. Rank 0: the name
    starts with the query; 1: holds it; 2, 3: the same of the folded forms; 4: skeletons of three letters on, from the
    start. A query without a Latin letter or digit matches nothing.

    Each kind of form meets on keys that no match can miss: plain and folded forms on the query's rarest gram (three
    letters, or the whole of a shorter query), skeletons on the prefix. The grams are at most 36 + 36^2 + 36^3 of a kind,
    so their counts are broadcast. The k best leave each task (the group limit before the window's shuffle)."""
    kinds = [F.struct(F.lit(i).alias("kind"), F.col("_f")[i].alias("form")) for i in range(3)]
    asked = queries.select("q").distinct().withColumn("_f", _forms("q")).where(F.length(F.col("_f")[0]) > 0).select("q", F.explode(F.array(*kinds)).alias("x")).select("q", "x.*")
    forms = asked.select("kind", "form").distinct()
    prefixes = F.when(F.length("form") >= 3, F.transform(F.sequence(F.lit(3), F.length("form")), lambda n: F.substring(F.col("form"), F.lit(1), n)))
    named = places.select("place_id", "name").withColumn("_f", _forms("name")).select("place_id", "name", F.explode(F.array(*kinds)).alias("x")).select("place_id", "name", "x.*")
    held = named.withColumn("key", F.explode(F.when(F.col("kind") < 2, _grams(F.col("form"), (1, 2, 3))).otherwise(prefixes)))
    seen = held.where("kind < 2").groupBy("kind", "key").agg(F.count("*").alias("n"))
    own = F.when(F.length("form") < 3, F.array("form")).otherwise(_grams(F.col("form"), (3,)))
    grams = forms.where("kind < 2").withColumn("key", F.explode(own)).join(F.broadcast(seen), ["kind", "key"], "left")
    rarest = grams.groupBy("kind", "form").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("m")).where("m.n > 0").select("kind", F.col("form").alias("ask"), "m.key")
    keys = rarest.unionByName(forms.where((F.col("kind") == 2) & (F.length("form") >= 3)).select("kind", F.col("form").alias("ask"), F.col("form").alias("key")))
    few = forms.limit(broadcast + 1).count() <= broadcast
    starts, at = F.col("form").startswith(F.col("ask")), 2 * F.col("kind")
    rank = F.when(starts, at).when((F.col("kind") < 2) & F.col("form").contains(F.col("ask")), at + 1)
    met = held.join(F.broadcast(keys) if few else keys, ["kind", "key"]).withColumn("rank", rank).where("rank is not null")
    order = ["rank", F.length("name"), "name", "place_id"]
    best = met.withColumn("_k", F.row_number().over(Window.partitionBy("kind", "ask").orderBy(*order))).where(F.col("_k") <= k)
    back = asked.withColumnRenamed("form", "ask").join(best, ["kind", "ask"]).groupBy("q", "place_id", "name").agg(F.min("rank").alias("rank"))
    return back.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("place") <= k)
