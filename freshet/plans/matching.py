"""Queries on names, matches and reviewed decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import text as t
from freshet.operators import match as m
from freshet.plans.bindings import table, view, with_views
from freshet.plans.registry import query


@query("slug_ids", "SELECT p_name, concat('g_', trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_')) AS slug, count(*) AS parts FROM part GROUP BY 1, 2")
def slug_ids(spark, d):
    return table(spark, d, "part").groupBy("p_name", F.concat(F.lit("g_"), t.slug(F.col("p_name"))).alias("slug")).agg(F.count("*").alias("parts"))


@query("fold_names", "SELECT n_name, regexp_replace(lower(n_name), '[^a-z]', '', 'g') AS letters, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS alnum FROM nation")
def fold_names(spark, d):
    return table(spark, d, "nation").select("n_name", t.letters(F.col("n_name")).alias("letters"), t.alnum(F.col("n_name")).alias("alnum"))


@query("expand_tokens", "SELECT DISTINCT p_type, replace(replace(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g'), 'economy', 'eco nomy'), 'standard', 'std') AS expanded FROM part")
def expand_tokens(spark, d):
    return table(spark, d, "part").select("p_type").distinct().select("p_type", t.expand(F.col("p_type"), {"economy": "eco nomy", "standard": "std"}).alias("expanded"))


@query("alias_join", with_views("SELECT locality_id, n_nationkey AS id FROM v_localities LEFT JOIN nation ON regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(district), '[^a-z0-9]', '', 'g') AND n_nationkey % 4 <> 0", "v_localities"))
def alias_join(spark, d):
    """Every second name carries a suffix that only the second try removes."""
    names = view(spark, d, "v_localities").withColumn("n", F.when(F.col("locality_id") % 2 == 0, F.concat("district", F.lit(" District"))).otherwise(F.lower("district")))
    aliases = table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("alias"))
    return m.alias_lookup(names, "n", aliases).select("locality_id", "id")


@query("expand_institutions", """SELECT p_partkey, concat(list_extract(['lower primary', 'lower primary school', 'middle english', 'middle english school', 'high school', 'higher secondary school', 'government high school', 'middle vernacular'], CAST(p_partkey % 8 + 1 AS INTEGER)), ' ', regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS expanded FROM part""")
def expand_institutions(spark, d):
    """Every name behind one of the abbreviations, every second time with dots."""
    short = F.element_at(F.array(*[F.lit(a) for a in ("L.P.", "lps", "M.E.", "mes", "H.S.", "hss", "G.H.S.", "mv")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", t.expand(F.concat(short, F.lit(" "), "p_name")).alias("expanded"))


@query("unique_claimant", "SELECT p_name AS k, min(p_brand) AS owner, count(*) AS parts FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def unique_claimant(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("k"), F.col("p_brand").alias("owner"))
    return m.unique_claims(rows, "k", "owner").groupBy("k").agg(F.min("owner").alias("owner"), F.count("*").alias("parts"))


@query("unique_claimant_all")
def unique_claimant_all(spark, d):
    """The same as unique_claimant, under its earlier name."""
    return unique_claimant(spark, d)


@query("tiered_match", """SELECT p_partkey AS id, CASE WHEN same = 1 THEN 'matched' WHEN same > 1 THEN 'ambiguous' WHEN names = 1 THEN 'other_district' WHEN names > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state, CASE WHEN same = 1 THEN ex WHEN same IS NULL AND names = 1 THEN one END AS rid
FROM (SELECT p_partkey, p_name AS n, p_brand AS b FROM part) LEFT JOIN (SELECT p_name AS n, count(*) AS names, min(p_partkey) AS one FROM part GROUP BY 1) USING (n) LEFT JOIN (SELECT p_name AS n, p_brand AS b, count(*) AS same, min(p_partkey) AS ex FROM part GROUP BY 1, 2) USING (n, b)""")
def tiered_match(spark, d):
    """All parts against all parts by name and brand."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("n"), F.col("p_brand").alias("b"))
    return m.tiered(p, p.withColumnRenamed("id", "rid"), "n", "b")


@query("tiered_match_all")
def tiered_match_all(spark, d):
    """The same as tiered_match, under its earlier name."""
    return tiered_match(spark, d)


@query("fuzzy_block_match")
def fuzzy_block_match(spark, d):
    """Every part is on one side; sizes stand for villages. Parts are no schools, so every name passes the gate."""
    p = table(spark, d, "part").withColumns({"name": F.concat_ws(" ", "p_name", F.lower("p_type")), "village": F.col("p_size").cast("string")})
    left = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), "name", "village", "p_brand")
    right = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("rid"), "name", "village", "p_brand")
    return m.school_match(left, right, "p_brand", words=("",))


@query("decision_override", with_views("SELECT locality_id, CASE WHEN locality_id % 5 = 0 THEN NULL WHEN locality_id % 5 = 1 THEN 'G_view' ELSE 'G_error' END AS gauge_id, CASE WHEN locality_id % 5 = 0 THEN 'ungauged' WHEN locality_id % 5 = 1 THEN 'replace' ELSE 'default' END AS basis FROM v_localities", "v_localities"))
def decision_override(spark, d):
    places = view(spark, d, "v_localities")
    decisions = places.where("locality_id % 5 < 2").select("locality_id", F.when(F.col("locality_id") % 5 == 0, "ungauged").otherwise("replace").alias("decision"), F.when(F.col("locality_id") % 5 == 1, "G_view").alias("gauge"))
    return m.decided(places.select("locality_id", F.lit("G_error").alias("default_gauge")), decisions, "locality_id")


_LACK = "len(list_filter(string_split({a}.n, ' '), lambda x: NOT list_contains(string_split({b}.n, ' '), x))) = 0"


@query("token_subset_join", f"WITH p AS (SELECT DISTINCT p_name AS n FROM part), q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS n FROM part UNION SELECT 'red ring') SELECT p.n AS a, q.n AS b FROM p, q WHERE {_LACK.format(a='p', b='q')} OR {_LACK.format(a='q', b='p')}")
def token_subset_join(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    heads = names.select(F.split_part("a", F.lit(" "), F.lit(1)).alias("b")).union(spark.createDataFrame([("red ring",)], "b string")).distinct()
    return m.subset_pairs(names.withColumn("ta", t.fold_river(F.col("a"))), heads.withColumn("tb", t.fold_river(F.col("b"))))


@query("identity_dedupe", "SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
def identity_dedupe(spark, d):
    return m.first_by(table(spark, d, "part"), ["p_name"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_name", "p_partkey")


@query("camps_for_locality", with_views("SELECT l.locality_id, count(DISTINCT p.point_id) AS camps FROM v_localities l JOIN v_points p ON p.owner_id = l.district_id AND (p.point_id % 10 = l.locality_id % 10 OR p.point_id % 3 = 0) GROUP BY 1", "v_localities", "v_points"))
def camps_for_locality(spark, d):
    """District must match; the circle matches or is unknown. Points are counted per district and circle first, so no pairs
    are made: those of unknown circle, plus those of the same circle that are not among them."""
    points = view(spark, d, "v_points").select(F.col("owner_id").alias("district_id"), "point_id").distinct().select("district_id", (F.col("point_id") % 10).alias("c"), (F.col("point_id") % 3 == 0).alias("unknown"))
    known = points.where("not unknown").groupBy("district_id", "c").agg(F.count("*").alias("known"))
    unknown = points.where("unknown").groupBy("district_id").agg(F.count("*").alias("free"))
    places = view(spark, d, "v_localities").select("locality_id", "district_id", (F.col("locality_id") % 10).alias("c"))
    camps = F.coalesce("known", F.lit(0)) + F.coalesce("free", F.lit(0))
    return places.join(known, ["district_id", "c"], "left").join(unknown, "district_id", "left").select("locality_id", camps.alias("camps")).where("camps > 0")


@query("registry_union", with_views("SELECT kind, count(*) AS rows, count(DISTINCT id) AS ids, count(*) - count(DISTINCT id) AS duplicates FROM (SELECT 'base' AS kind, locality_id AS id FROM v_localities UNION ALL SELECT 'supplement', locality_id % 90 + 1000 FROM v_localities) GROUP BY 1", "v_localities"))
def registry_union(spark, d):
    base = view(spark, d, "v_localities").select(F.lit("base").alias("kind"), F.col("locality_id").alias("id"))
    more = view(spark, d, "v_localities").select(F.lit("supplement").alias("kind"), (F.col("locality_id") % 90 + 1000).alias("id"))
    return base.unionByName(more).groupBy("kind").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), (F.count("*") - F.count_distinct("id")).alias("duplicates"))
