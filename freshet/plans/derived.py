"""Queries on shapes, sessions, alert memory and records that combine several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.similarity import token_set_ratio
from freshet.operators import bulletins as b
from freshet.operators import gauges as g
from freshet.operators import reports as r
from freshet.operators import shapes as sh
from freshet.operators import spatial as s
from freshet.plans import gauges as gq
from freshet.plans import places as pq
from freshet.plans.bindings import table, view, with_views
from freshet.plans.registry import query
from freshet.shared import new_path
from freshet.sources import files
from freshet.streaming import operators as st


@query("interior_point")
def interior_point(spark, d):
    e = pq._edges(spark, d)
    return sh.interior_points(e, s.ring_area(e).select("shape_id", "cx", "cy"), 0.05)


@query("line_in_polygon", with_views(f"""SELECT line_id, shape_id, count(*) AS vertices, round(coalesce(sum({pq._KM.format(a='i', b='j').replace('i.lon', 'lon0').replace('i.lat', 'lat0').replace('j.lon', 'lon').replace('j.lat', 'lat')}), 0), 4) AS km FROM (
 SELECT owner_id AS line_id, shape_id, lon, lat, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM ({pq._INSIDE}) WINDOW w AS (PARTITION BY owner_id, shape_id ORDER BY point_id)) GROUP BY 1, 2""", "v_points", "v_ring_vertices"))
def line_in_polygon(spark, d):
    lines = view(spark, d, "v_points").select(F.col("owner_id").alias("line_id"), F.col("point_id").alias("seq"), "lon", "lat")
    return sh.line_inside(lines, pq._edges(spark, d)).withColumn("km", F.round("km", 4))


@query("place_search")
def place_search(spark, d):
    q = table(spark, d, "nation").select(F.concat(F.lit("Suplier"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("q"))
    return sh.ranked_search(q, table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("name")), 4)


@query("token_set_ratio")
def token_set_ratio_query(spark, d):
    p = table(spark, d, "part")
    pairs = p.groupBy("p_brand", "p_name").agg(F.min("p_type").alias("low"), F.max("p_type").alias("high"))
    return pairs.select("p_brand", "p_name", F.round(token_set_ratio(F.concat_ws(" ", "p_name", "low"), F.concat_ws(" ", "p_name", "high")), 4).alias("ratio"))


@query("stream_windows", with_views("""SELECT cell_id, strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, n, CASE WHEN n = 6 THEN CAST(mm AS DOUBLE) END AS total_mm FROM (SELECT cell_id, interval_start + INTERVAL 30 MINUTE * CAST(k AS INTEGER) AS as_of, count(*) AS n, sum(rate_mm_h / 2) AS mm
 FROM v_grid_obs CROSS JOIN (SELECT unnest(range(1, 7)) AS k) GROUP BY 1, 2)""", "v_grid_obs"))
def stream_windows(spark, d):
    """The sliding windows of the stream operator over the batch table."""
    o = view(spark, d, "v_grid_obs").withColumn("interval_start", F.col("interval_start").cast("timestamp"))
    t = st.trailing_totals(o, hours=3)
    return t.select("cell_id", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), "n", F.col("total_mm").cast("double").alias("total_mm"))


@query("conversation_state", with_views("""SELECT subject_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY subject_id ORDER BY ts, delivery_id) AS s FROM (
 SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY subject_id ORDER BY ts, delivery_id) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM v_deliveries)) GROUP BY subject_id, s""", "v_deliveries"))
def conversation_state(spark, d):
    e = view(spark, d, "v_deliveries").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.sessions(e, "subject_id").withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


_HIGH = f"SELECT gauge_id, observed_at AS t, CASE {gq._STATUS} WHEN 'above_hfl' THEN 2 ELSE 1 END AS sev FROM v_readings JOIN v_stations USING (gauge_id) WHERE {gq._STATUS} IN ('above_danger', 'above_hfl')"
_DUE = "e.t >= f.last + INTERVAL 6 HOUR OR e.sev > f.sev"


@query("alert_engine", with_views(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY t) AS k FROM ({_HIGH})), f AS (SELECT gauge_id, k, t AS last, sev, 1 AS n FROM e WHERE k = 1
 UNION ALL SELECT f.gauge_id, e.k, CASE WHEN {_DUE} THEN e.t ELSE f.last END, CASE WHEN {_DUE} THEN e.sev ELSE f.sev END, f.n + CASE WHEN {_DUE} THEN 1 ELSE 0 END FROM f JOIN e ON e.gauge_id = f.gauge_id AND e.k = f.k + 1)
SELECT gauge_id, max(k) AS events, max(n) AS pushed, strftime(max(last) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS expires FROM f GROUP BY 1""", "v_readings", "v_stations").replace("WITH v_readings", "WITH RECURSIVE v_readings"))
def alert_engine(spark, d):
    """Alerts of gauges above danger: pushed with a cooldown, at once if severity rises, expiring after 12 hours."""
    j = view(spark, d, "v_readings").join(view(spark, d, "v_stations"), "gauge_id")
    j = j.withColumn("status", g.level_status("level_m", "warning_level_m", "danger_level_m", "highest_flood_level_m")).where("status in ('above_danger', 'above_hfl')")
    e = j.select("gauge_id", F.col("observed_at").alias("at"), F.when(F.col("status") == "above_hfl", 2).otherwise(1).alias("severity"), F.lit(0).alias("event_id"))
    return r.cooled_pushes(e, "gauge_id", 6).select("gauge_id", "events", "pushed", F.date_format(F.col("last_push") + F.expr("interval 12 hours"), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("decision_problems", with_views("""SELECT problem, count(*) AS decisions FROM (SELECT unnest(list_filter([CASE WHEN locality_id % 6 = 0 THEN 'no_reviewer' END, CASE WHEN locality_id % 4 = 1 AND locality_id % 10 = 1 AND locality_id % 9 <> 4 THEN 'no_gauge' END, CASE WHEN locality_id % 9 = 4 THEN 'unknown_gauge' END], lambda x: x IS NOT NULL)) AS problem FROM v_localities) GROUP BY 1""", "v_localities"))
def decision_problems(spark, d):
    """All problems of the reviewed decisions, one row per problem, not only the first."""
    k = lambda n: F.col("locality_id") % n
    dec = view(spark, d, "v_localities").select("locality_id", F.when(k(6) != 0, "a").alias("reviewer"), F.when(k(4) == 1, "replace").otherwise("keep").alias("decision"), F.when(k(9) == 4, "G_none").when(k(10) != 1, "G_view").alias("gauge_id"))
    known = view(spark, d, "v_stations").select("gauge_id", F.lit(True).alias("known"))
    j = dec.join(known, "gauge_id", "left")
    found = F.filter(F.array(
        F.when(F.col("reviewer").isNull(), "no_reviewer"), F.when((F.col("decision") == "replace") & F.col("gauge_id").isNull(), "no_gauge"), F.when(F.col("gauge_id").isNotNull() & F.col("known").isNull(), "unknown_gauge"),
    ), lambda x: x.isNotNull())
    return j.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("decisions"))


@query("osm_relations", "SELECT o_orderpriority AS level, count(DISTINCT o_orderkey) AS relations, count(*) AS members FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def osm_relations(spark, d):
    """Relations with an array of members, split by level and exploded."""
    rel = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("members")).join(table(spark, d, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')"), "o_orderkey")
    flat = rel.select(F.col("o_orderpriority").alias("level"), "o_orderkey", F.explode("members"))
    return flat.groupBy("level").agg(F.count_distinct("o_orderkey").alias("relations"), F.count("*").alias("members"))


@query("camp_rows", "SELECT c_nationkey AS circle, count(*) AS camps, count(*) FILTER (c_custkey % 7 <> 0) AS located FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def camp_rows(spark, d):
    """Rows with a serial number under carried circle headers; coordinates outside the box are no coordinates."""
    c = table(spark, d, "customer")
    head = c.groupBy("c_nationkey").agg(F.lit(-1).cast("long").alias("c_custkey")).withColumns({"serial": F.lit("Circle"), "lat": F.lit(None).cast("double")})
    rows = c.select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 5 == 0, "total").otherwise(F.format_string(" %d ", "c_custkey")).alias("serial"), F.when(F.col("c_custkey") % 7 == 0, 99.0).otherwise(26.0).alias("lat"))
    both = head.unionByName(rows)
    filled = b.fill_down(both, "c_nationkey", "c_custkey", F.when(F.col("serial") == "Circle", F.col("c_nationkey")), "circle").where(F.col("serial").rlike(r"^\s*\d+\s*$"))
    return filled.groupBy("circle").agg(F.count("*").alias("camps"), F.count_if(F.col("lat").between(23, 29)).alias("located"))


@query("infrastructure_records", "SELECT l_returnflag AS kind, CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN 'coordinates' WHEN l_linestatus = 'F' THEN 'circle' ELSE 'district' END AS scope, count(*) AS records FROM lineitem GROUP BY 1, 2")
def infrastructure_records(spark, d):
    """Records of each kind with the finest place they can be matched to."""
    li = table(spark, d, "lineitem")
    scope = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 0), "coordinates").when(F.col("l_linestatus") == "F", "circle").otherwise("district")
    return li.groupBy(F.col("l_returnflag").alias("kind"), scope.alias("scope")).agg(F.count("*").alias("records"))


@query("grid_text_to_cells", "SELECT CAST(user_id % 8 AS VARCHAR) AS lon, count(*) AS cells, CAST(max(value) AS DOUBLE) AS highest FROM (SELECT user_id % 8 AS user_id, date_trunc('hour', ts) AS h, max(value) AS value FROM events WHERE user_id % 8 < 8 GROUP BY 1, 2) GROUP BY 1")
def grid_text_to_cells(spark, d):
    """Eight columns of hourly values written as grid text, one file a day, and read back; the fill value is missing."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("c"), F.date_trunc("hour", "ts").alias("h")).agg(F.max("value").alias("v"))
    hours = e.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(-9999.9)).cast("string")), ", ")
    day = hours.select(F.to_date("h").alias("d"), F.hour("h").alias("k"), line.alias("line")).groupBy("d").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    text = F.concat(F.lit("lon, 0, 1, 2, 3, 4, 5, 6, 7\nlat, "), F.array_join(F.transform("l", lambda x: x["k"].cast("string")), ", "), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    path = new_path(spark, "grid")
    day.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    cells = files.grid_text(spark, path).where("rate is not null")
    return cells.groupBy(F.col("lon").cast("int").cast("string").alias("lon")).agg(F.count("*").alias("cells"), F.max("rate").alias("highest"))
