"""Queries on bulletin rows (line items as rows, orders as documents), alerts and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import text as t
from freshet.operators import alerts as a
from freshet.operators import bulletins as b
from freshet.operators import gauges as g
from freshet.operators import rainfall as r
from freshet.plans import gauges as gq
from freshet.plans import rainfall as rq
from freshet.plans.bindings import AS_OF, table, view, with_views
from freshet.plans.registry import query


def _items(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_quantity").alias("qty"), F.min("l_returnflag").alias("flag"))


_ITEMS = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, max(l_quantity) AS qty, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2"


@query("section_filldown", f"SELECT l_orderkey, l_linenumber, last_value(CASE WHEN flag = 'A' THEN part END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS section FROM ({_ITEMS})")
def section_filldown(spark, d):
    """Rows flagged A are headers; a row before the first header has no section."""
    return b.fill_down(_items(spark, d), "l_orderkey", "l_linenumber", F.when(F.col("flag") == "A", F.col("part")), "section").select("l_orderkey", "l_linenumber", "section")


@query("hierarchy_filldown", f"""SELECT l_orderkey, district, count(DISTINCT circle) AS circles, count(*) AS villages FROM (SELECT l_orderkey, flag, last_value(CASE WHEN flag = 'A' THEN part END IGNORE NULLS) OVER w AS district, last_value(CASE WHEN flag = 'N' THEN part END IGNORE NULLS) OVER w AS circle
 FROM ({_ITEMS}) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) WHERE flag = 'R' AND district IS NOT NULL GROUP BY 1, 2""")
def hierarchy_filldown(spark, d):
    rows = b.fill_down(_items(spark, d), "l_orderkey", "l_linenumber", F.when(F.col("flag") == "A", F.col("part")), "district")
    rows = b.fill_down(rows, "l_orderkey", "l_linenumber", F.when(F.col("flag") == "N", F.col("part")), "circle")
    return rows.where("flag = 'R' and district is not null").groupBy("l_orderkey", "district").agg(F.count_distinct("circle").alias("circles"), F.count("*").alias("villages"))


@query("row_stitch", f"""SELECT l_orderkey, CAST(record AS BIGINT) AS record, string_agg(txt, ' ' ORDER BY l_linenumber) AS text, count(*) AS rows, record = 0 AS unfinished FROM (SELECT *, CAST(part AS VARCHAR) AS txt, sum(CASE WHEN flag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS record FROM ({_ITEMS})) GROUP BY l_orderkey, record""")
def row_stitch(spark, d):
    return b.stitch(_items(spark, d).withColumn("txt", F.col("part").cast("string")), "l_orderkey", "l_linenumber", F.col("flag") == "A", "txt")


_ALIAS = [("A", "accepted"), ("N", "new"), ("R", "new")]


@query("header_resolve", f"SELECT l_orderkey, logical, min(l_linenumber) AS position, count(*) AS times, count(*) = 1 AS resolved FROM ({_ITEMS}) JOIN (VALUES ('A', 'accepted'), ('N', 'new'), ('R', 'new')) AS v(flag, logical) USING (flag) GROUP BY 1, 2")
def header_resolve(spark, d):
    cells = _items(spark, d).select("l_orderkey", F.col("flag").alias("header"), F.col("l_linenumber").alias("position"))
    return b.resolve_headers(cells, spark.createDataFrame(_ALIAS, "header string, logical string"), "l_orderkey")


@query("bulletin_metrics", f"SELECT l_orderkey, metric, value FROM (SELECT l_orderkey, unnest([{{'metric': 'rows', 'value': CAST(count(*) AS DOUBLE)}}, {{'metric': 'returned', 'value': CAST(sum(qty) FILTER (flag = 'R') AS DOUBLE)}}], recursive := true) FROM ({_ITEMS}) GROUP BY 1) WHERE value IS NOT NULL")
def bulletin_metrics(spark, d):
    rows = _items(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("flag") == "R", F.col("qty"))).alias("q"))
    return b.long_metrics(rows, ["l_orderkey"], {"rows": F.col("n"), "returned": F.col("q")})


@query("bracket_pairs", "SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS number FROM part UNION ALL SELECT p_partkey, 'other', CAST(p_size + 1 AS VARCHAR) FROM part")
def bracket_pairs(spark, d):
    """Names and numbers out of "small ring (11), other (12)"."""
    p = table(spark, d, "part").select("p_partkey", F.format_string("%s (%d), other ( %d )", "p_name", "p_size", F.col("p_size") + 1).alias("s"))
    return p.select("p_partkey", F.explode(t.bracket_pairs(F.col("s"))).alias("x")).select("p_partkey", "x.name", "x.number")


@query("split_phones", "SELECT c_custkey, n FROM (SELECT c_custkey, unnest([CAST(c_custkey + 9864000000 AS VARCHAR), CAST(c_custkey + 3610000 AS VARCHAR)]) AS n FROM customer)")
def split_phones(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.format_string("+%d / %d; ext. 12", F.col("c_custkey") + 9864000000, F.col("c_custkey") + 3610000).alias("s"))
    return c.select("c_custkey", F.explode(t.phones(F.col("s"))).alias("n"))


@query("sum_invariant", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END END AS at FROM orders".replace(" AS at ", ' AS "at" '))
def sum_invariant(spark, d):
    """Three parts and their total, in the first or second place, or nowhere."""
    k = F.col("o_orderkey").cast("double")
    nums = F.when(F.col("o_orderkey") % 3 == 0, F.array(k, k + 1, F.lit(2.0), 2 * k + 3, F.lit(0.5))).when(F.col("o_orderkey") % 3 == 2, F.array(F.lit(-7.0), k, k + 1, F.lit(2.0), 2 * k + 3)).otherwise(F.array(k + 1, k + 1, k + 1, F.lit(0.0)))
    return table(spark, d, "orders").select("o_orderkey", t.first_sum(nums).alias("at"))


@query("roster_project", "SELECT c_custkey AS code, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 10 <> 0")
def roster_project(spark, d):
    """Blank names become null, texts that are no number are null, rows without a code go."""
    raw = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_custkey").cast("string")).alias("code"), F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name")).alias("name"), F.concat(F.lit(" "), F.col("c_acctbal").cast("string")).alias("balance"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select(F.try_to_number(blank("code"), F.lit("999999999")).cast("long").alias("code"), blank("name").alias("name"), F.expr("try_cast(trim(balance) as double)").alias("balance")).where("code is not null")


@query("review_items", "SELECT reason, count(*) AS items FROM (SELECT 'negative' AS reason FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'round' FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 'negative' FROM supplier WHERE s_acctbal < 0) GROUP BY 1")
def review_items(spark, d):
    """Reason arrays of two steps, unioned; a row may give several items."""
    reasons = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    one = table(spark, d, "customer").select(F.explode(reasons(F.when(F.col("c_acctbal") < 0, "negative"), F.when(F.col("c_custkey") % 50 == 0, "round"))).alias("reason"))
    two = table(spark, d, "supplier").select(F.explode(reasons(F.when(F.col("s_acctbal") < 0, "negative"))).alias("reason"))
    return one.unionByName(two).groupBy("reason").agg(F.count("*").alias("items"))


def _snap(spark, d):
    return g.snapshot(view(spark, d, "v_stations"), view(spark, d, "v_readings"), AS_OF, gq.HOURS)


_S = f"SELECT *, {gq._STATUS} AS status FROM ({gq._SNAP})"
_NEXT = "least(CASE WHEN warning_level_m > level_m THEN warning_level_m END, CASE WHEN danger_level_m > level_m THEN danger_level_m END, CASE WHEN highest_flood_level_m > level_m THEN highest_flood_level_m END)"


@query("next_threshold", with_views(f"SELECT gauge_id, min(nxt) AS lowest, max(nxt) AS highest, count(*) - count(nxt) AS above_all FROM (SELECT gauge_id, {_NEXT} AS nxt FROM v_readings JOIN v_stations USING (gauge_id)) GROUP BY 1", "v_readings", "v_stations"))
def next_threshold(spark, d):
    j = view(spark, d, "v_readings").join(view(spark, d, "v_stations"), "gauge_id").withColumn("n", a.next_threshold("level_m", "warning_level_m", "danger_level_m", "highest_flood_level_m"))
    return j.groupBy("gauge_id").agg(F.min("n").alias("lowest"), F.max("n").alias("highest"), (F.count("*") - F.count("n")).alias("above_all"))


@query("river_sentence", with_views(f"""SELECT gauge_id, CASE WHEN level_m IS NULL THEN gauge_id || ' has no current reading' ELSE printf('%s stands at %.2f m (', gauge_id, level_m) || status || ')' || CASE WHEN tr > 0 THEN printf(', rising %.2f cm per hour', tr) WHEN tr < 0 THEN printf(', falling %.2f cm per hour', -tr) WHEN tr = 0 THEN ', steady' ELSE '' END END AS sentence
 FROM ({_S}) LEFT JOIN (SELECT gauge_id, CASE WHEN reason IS NULL THEN rate END AS tr FROM ({gq._TREND.format('v_readings')})) USING (gauge_id)""", "v_readings", "v_stations"))
def river_sentence(spark, d):
    j = _snap(spark, d).join(g.trend(view(spark, d, "v_readings")).select("gauge_id", "trend_cm_per_hour"), "gauge_id", "left")
    return j.select("gauge_id", a.river_sentence("gauge_id", "level_m", "status", "trend_cm_per_hour").alias("sentence"))


@query("rain_sentence", with_views(f"""SELECT zone_id, CASE WHEN headline_mm IS NULL THEN zone_id || ': no complete rainfall window' ELSE printf('%s: %.1f mm in %d hours', zone_id, floor(headline_mm * 10) / 10, headline_hours) || CASE WHEN context_mm IS NULL THEN '' ELSE printf(', %.1f mm in 72 hours', floor(context_mm * 10) / 10) END END AS sentence FROM (
 SELECT zone_id, h.w AS headline_hours, h.t AS headline_mm, CASE WHEN h.w < 72 AND c - h.t >= 10 THEN c END AS context_mm FROM (SELECT zone_id, max({{'p': window_hours = 24, 'w': window_hours, 't': total_mm}}) FILTER (total_mm IS NOT NULL) AS h, max(total_mm) FILTER (window_hours = 72) AS c FROM ({rq._ALL[:-1]}) GROUP BY 1))""", "v_zone_weights", "v_grid_obs"))
def rain_sentence(spark, d):
    h = r.headline(r.window_totals(view(spark, d, "v_zone_weights"), rq._full(spark, d), r.windows(spark, rq.HOURS, rq.AS_OF)))
    return h.select("zone_id", a.rain_sentence("zone_id", "headline_hours", "headline_mm", "context_mm").alias("sentence"))


_GAUGE = "CASE district_id % 6 WHEN 0 THEN 'G_click' WHEN 1 THEN 'G_error' WHEN 2 THEN 'G_purchase' WHEN 3 THEN 'G_signup' WHEN 4 THEN 'G_view' ELSE 'G_silent' END"
_STATES = f"SELECT locality_id, state AS region, district, p.gauge_id, level_m, CASE WHEN locality_id % 9 = 0 THEN 'ungauged' ELSE coalesce(status, 'no_data') END AS state FROM (SELECT *, {_GAUGE} AS gauge_id FROM v_localities) p LEFT JOIN ({_S}) s ON s.gauge_id = p.gauge_id"


def _states(spark, d):
    places = view(spark, d, "v_localities").withColumnRenamed("state", "region").withColumn("gauge_id", F.expr(_GAUGE))
    return a.locality_states(places, _snap(spark, d), F.col("locality_id") % 9 == 0)


@query("locality_gauge", with_views(f"SELECT locality_id, gauge_id, level_m FROM ({_STATES}) WHERE state NOT IN ('ungauged', 'no_data')", "v_localities", "v_readings", "v_stations"))
def locality_gauge(spark, d):
    return _states(spark, d).where("state not in ('ungauged', 'no_data')").select("locality_id", "gauge_id", "level_m")


@query("locality_state", with_views(f"SELECT locality_id, state FROM ({_STATES})", "v_localities", "v_readings", "v_stations"))
def locality_state(spark, d):
    return _states(spark, d).select("locality_id", "state")


@query("state_overview", with_views(f"""SELECT region, danger, warning, normal, no_data, ungauged, CASE WHEN danger + warning + normal + no_data > 0 THEN round((danger + warning + normal) / (danger + warning + normal + no_data), 6) END AS readable FROM (SELECT region, count(*) FILTER (state IN ('above_danger', 'above_hfl')) AS danger,
 count(*) FILTER (state = 'warning') AS warning, count(*) FILTER (state = 'normal') AS normal, count(*) FILTER (state = 'no_data') AS no_data, count(*) FILTER (state = 'ungauged') AS ungauged FROM ({_STATES}) GROUP BY 1)""", "v_localities", "v_readings", "v_stations"))
def state_overview(spark, d):
    return a.overview(_states(spark, d), "region")


@query("highest_concern", with_views(f"SELECT locality_id, state, level_m FROM ({_STATES}) WHERE state NOT IN ('ungauged', 'no_data') ORDER BY CASE state WHEN 'above_hfl' THEN 3 WHEN 'above_danger' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, level_m DESC, locality_id LIMIT 1", "v_localities", "v_readings", "v_stations"))
def highest_concern(spark, d):
    level = F.when(F.col("state") == "above_hfl", 3).when(F.col("state") == "above_danger", 2).when(F.col("state") == "warning", 1).otherwise(0)
    return _states(spark, d).where("state not in ('ungauged', 'no_data')").orderBy(level.desc(), F.desc("level_m"), "locality_id").limit(1).select("locality_id", "state", "level_m")


@query("select_stations", with_views(f"SELECT locality_id, gauge_id, danger_level_m, locality_id % 8 = 0 AS upstream FROM (SELECT *, {_GAUGE} AS gauge_id FROM v_localities WHERE lat IS NOT NULL AND state IN ('ASIA', 'AFRICA')) JOIN v_stations USING (gauge_id) WHERE danger_level_m IS NOT NULL", "v_localities", "v_stations"))
def select_stations(spark, d):
    places = view(spark, d, "v_localities").where("lat is not null and state in ('ASIA', 'AFRICA')").withColumn("gauge_id", F.expr(_GAUGE))
    j = places.join(view(spark, d, "v_stations").where("danger_level_m is not null"), "gauge_id")
    return j.select("locality_id", "gauge_id", "danger_level_m", (F.col("locality_id") % 8 == 0).alias("upstream"))


@query("serving_filter", with_views(f"SELECT s.gauge_id, l.level_m FROM v_stations s LEFT JOIN ({gq._LATEST}) l USING (gauge_id) WHERE l.observed_at IS NULL OR date_diff('second', l.observed_at, TIMESTAMP '{AS_OF}') <= 3 * 3600", "v_stations", "v_readings"))
def serving_filter(spark, d):
    """Gauges silent for too long are withheld; those that never reported are kept."""
    j = view(spark, d, "v_stations").join(g.latest(view(spark, d, "v_readings")), "gauge_id", "left")
    return j.where(F.col("observed_at").isNull() | (g.seconds_between("observed_at", g.clock(AS_OF)) <= 3 * 3600)).select("gauge_id", "level_m")


@query("match_scope", with_views("SELECT CASE WHEN point_id % 3 = 0 AND lon < 95 THEN 'coordinates' WHEN point_id % 5 = 0 THEN 'circle' WHEN owner_id % 2 = 0 THEN 'district' ELSE 'unresolved' END AS scope, count(*) AS records FROM v_points GROUP BY 1", "v_points"))
def match_scope(spark, d):
    p = view(spark, d, "v_points")
    scope = F.when((F.col("point_id") % 3 == 0) & (F.col("lon") < 95), "coordinates").when(F.col("point_id") % 5 == 0, "circle").when(F.col("owner_id") % 2 == 0, "district").otherwise("unresolved")
    return p.groupBy(scope.alias("scope")).agg(F.count("*").alias("records"))
