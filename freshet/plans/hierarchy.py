"""Queries on revisions, publication and the state - district - circle hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import publication as p
from freshet.plans.bindings import table, view, with_views
from freshet.plans.registry import query

NOW = "2001-01-01 00:00:00"


def _rev(spark, d):
    return view(spark, d, "v_revisions")


def _hier(spark, d):
    return view(spark, d, "v_hierarchy")


def _day(c):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


_OK = "publication_state IN ('validated', 'validated_partial')"
_VALID = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC, fetched_at DESC, revision_id DESC) AS rn FROM v_revisions WHERE {_OK}) WHERE rn = 1"


@query("latest_revision", with_views("SELECT entity_id, revision_id, publication_state FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC, fetched_at DESC, revision_id DESC) AS rn FROM v_revisions) WHERE rn = 1", "v_revisions"))
def latest_revision(spark, d):
    return p.newest(_rev(spark, d), ["entity_id"]).select("entity_id", "revision_id", "publication_state")


@query("pointer_publish", with_views(f"SELECT entity_id, revision_id, strftime(report_date, '%Y-%m-%d') AS report_date FROM ({_VALID})", "v_revisions"))
def pointer_publish(spark, d):
    """The pointer never moves to an earlier report: it is the largest eligible one."""
    return p.newest(_rev(spark, d).where(F.col("publication_state").isin(*p.PUBLISHABLE)), ["entity_id"]).select("entity_id", "revision_id", _day("report_date"))


def _pointers(spark, d):
    return p.newest(_rev(spark, d).where(F.col("publication_state").isin(*p.PUBLISHABLE)), ["entity_id"]).select("entity_id", "revision_id", "report_date")


@query("pointer_read", with_views(f"SELECT entity_id, revision_id, metric FROM ({_VALID})", "v_revisions"))
def pointer_read(spark, d):
    return p.read_through(_pointers(spark, d).select("entity_id", "revision_id"), _rev(spark, d).drop("report_date")).select("entity_id", "revision_id", "metric")


@query("pointer_read_all")
def pointer_read_all(spark, d):
    """The same as pointer_read, under its earlier name."""
    return pointer_read(spark, d)


@query("pointer_verify", with_views(f"""SELECT v.entity_id, v.revision_id, concat_ws(',', CASE WHEN r.revision_id IS NULL THEN 'missing' END, CASE WHEN r.publication_state = 'quarantined' THEN 'not_publishable' END, CASE WHEN r.report_date <> v.report_date THEN 'other_date' END) AS problems
 FROM (SELECT entity_id, report_date, revision_id + CASE WHEN entity_id % 10 = 0 THEN 1 ELSE 0 END AS revision_id FROM ({_VALID})) v LEFT JOIN v_revisions r USING (revision_id)""", "v_revisions"))
def pointer_verify(spark, d):
    moved = _pointers(spark, d).withColumn("revision_id", F.col("revision_id") + F.when(F.col("entity_id") % 10 == 0, 1).otherwise(0))
    return p.verify_pointers(moved, _rev(spark, d))


@query("merge_dimension", with_views("SELECT entity_id, arg_max(metric, (report_date, fetched_at, revision_id)) AS metric, strftime(min(report_date), '%Y-%m-%d') AS first_seen, count(*) AS revisions FROM v_revisions GROUP BY 1", "v_revisions"))
def merge_dimension(spark, d):
    """The newest values per key; a key that later revisions lack keeps its last ones."""
    r = _rev(spark, d)
    first = r.groupBy("entity_id").agg(F.min("report_date").alias("first_seen"), F.count("*").alias("revisions"))
    return p.newest(r, ["entity_id"]).select("entity_id", "metric").join(first, "entity_id").withColumn("first_seen", _day("first_seen"))


@query("widest_snapshot", with_views("SELECT strftime(report_date, '%Y-%m-%d') AS report_date, n FROM (SELECT report_date, count(DISTINCT entity_id) AS n FROM v_revisions GROUP BY 1) ORDER BY n DESC, report_date DESC LIMIT 1", "v_revisions"))
def widest_snapshot(spark, d):
    n = _rev(spark, d).groupBy("report_date").agg(F.count_distinct("entity_id").alias("n"))
    return n.orderBy(F.desc("n"), F.desc("report_date")).limit(1).select(_day("report_date"), "n")


@query("publication_state", with_views(f"""SELECT revision_id, CASE WHEN publication_state = 'quarantined' THEN 'quarantined' WHEN revision_id = vid THEN 'current' WHEN report_date = vd THEN 'superseded' ELSE 'historical' END AS state
 FROM v_revisions LEFT JOIN (SELECT entity_id, report_date AS vd, revision_id AS vid FROM ({_VALID})) USING (entity_id)""", "v_revisions"))
def publication_state(spark, d):
    return p.states(_rev(spark, d)).select("revision_id", "state")


@query("quarantine_sink", with_views("""SELECT entity_id, a AS latest_attempt, v AS latest_valid, quarantined, v IS NULL OR a <> v AS newer_quarantined FROM (SELECT entity_id, arg_max(revision_id, (report_date, fetched_at, revision_id)) AS a,
 arg_max(revision_id, (report_date, fetched_at, revision_id)) FILTER (publication_state <> 'quarantined') AS v, count(*) FILTER (publication_state = 'quarantined') AS quarantined FROM v_revisions GROUP BY 1)""", "v_revisions"))
def quarantine_sink(spark, d):
    return p.status(_rev(spark, d))


@query("history_manifest", with_views(f"SELECT strftime(report_date, '%Y-%m-%d') AS report_date, count(*) AS revisions, count(DISTINCT entity_id) AS entities, max(revision_id) AS newest FROM v_revisions WHERE {_OK} GROUP BY 1", "v_revisions"))
def history_manifest(spark, d):
    ok = _rev(spark, d).where(F.col("publication_state").isin(*p.PUBLISHABLE))
    return ok.groupBy(_day("report_date")).agg(F.count("*").alias("revisions"), F.count_distinct("entity_id").alias("entities"), F.max("revision_id").alias("newest"))


@query("history_label", with_views("SELECT revision_id, CASE WHEN report_date = max(report_date) OVER (PARTITION BY entity_id) THEN 'newest' WHEN date_diff('day', report_date, max(report_date) OVER (PARTITION BY entity_id)) > 365 THEN 'stale' ELSE 'older' END AS label FROM v_revisions", "v_revisions"))
def history_label(spark, d):
    """Compared with the entity's newest date, which is aggregated first and joined back."""
    r = _rev(spark, d)
    last = r.groupBy("entity_id").agg(F.max("report_date").alias("last"))
    label = F.when(F.col("report_date") == F.col("last"), "newest").when(F.datediff("last", "report_date") > 365, "stale").otherwise("older")
    return r.join(last, "entity_id").select("revision_id", label.alias("label"))


@query("report_state", with_views(f"SELECT publication_state, CASE WHEN publication_state = 'quarantined' THEN 'quarantined' WHEN date_diff('day', fetched_at, TIMESTAMP '{NOW}') <= 400 THEN 'current' ELSE 'stale' END AS state, count(*) AS revisions FROM v_revisions GROUP BY 1, 2", "v_revisions"))
def report_state(spark, d):
    age = F.datediff(F.lit(NOW).cast("timestamp_ntz"), F.col("fetched_at"))
    state = F.when(F.col("publication_state") == "quarantined", "quarantined").when(age <= 400, "current").otherwise("stale")
    return _rev(spark, d).groupBy("publication_state", state.alias("state")).agg(F.count("*").alias("revisions"))


@query("lookback_latest", with_views(f"SELECT entity_id, max(revision_id) AS revision_id, strftime(max(report_date), '%Y-%m-%d') AS report_date FROM (SELECT *, max(report_date) OVER (PARTITION BY entity_id) AS last FROM v_revisions WHERE report_date > TIMESTAMP '{NOW}' - INTERVAL 400 DAY) WHERE report_date = last GROUP BY 1", "v_revisions"))
def lookback_latest(spark, d):
    """Newest date within the last days that has a revision; the date filter reaches the scan."""
    recent = _rev(spark, d).where(F.col("report_date") > F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 400 days"))
    g = recent.groupBy("entity_id").agg(F.max(F.struct("report_date", "revision_id")).alias("m"))
    return g.select("entity_id", "m.revision_id", F.date_format("m.report_date", "yyyy-MM-dd").alias("report_date"))


@query("content_address", with_views("""SELECT report_date, count(*) AS rows, sha256(string_agg(h, '' ORDER BY h)) AS revision FROM (SELECT strftime(report_date, '%Y-%m-%d') AS report_date, sha256(concat_ws('|', entity_id, revision_id, publication_state)) AS h FROM v_revisions) GROUP BY 1""", "v_revisions"))
def content_address(spark, d):
    return p.content_revision(_rev(spark, d).withColumn("report_date", _day("report_date")), ["report_date"], ["entity_id", "revision_id", "publication_state"])


@query("provenance_checks", with_views("""SELECT entity_id % 10 AS source, bool_and(metric > 0) AS positive, bool_and(fetched_at >= report_date) AS fetched_after, bool_and(date_diff('day', report_date, fetched_at) <= 20) AS in_time, count(*) AS revisions FROM v_revisions GROUP BY 1""", "v_revisions"))
def provenance_checks(spark, d):
    return _rev(spark, d).groupBy((F.col("entity_id") % 10).alias("source")).agg(
        F.bool_and(F.col("metric") > 0).alias("positive"), F.bool_and(F.col("fetched_at") >= F.col("report_date")).alias("fetched_after"),
        F.bool_and(F.datediff("fetched_at", "report_date") <= 20).alias("in_time"), F.count("*").alias("revisions"),
    )


@query("publish_mask", with_views("SELECT district, circle, CASE WHEN circle % 4 <> 0 THEN CAST(affected AS DOUBLE) END AS affected FROM v_hierarchy WHERE state NOT IN ('ASIA')", "v_hierarchy"))
def publish_mask(spark, d):
    """Excluded groups go, values that are not validated become null."""
    gone = spark.createDataFrame([("ASIA",)], "state string")
    h = _hier(spark, d).join(gone, "state", "left_anti")
    return h.select("district", "circle", F.when(F.col("circle") % 4 != 0, F.col("affected").cast("double")).alias("affected"))


@query("metric_available", with_views("SELECT state, NOT list_contains(list_transform(['NATION_1', 'NATION_2'], lambda x: starts_with(min(district), x)), true) AS available FROM v_hierarchy GROUP BY 1", "v_hierarchy"))
def metric_available(spark, d):
    low = _hier(spark, d).groupBy("state").agg(F.min("district").alias("m"))
    return low.select("state", (~F.exists(F.array(F.lit("NATION_1"), F.lit("NATION_2")), lambda x: F.col("m").startswith(x))).alias("available"))


@query("hierarchy_reconcile", with_views("""SELECT coalesce(state, '*') AS state, coalesce(district, '*') AS district, count(*) AS circles, CAST(sum(affected) AS DOUBLE) AS affected FROM v_hierarchy GROUP BY ROLLUP (state, district)""", "v_hierarchy"))
def hierarchy_reconcile(spark, d):
    g = _hier(spark, d).rollup("state", "district").agg(F.count("*").alias("circles"), F.sum("affected").cast("double").alias("affected"))
    return g.select(F.coalesce("state", F.lit("*")).alias("state"), F.coalesce("district", F.lit("*")).alias("district"), "circles", "affected")


@query("checkpoint_verify", with_views("""SELECT district, parts, CASE WHEN parts <> expected THEN 'not_applicable' WHEN abs(summed - total) <= 1e-6 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT district, count(*) AS parts, sum(affected) AS summed FROM v_hierarchy GROUP BY 1)
 JOIN (SELECT district, sum(affected) + CASE WHEN district LIKE '%3' THEN 1 ELSE 0 END AS total, count(*) - CASE WHEN district LIKE '%7' THEN 1 ELSE 0 END AS expected FROM v_hierarchy GROUP BY 1) USING (district)""", "v_hierarchy"))
def checkpoint_verify(spark, d):
    h = _hier(spark, d)
    declared = h.groupBy("district").agg((F.sum("affected") + F.when(F.col("district").like("%3"), 1).otherwise(0)).alias("total"), (F.count("*") - F.when(F.col("district").like("%7"), 1).otherwise(0)).alias("expected"))
    return p.reconcile(h, declared, "district", "affected", "total", "expected")


@query("checkpoint_verify_all")
def checkpoint_verify_all(spark, d):
    """The same as checkpoint_verify, under its earlier name."""
    return checkpoint_verify(spark, d)


_LINES = "SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS parts, min(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1"


def _lines(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("parts"), F.min("l_quantity").alias("q"), F.count("*").alias("n"))


@query("component_checks", f"""SELECT o_orderkey, concat_ws(',', CASE WHEN NOT coalesce(parts <= CAST(o_totalprice AS DECIMAL(18, 2)), false) THEN 'sum' END, CASE WHEN NOT coalesce(q > 0, false) THEN 'non_negative' END, CASE WHEN NOT coalesce(n >= 2, false) THEN 'detail' END) AS failed
FROM orders LEFT JOIN ({_LINES}) ON l_orderkey = o_orderkey""")
def component_checks(spark, d):
    j = table(spark, d, "orders").join(_lines(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rules = {"sum": F.col("parts") <= F.col("o_totalprice").cast("decimal(18,2)"), "non_negative": F.col("q") > 0, "detail": F.col("n") >= 2}
    return p.failing_rules(j, rules).select("o_orderkey", "failed")


@query("count_reconcile", "SELECT o_orderpriority, count(*) AS declared, count(l_orderkey) AS with_detail, CASE WHEN count(*) = count(l_orderkey) THEN 'pass' ELSE 'warn' END AS verdict FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1")
def count_reconcile(spark, d):
    detail = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(1))
    g = table(spark, d, "orders").join(detail, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count("*").alias("declared"), F.count("has").alias("with_detail"))
    return g.withColumn("verdict", F.when(F.col("declared") == F.col("with_detail"), "pass").otherwise("warn"))


@query("impact_rank", with_views("SELECT district, circle, CAST(affected AS DOUBLE) AS affected, rank FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY affected DESC, circle) AS rank FROM v_hierarchy) WHERE rank <= 5", "v_hierarchy"))
def impact_rank(spark, d):
    return p.rank_within(_hier(spark, d), "district", "affected", "circle", 5).select("district", "circle", F.col("affected").cast("double").alias("affected"), "rank")


@query("class_breaks", with_views("SELECT district, CASE WHEN v IS NULL THEN -1 WHEN v = 0 THEN 0 WHEN v <= 500000 THEN 1 WHEN v <= 1500000 THEN 2 WHEN v <= 3000000 THEN 3 ELSE 4 END AS class, count(*) AS circles FROM (SELECT district, CASE WHEN circle % 9 = 0 THEN NULL WHEN circle % 9 = 1 THEN 0 ELSE affected END AS v FROM v_hierarchy) GROUP BY 1, 2", "v_hierarchy"))
def class_breaks(spark, d):
    v = F.when(F.col("circle") % 9 == 0, None).when(F.col("circle") % 9 == 1, 0).otherwise(F.col("affected"))
    return _hier(spark, d).withColumn("v", v).groupBy("district", p.class_break("v", (500_000, 1_500_000, 3_000_000)).alias("class")).agg(F.count("*").alias("circles"))


@query("derived_metric", with_views("SELECT circle, a + b AS metric FROM (SELECT circle, CASE WHEN circle % 5 <> 0 THEN circle * 2 END AS a, CASE WHEN circle % 7 <> 0 THEN circle END AS b FROM v_hierarchy)", "v_hierarchy"))
def derived_metric(spark, d):
    """Null if either side is null."""
    return _hier(spark, d).select("circle", (F.when(F.col("circle") % 5 != 0, F.col("circle") * 2) + F.when(F.col("circle") % 7 != 0, F.col("circle"))).alias("metric"))


@query("incident_attach", with_views("SELECT state, district, count(*) AS circles, CAST(sum(coalesce(n, 0)) AS BIGINT) AS incidents FROM v_hierarchy LEFT JOIN (SELECT o_custkey AS circle, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (circle) GROUP BY 1, 2", "v_hierarchy"))
def incident_attach(spark, d):
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("circle")).agg(F.count("*").alias("n"))
    return _hier(spark, d).join(n, "circle", "left").groupBy("state", "district").agg(F.count("*").alias("circles"), F.sum(F.coalesce("n", F.lit(0))).alias("incidents"))


@query("star_lookup", with_views("SELECT locality_id, revenue_circle, district, state FROM v_localities WHERE state <> 'EUROPE'", "v_localities"))
def star_lookup(spark, d):
    """Station to district to state, unresolved rows dropped; the dimensions are small files, which AQE broadcasts."""
    regions = table(spark, d, "region").where("r_name <> 'EUROPE'")
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left").where("r_name is not null")
    return j.select(F.col("s_suppkey").alias("locality_id"), F.col("s_name").alias("revenue_circle"), F.col("n_name").alias("district"), F.col("r_name").alias("state"))


@query("interval_relation", with_views("""SELECT event, relation, count(*) AS revisions, round(sum(hours), 4) AS hours FROM (SELECT event, CASE WHEN fetched_at <= t0 THEN 'before' WHEN report_date >= t1 THEN 'after' ELSE 'overlaps' END AS relation,
 CASE WHEN fetched_at <= t0 THEN date_diff('second', fetched_at, t0) / 3600.0 WHEN report_date >= t1 THEN date_diff('second', t1, report_date) / 3600.0 ELSE 0 END AS hours
 FROM v_revisions CROSS JOIN (VALUES ('a', TIMESTAMP '1996-03-01 00:00:00', TIMESTAMP '1996-09-01 00:00:00'), ('b', TIMESTAMP '1998-01-10 00:00:00', TIMESTAMP '1998-01-20 00:00:00')) AS e(event, t0, t1)) GROUP BY 1, 2""", "v_revisions"))
def interval_relation(spark, d):
    events = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'1996-03-01 00:00:00', TIMESTAMP_NTZ'1996-09-01 00:00:00'), ('b', TIMESTAMP_NTZ'1998-01-10 00:00:00', TIMESTAMP_NTZ'1998-01-20 00:00:00') AS e(event, t0, t1)")
    j = _rev(spark, d).crossJoin(F.broadcast(events))
    before, after = F.col("fetched_at") <= F.col("t0"), F.col("report_date") >= F.col("t1")
    hours = F.when(before, F.timestamp_diff("SECOND", F.col("fetched_at"), F.col("t0")) / 3600).when(after, F.timestamp_diff("SECOND", F.col("t1"), F.col("report_date")) / 3600).otherwise(0)
    return j.groupBy("event", F.when(before, "before").when(after, "after").otherwise("overlaps").alias("relation")).agg(F.count("*").alias("revisions"), F.round(F.sum(hours), 4).alias("hours"))


@query("horizon_tier", with_views("SELECT CASE WHEN lead > 30 OR lead < 0 THEN 'outside' WHEN lead <= 15 THEN 'medium' ELSE 'extended' END AS tier, count(*) AS revisions FROM (SELECT date_diff('day', report_date, fetched_at) AS lead FROM v_revisions) GROUP BY 1", "v_revisions"))
def horizon_tier(spark, d):
    lead = F.datediff("fetched_at", "report_date")
    return _rev(spark, d).groupBy(F.when((lead > 30) | (lead < 0), "outside").when(lead <= 15, "medium").otherwise("extended").alias("tier")).agg(F.count("*").alias("revisions"))


@query("flatten_csv", with_views("SELECT district, string_agg(CAST(circle AS VARCHAR), '|' ORDER BY circle) AS circles, count(*) AS n FROM v_hierarchy GROUP BY 1", "v_hierarchy"))
def flatten_csv(spark, d):
    g = _hier(spark, d).groupBy("district").agg(F.array_sort(F.collect_list("circle")).alias("c"), F.count("*").alias("n"))
    return g.select("district", F.array_join(F.transform("c", lambda x: x.cast("string")), "|").alias("circles"), "n")


@query("geojson_export")
def geojson_export(spark, d):
    """One closed ring per shape as a GeoJSON feature."""
    v = view(spark, d, "v_ring_vertices").groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("x", "y").alias("p")))).alias("v"))
    ring = F.concat(F.transform("v", lambda s: s["p"]), F.array(F.element_at("v", 1)["p"]))
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("shape_id").alias("properties"))
    return v.select("shape_id", F.to_json(shape).alias("feature"))


@query("serving_bundle", with_views("SELECT state AS s, count(*) AS n, CAST(max(affected) AS DOUBLE) AS m FROM v_hierarchy WHERE affected > 1000000 GROUP BY 1", "v_hierarchy"))
def serving_bundle(spark, d):
    """Filtered rows under short names."""
    return _hier(spark, d).where("affected > 1000000").groupBy(F.col("state").alias("s")).agg(F.count("*").alias("n"), F.max("affected").cast("double").alias("m"))
