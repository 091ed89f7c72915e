"""Domain views over the driver tables: gauge readings, stations, places, rainfall cells, reports, revisions.

One SQL text per view serves both engines. Views are built with spark.sql over DataFrame arguments, so filters and
column pruning reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clock of every event view: results never depend on the wall clock.
AS_OF = "2024-01-31 00:00:00"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_readings_raw": (("events",), """SELECT event_id, concat('G_', event_type) AS station_code, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS observed_at,
        CASE WHEN event_id % 5 = 0 THEN 'HZS' ELSE 'HHS' END AS datatype_code, value AS raw_value, CASE WHEN event_id % 3 = 0 THEN value + 0.5 END AS validated_value FROM {events}"""),
    "v_readings": (("events",), """SELECT concat('G_', event_type) AS gauge_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS observed_at, max(value) AS level_m FROM {events} GROUP BY 1, 2"""),
    "v_readings_sparse": (("events",), """SELECT concat('S_', CAST(user_id % 20 AS STRING)) AS gauge_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS observed_at, max(value) AS level_m FROM {events} GROUP BY 1, 2"""),
    "v_daily": (("lineitem",), """SELECT l_returnflag AS gauge_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP_NTZ) AS observed_at, sum(l_quantity) AS level_m FROM {lineitem} GROUP BY 1, 2"""),
    "v_stations": ((), """SELECT * FROM (VALUES ('G_click', 150.0D, 200.0D, 300.0D), ('G_error', 100.0D, 150.0D, 250.0D), ('G_purchase', 120.0D, 180.0D, 400.0D),
        ('G_signup', NULL, 160.0D, 280.0D), ('G_view', 90.0D, NULL, NULL), ('G_silent', 50.0D, 60.0D, 70.0D)) AS t(gauge_id, warning_level_m, danger_level_m, highest_flood_level_m)"""),
    "v_localities": (("supplier", "nation", "region"), """SELECT s_suppkey AS locality_id, s_name AS revenue_circle, n_nationkey AS district_id, n_name AS district, r_name AS state,
        CAST(89.5 + ((s_suppkey * 37) % 700) / 100.0 AS DOUBLE) AS lon, CAST(24.2 + ((s_suppkey * 53) % 480) / 100.0 AS DOUBLE) AS lat
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""),
    "v_points": (("customer",), """SELECT c_custkey AS point_id, c_nationkey AS owner_id, CAST(89.5 + ((c_custkey * 41) % 700) / 100.0 + 0.0013 AS DOUBLE) AS lon,
        CAST(24.2 + ((c_custkey * 59) % 480) / 100.0 + 0.0017 AS DOUBLE) AS lat FROM {customer}"""),
    "v_ring_vertices": (("nation",), """SELECT n_nationkey AS shape_id, k AS seq, CAST(90.0 + (n_nationkey % 5) * 1.3 + dx AS DOUBLE) AS x, CAST(24.5 + floor(n_nationkey / 5) * 0.9 + dy AS DOUBLE) AS y
        FROM {nation} CROSS JOIN (VALUES (0, 0.0D, 0.0D), (1, 1.35D, 0.1D), (2, 1.2D, 0.5D), (3, 1.3D, 0.95D), (4, 0.6D, 0.7D), (5, 0.05D, 0.9D)) AS o(k, dx, dy)"""),
    "v_reviewed_rings": (("nation",), """SELECT shape_id, k AS seq, CAST(90.0 + (n % 5) * 1.3 + dx AS DOUBLE) AS x, CAST(24.5 + floor(n / 5) * 0.9 + dy AS DOUBLE) AS y
        FROM (SELECT n_nationkey AS n, n_nationkey + copy AS shape_id, copy FROM {nation} CROSS JOIN (VALUES (0), (100)) AS c(copy) WHERE copy = 0 OR n_nationkey % 5 = 0)
        CROSS JOIN (VALUES (0, 0, 0.0D, 0.0D), (0, 1, 1.35D, 0.1D), (0, 2, 1.2D, 0.5D), (0, 3, 1.3D, 0.95D), (0, 4, 0.6D, 0.7D), (0, 5, 0.05D, 0.9D),
            (100, 3, 0.0D, 0.0D), (100, 2, 1.35D, 0.1D), (100, 1, 1.2D, 0.5D), (100, 0, 1.3D, 0.95D), (100, 5, 0.6D, 0.7D), (100, 4, 0.05D, 0.9D)) AS o(c, k, dx, dy) WHERE c = copy"""),
    "v_review_points": (("customer",), """SELECT c_custkey AS point_id, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey ELSE 1000 + c_custkey % 20 END AS owner_id,
        CAST(CASE WHEN c_custkey % 3 <> 0 THEN 90.1 + (c_nationkey % 5) * 1.3 + (c_custkey % 13) * 0.08 ELSE 89.6 + (c_custkey % 20 * 37) % 70 / 10.0 + (c_custkey % 7) * 0.01 END + 0.0013 AS DOUBLE) AS lon,
        CAST(CASE WHEN c_custkey % 3 <> 0 THEN 24.6 + floor(c_nationkey / 5) * 0.9 + (c_custkey % 7) * 0.09 ELSE 24.3 + (c_custkey % 20 * 53) % 47 / 10.0 + (c_custkey % 11) * 0.01 END + 0.0017 AS DOUBLE) AS lat FROM {customer}"""),
    "v_outlines": (("customer",), """SELECT c_custkey AS shape_id, CASE WHEN c_custkey % 2 = 0 THEN (k + floor(c_custkey / 500)) % 6 ELSE 5 - (k + floor(c_custkey / 500)) % 6 END AS seq,
        CAST(89.5 + c_custkey % 500 * 0.013 + dx AS DOUBLE) AS x, CAST(24.2 + c_custkey % 500 * 0.007 + dy * CASE WHEN c_custkey % 17 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS y
        FROM {customer} CROSS JOIN (VALUES (0, 0.0D, 0.0D), (1, 0.135D, 0.01D), (2, 0.12D, 0.05D), (3, 0.13D, 0.095D), (4, 0.06D, 0.07D), (5, 0.005D, 0.09D)) AS o(k, dx, dy)"""),
    "v_grid_obs": (("events",), """SELECT concat('C', CAST(user_id % 4 AS STRING)) AS cell_id,
        CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) + (CASE WHEN minute(ts) >= 30 THEN INTERVAL '30' MINUTE ELSE INTERVAL '0' MINUTE END) AS interval_start,
        CAST(max(value) AS DECIMAL(18, 6)) AS rate_mm_h FROM {events} GROUP BY 1, 2"""),
    "v_zone_weights": ((), """SELECT * FROM (VALUES ('Z1', 'C0', 0.25D), ('Z1', 'C1', 0.75D), ('Z2', 'C2', 1.0D), ('Z3', 'C1', 0.5D), ('Z3', 'C3', 0.5D)) AS t(zone_id, cell_id, share)"""),
    "v_reports": (("events",), """SELECT event_id AS report_id, ts AS submitted_at, user_id % 12 AS locality_id,
        CASE event_type WHEN 'view' THEN 'dry' WHEN 'error' THEN 'dry' WHEN 'click' THEN 'ankle' WHEN 'signup' THEN 'knee' ELSE 'waist_plus' END AS depth_class,
        CAST(90.0 + (user_id % 12) / 1000.0 AS DOUBLE) AS lon, CAST(26.0 + (user_id % 12) / 1000.0 AS DOUBLE) AS lat, user_id AS device_id FROM {events}"""),
    "v_revisions": (("orders",), """SELECT o_orderkey AS revision_id, o_custkey AS entity_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS report_date, o_orderdate AS fetched_at,
        CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'P' THEN 'validated_partial' ELSE 'quarantined' END AS publication_state, o_totalprice AS metric FROM {orders}"""),
    "v_hierarchy": (("orders", "customer", "nation", "region"), """SELECT r_name AS state, n_name AS district, c_custkey AS circle, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(20, 2)) AS affected
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"""),
    "v_deliveries": (("events",), "SELECT user_id AS subject_id, event_id AS delivery_id, ts, event_type FROM {events}"),
    "v_bulletins": (("orders",), """SELECT o_orderkey AS k, o_custkey AS stream, CAST(o_orderdate AS DATE) AS day, concat('r', CAST(o_orderkey AS STRING)) AS revision_id,
        concat('r', CAST(o_orderkey AS STRING), '-extractor-v', CASE WHEN o_orderkey % 41 = 0 THEN '2' ELSE '3' END) AS artifact_id,
        concat(CAST(CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 59 = 0 THEN 2 ELSE 0 END AS STRING), 'T20:00:00Z') AS fetched_at, CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS more_people,
        CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS more_stock, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS more_bridges, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS warned,
        CASE WHEN o_orderkey % 43 = 0 THEN 1 ELSE 0 END AS more_roads, CASE WHEN o_orderkey % 47 = 0 THEN 0 ELSE 1 END AS page, o_orderkey % 37 <> 0 AS with_villages FROM {orders}"""),
    "v_bulletin_districts": (("lineitem",), """SELECT l_orderkey AS k, concat('D', CAST(l_linenumber AS STRING)) AS district, sum(l_quantity) AS people, CASE WHEN l_orderkey % 31 = 0 THEN -1.0D ELSE 1.0D END AS dead
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""),
    "v_bulletin_records": (("lineitem",), """SELECT l_orderkey AS k, l_partkey AS part, CASE l_partkey % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'bridge' WHEN 2 THEN 'embankment_breached' ELSE 'embankment_affected' END AS incident_type,
        CASE WHEN l_suppkey % 2 = 0 THEN 'valid' ELSE 'absent' END AS coordinate_validation, 89.5D + l_partkey % 800 / 100.0D AS longitude, CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 50 <> 0 THEN 'coordinates' ELSE 'district' END AS match_scope,
        CASE WHEN l_partkey % 200 = 1 THEN 0 ELSE 1 END AS page FROM {lineitem}"""),
    "v_granules": (("events",), """SELECT run, concat('g', CAST(day AS STRING)) AS granule, CAST(day AS TIMESTAMP_NTZ) + INTERVAL '1' DAY + copy * INTERVAL '6' HOUR AS fetched_at, part, cell_id, interval_start, CAST(rate + CASE WHEN copy = 1 AND user = 3 AND dayofmonth(day) % 4 = 1 THEN 1 ELSE 0 END AS DECIMAL(18, 6)) AS rate_mm_h
        FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'early' ELSE 'late' END AS run, CAST(ts AS DATE) AS day, user_id % 6 AS user, concat('C', CAST(user_id % 6 AS STRING)) AS cell_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS interval_start, max(value) AS rate FROM {events} GROUP BY 1, 2, 3, 4, 5)
        CROSS JOIN (VALUES (0, 0), (1, 1)) AS c(copy, part) WHERE copy = 0 OR dayofmonth(day) % 2 = 1"""),
    "v_share": (("customer",), """SELECT c_custkey AS zone_id, concat('c', CAST(k AS STRING)) AS cell_id, CAST(share AS DECIMAL(13, 12)) AS share FROM {customer} CROSS JOIN (VALUES (0, 0.2), (1, 0.3), (2, 0.5)) AS w(k, share)"""),
    "v_given": (("customer",), """SELECT c_custkey AS zone_id, concat('c', CAST(k AS STRING)) AS cell_id, TIMESTAMP_NTZ '2024-01-30 00:00:00' + (t + CASE WHEN c_custkey % 13 = 6 AND k = 0 AND t = 2 THEN -1 WHEN c_custkey % 13 = 7 AND k = 2 THEN 1 ELSE 0 END) * INTERVAL '30' MINUTE AS interval_start,
        CAST((c_custkey * 7 + k * 3 + t) % 50 / 10.0 AS DECIMAL(18, 6)) AS rate_mm_h, CASE WHEN c_custkey % 13 = 3 AND k = 1 OR c_custkey % 13 = 4 AND k = 0 AND t = 2 THEN 'early' ELSE 'late' END AS run
        FROM {customer} CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(k) CROSS JOIN (VALUES (0), (1), (2), (3)) AS h(t)
        WHERE (k < 3 OR c_custkey % 13 = 2) AND NOT (c_custkey % 13 = 1 AND k = 2) AND NOT (c_custkey % 13 = 5 AND k = 0 AND t = 1) AND c_custkey % 13 <> 8"""),
    "v_landed": (("pages",), """SELECT page_id, page_id % 50 AS site, concat('https://s', CAST(page_id % 50 AS STRING), '.example.org/a/', CAST(page_id AS STRING), CASE WHEN page_id % 3 = 0 THEN '/?q=1' ELSE '' END) AS url,
        concat(replace(html, 'href="/', CASE page_id % 8 WHEN 0 THEN 'href="../' WHEN 1 THEN 'href="./x/../y/' WHEN 2 THEN 'href="//docs.example.net/' WHEN 3 THEN 'href="?p=' WHEN 4 THEN 'href="https://m.example.org/a/./' WHEN 5 THEN 'href="mailto:' WHEN 6 THEN 'href="#' ELSE 'href="/../b/./' END),
        CASE WHEN page_id % 4 = 0 THEN '<a class="d" href="../files/plan.pdf?v=2">Relief  <b>camps</b> &amp; more</a>' WHEN page_id % 4 = 1 THEN concat('<a href="/a/', CAST(page_id + 2 AS STRING), '#top">DDMP</a>') WHEN page_id % 4 = 3 THEN '<a href="annex.pdf">Annex</a>' ELSE '' END) AS html FROM {pages}"""),
    "v_links": (("pages",), "SELECT page_id, url, html FROM {pages}"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **read: DataFrame) -> DataFrame:
    """The view over the driver tables; read: tables that the caller has already."""
    tables, sql = VIEWS[name]
    return spark.sql(sql, **{t: read[t] if t in read else table(spark, sf_dir, t) for t in tables}) if tables else spark.sql(sql)


def with_views(body: str, *names: str) -> str:
    """The SQL twin: the views as CTEs of the same names, then body."""

    def plain(sql: str) -> str:
        import re

        sql = re.sub(r"\{(\w+)\}", r"\1", sql).replace("AS STRING)", "AS VARCHAR)").replace("TIMESTAMP_NTZ", "TIMESTAMP")
        return re.sub(r"(\d)D\b", r"\1::DOUBLE", sql)

    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n][1])})" for n in names)
    lead, rest = ("WITH ", body) if not body.lstrip().upper().startswith("WITH ") else ("WITH ", ", " + body.lstrip()[5:])
    return f"{lead}{ctes}\n{rest}"
