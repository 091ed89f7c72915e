"""Queries on nested payloads: personal data, contracts, the checks of bulletins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from freshet.operators import checks, privacy
from freshet.plans.bindings import table, view, with_views
from freshet.plans.registry import query
from freshet.shared import spread
from freshet.sources import contracts as c

_LEAF = r"""SELECT doc_id AS id, fullkey AS path, type, atom, atom ->> '$' AS leaf, lon, lat, regexp_extract(fullkey, '\.([a-z_]+)(\[[0-9]+\])*$', 1) AS name, regexp_matches(fullkey, '\.[a-z_]+$') AS named FROM p, json_tree(p.body) WHERE type <> 'NULL'"""


@query("pii_paths", f"""WITH b AS (SELECT doc_id, text, 90 + (doc_id % 700) / 100.0::DOUBLE + 0.00123::DOUBLE AS lon, 24 + (doc_id % 480) / 100.0::DOUBLE + 0.00217::DOUBLE AS lat FROM documents),
p AS (SELECT doc_id, lon, lat, to_json(struct_pack(report_id := sha256(CAST(doc_id AS VARCHAR)), "where" := [CASE WHEN doc_id % 30 = 0 THEN lon ELSE round(lon, 2) END, round(lat, 2)],
 device_id := CASE WHEN doc_id % 50 = 0 THEN doc_id END, contact := CASE WHEN doc_id % 20 = 1 THEN struct_pack(kind := 'sms', said := '+91 ' || CAST(9000000000 + doc_id * 7919 % 900000000 AS VARCHAR)) END,
 notes := list_transform(string_split(text, chr(10)), lambda x: struct_pack(said := x)))) AS body FROM b),
t AS ({_LEAF})
SELECT DISTINCT id, path, kind FROM (SELECT id, path, 'field' AS kind FROM t WHERE named AND name = 'device_id'
 UNION ALL SELECT id, path, 'email' FROM t WHERE type = 'VARCHAR' AND name <> 'report_id' AND regexp_matches(leaf, '{privacy.EMAIL}')
 UNION ALL SELECT id, path, 'phone' FROM t WHERE type = 'VARCHAR' AND name <> 'report_id' AND regexp_matches(leaf, '{privacy.PHONE}')
 UNION ALL SELECT id, path, 'banned' FROM t WHERE type IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND (CAST(leaf AS DOUBLE) = lon OR CAST(leaf AS DOUBLE) = lat))""")
def pii_paths(spark, d):
    """Documents as nested crowd reports, their lines as notes; the exact position is banned, a rounded one is not."""
    k = F.col("doc_id")
    near = lambda base, n, off: F.lit(base) + (k % n) / F.lit(100.0) + F.lit(off)
    docs = table(spark, d, "documents").select("doc_id", "text", near(90, 700, 0.00123).alias("lon"), near(24, 480, 0.00217).alias("lat"))
    phone = F.concat(F.lit("+91 "), (F.lit(9000000000) + k * 7919 % 900000000).cast("string"))
    body = F.struct(
        F.sha2(k.cast("string"), 256).alias("report_id"), F.array(F.when(k % 30 == 0, F.col("lon")).otherwise(F.round("lon", 2)), F.round("lat", 2)).alias("where"),
        F.when(k % 50 == 0, k).alias("device_id"), F.when(k % 20 == 1, F.struct(F.lit("sms").alias("kind"), phone.alias("said"))).alias("contact"),
        F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("said"))).alias("notes"),
    )
    payloads = docs.select("doc_id", F.to_json(body).alias("body"), "lon", "lat")
    return privacy.findings(payloads, "doc_id", "body", F.array(F.col("lon").cast("string"), F.col("lat").cast("string")), levels=4)


_OBS = """o AS (SELECT event_id, event_id // 20 AS payload, row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) - 1 AS i, CASE WHEN event_id % 101 <> 0 THEN 'C' || CAST(user_id % 4 AS VARCHAR) END AS cell,
 89 + user_id % 100 * 1.0::DOUBLE AS lon, CASE WHEN event_id % 97 = 0 THEN -value WHEN event_id % 89 <> 0 THEN value END AS rate, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t0, CASE WHEN event_id % 83 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') END AS t1 FROM events),
f AS (SELECT payload, '$.observations[' || CAST(i AS VARCHAR) || ']' AS spot, o.* EXCLUDE (payload) FROM o), h AS (SELECT DISTINCT payload FROM o),
b AS (SELECT payload, '$.units' AS path, 'not as pinned' AS reason FROM h WHERE payload % 17 = 0 UNION ALL SELECT payload, '$.product_version', 'not as pinned' FROM h WHERE payload % 23 = 0 UNION ALL SELECT payload, '$.product_short_name', 'not that of run' FROM h WHERE payload % 29 = 0
 UNION ALL SELECT payload, spot || '.grid_cell_id', 'missing' FROM f WHERE cell IS NULL UNION ALL SELECT payload, spot || '.longitude', 'out of range' FROM f WHERE NOT lon BETWEEN -180 AND 180
 UNION ALL SELECT payload, spot || '.precipitation_rate', 'not a number' FROM f WHERE rate IS NULL UNION ALL SELECT payload, spot || '.precipitation_rate', 'out of range' FROM f WHERE rate < 0
 UNION ALL SELECT payload, spot || '.interval_end', 'not after its start' FROM f WHERE t0 >= t1)"""


def _granules(spark, d):
    """Rain payloads of twenty events each, some with a wrong head, some with wrong rows."""
    e, k, n = table(spark, d, "events"), F.col("payload"), F.col("event_id")
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    obs = F.struct(
        "event_id", F.when(n % 101 != 0, F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string"))).alias("grid_cell_id"), (F.lit(89.0) + F.col("user_id") % 100).alias("longitude"), F.lit(26.0).alias("latitude"),
        F.when(n % 97 == 0, -F.col("value")).when(n % 89 != 0, F.col("value")).alias("precipitation_rate"), stamp(F.col("ts")).alias("interval_start"),
        F.when(n % 83 == 0, stamp(F.col("ts"))).otherwise(stamp(F.col("ts") + F.expr("interval 30 minutes"))).alias("interval_end"),
    )
    g = e.groupBy(F.floor(n / 20).alias("payload")).agg(F.array_sort(F.collect_list(obs)).alias("observations"))
    short = F.when(k % 29 == 0, "other").when(k % 2 == 0, "GPM_3IMERGHHE.07").otherwise("GPM_3IMERGHHL.07")
    body = F.struct(
        F.when(k % 17 == 0, "mm").otherwise("mm/hour").alias("units"), F.when(k % 23 == 0, "06").otherwise("07").alias("product_version"),
        F.when(k % 2 == 0, "early").otherwise("late").alias("run"), short.alias("product_short_name"), "observations",
    )
    return spread(g.select("payload", F.to_json(body).alias("body")))


@query("contract_breaches", f"WITH {_OBS} SELECT payload, path, reason FROM b")
def contract_breaches(spark, d):
    judged = c.judge(_granules(spark, d), "body", c.RAIN_GRID)
    return judged.select("payload", F.explode("breaches").alias("b")).select("payload", "b.path", "b.reason")


@query("contract_rows", f"WITH {_OBS} SELECT payload, cell AS grid_cell_id, lon AS longitude, rate AS precipitation_rate, t0 AS interval_start FROM o WHERE payload NOT IN (SELECT payload FROM b)")
def contract_rows(spark, d):
    """Rows of payloads that keep the contract; one breach refuses all rows of its payload."""
    judged = c.judge(_granules(spark, d), "body", c.RAIN_GRID)
    r = c.rows(judged, "body", c.RAIN_GRID, ("payload",))
    return r.select("payload", "grid_cell_id", "longitude", "precipitation_rate", F.date_format("interval_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("interval_start"))


@query("forecast_contract", """WITH v AS (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS due, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_linenumber END, l_shipdate) AS i FROM lineitem),
w AS (SELECT k, due, lag(due) OVER (PARTITION BY k ORDER BY i) AS before FROM v), o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS issued FROM orders),
b AS (SELECT k, 'no values' AS reason FROM o WHERE k NOT IN (SELECT k FROM v) UNION ALL SELECT k, 'outside the horizon' FROM o JOIN w USING (k) WHERE due < issued OR due > issued + 400
 UNION ALL SELECT DISTINCT k, 'not in order of time' FROM o JOIN w USING (k) WHERE due < before UNION ALL SELECT k, 'not a number' FROM o JOIN w USING (k) WHERE k % 11 = 0)
SELECT k AS payload, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM o LEFT JOIN b USING (k) GROUP BY 1, 2""")
def forecast_contract(spark, d):
    """Orders as forecasts, shipping dates as their values; the horizon is 400 days here."""
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T00:00:00Z'")
    k = F.col("l_orderkey")
    line = F.struct(F.when(k % 2 == 0, 0).otherwise(F.col("l_linenumber")).alias("place"), stamp("l_shipdate").alias("valid_at"), F.when(k % 11 != 0, F.col("l_quantity")).alias("discharge_m3_per_second"))
    values = table(spark, d, "lineitem").groupBy(k.alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("values"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(values, "o_orderkey", "left")
    point = F.struct(F.lit("g").alias("grid_cell_id"), F.array(F.lit(91.0), F.lit(26.5)).alias("coordinates"), F.coalesce("values", F.array().cast(values.schema["values"].dataType)).alias("values"))
    body = F.struct(
        F.lit("cems-glofas-forecast").alias("dataset"), F.lit("4.5").alias("system_version"), F.lit(30).alias("forecast_horizon_days"), F.lit("m3/s").alias("units"),
        F.lit("ensemble_mean").alias("ensemble_statistic"), stamp("o_orderdate").alias("issued_at"), F.array(point).alias("grid_points"),
    )
    payloads = spread(orders.select(F.col("o_orderkey").alias("payload"), F.to_json(body).alias("body")))
    judged = c.judge(payloads, "body", replace(c.DISCHARGE_FORECAST, horizon_days=400))
    found = judged.select("payload", F.explode(F.when(F.col("accepted"), F.array(F.lit("accepted"))).otherwise(F.col("breaches.reason"))).alias("reason"))
    return found.groupBy("payload", "reason").agg(F.count("*").alias("n"))


#: The clock of the bulletins' checks, and how many days they stay fresh.
NOW, FRESH = "2002-01-01T00:00:00+05:30", 1200
_BULLETINS = ("v_bulletins", "v_bulletin_districts", "v_bulletin_records")


def _bulletins(spark, d):
    """Orders as bulletins in JSON: lines as districts and as records of damage, with breaches of every kind of check."""
    b, dist, rec = (view(spark, d, n) for n in _BULLETINS)
    field = lambda x: F.struct(x["district"].alias("district"), *[{"affected_population": x["people"], "confirmed_deaths": x["dead"]}.get(f, F.lit(1.0)).alias(f) for f in checks.CORE_FIELDS[1:]])
    dist = dist.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("district", "people", "dead"))).alias("ds"))
    rec = rec.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "incident_type", "coordinate_validation", "longitude", "match_scope", "page"))).alias("rs"))
    j = b.join(dist, "k", "left").join(rec, "k", "left")
    j = j.withColumns({n: F.coalesce(n, F.array().cast(j.schema[n].dataType)) for n in ("ds", "rs")}).withColumn("report_date", F.col("day").cast("string"))
    refs = lambda page: F.array(F.struct(F.col("revision_id").alias("source_revision_sha256"), "report_date", F.lit(3).alias("extractor_version"), page.alias("page"), F.lit(1).alias("table"), F.lit(1).alias("row")))
    n = F.size("ds").cast("double")
    add = lambda f: F.aggregate("ds", F.lit(0.0), lambda a, x: a + x[f])
    core = {"affected_population": add("people") + F.col("more_people"), "confirmed_deaths": add("dead"), "affected_villages": F.when(F.col("with_villages"), n)}
    actual = {t: F.size(F.filter("rs", lambda x: x["incident_type"] == t)) for t in checks.INFRASTRUCTURE_TYPES}
    plus = lambda **more: F.struct(*[(c + F.col(more[t]) if t in more else c).alias(t) for t, c in actual.items()])
    nothing = F.create_map().cast("map<string,double>")
    summary = F.struct(
        *[core.get(f, n).alias(f) for f in checks.CORE_FIELDS], F.struct(n.alias("big_animals"), n.alias("poultry"), (2 * n + F.col("more_stock")).alias("total")).alias("livestock_affected"),
        *[nothing.alias(f) for f in checks.BREAKDOWN_FIELDS[1:]], plus(bridge="more_bridges").alias("infrastructure_incidents"), plus(road="more_roads").alias("infrastructure_records_extracted"),
    )
    warning = F.struct(F.lit(checks.COUNT_MISMATCH).alias("code"), F.lit("bridge").alias("incident_type"), (actual["bridge"] + F.col("more_bridges")).alias("reported_count"), actual["bridge"].alias("extracted_record_count"))
    records = F.transform("rs", lambda x: F.struct(x["incident_type"].alias("incident_type"), x["coordinate_validation"].alias("coordinate_validation"), x["longitude"].alias("longitude"), F.lit(26.0).alias("latitude"), x["match_scope"].alias("match_scope"), refs(x["page"]).alias("provenance")))
    body = F.struct(
        "revision_id", "artifact_id", F.lit(3).alias("extractor_version"), "report_date", F.struct(F.col("revision_id").alias("sha256"), "fetched_at").alias("source"),
        F.transform("ds", lambda x: x["district"]).alias("affected_district_names"), summary.alias("summary"), F.transform("ds", field).alias("districts"), records.alias("infrastructure"),
        F.array().cast("array<string>").alias("relief_material_notes"), F.struct(refs(F.col("page")).alias("summary")).alias("field_provenance"), F.filter(F.array(warning), lambda _: F.col("warned") == 1).alias("extraction_warnings"),
    )
    return spread(j.select("k", "stream", "day", "revision_id", "fetched_at", F.to_json(body).alias("body")))


_CHECKS = """g AS (SELECT k, count(*) AS n, sum(people) AS people, sum(dead) AS dead, count(*) FILTER (dead < 0) AS below FROM v_bulletin_districts GROUP BY 1),
i AS (SELECT k, count(*) FILTER (incident_type = 'bridge') AS bridges, count(*) FILTER (page < 1) AS unsourced, count(*) FILTER (coordinate_validation = 'valid' AND match_scope <> 'coordinates') AS lost FROM v_bulletin_records GROUP BY 1),
a AS (SELECT b.*, coalesce(n, 0) AS n, coalesce(people, 0) AS people, coalesce(dead, 0) AS dead, coalesce(below, 0) AS below, coalesce(unsourced, 0) AS unsourced, coalesce(lost, 0) AS lost FROM v_bulletins b LEFT JOIN g USING (k) LEFT JOIN i USING (k)),
c AS (SELECT k, 'bulletin_schema' AS "check", 0 AS bad FROM a UNION ALL SELECT k, 'source_identity', CASE WHEN artifact_id <> revision_id || '-extractor-v3' THEN 3 ELSE 0 END FROM a
 UNION ALL SELECT k, 'required_impact_fields', CASE WHEN with_villages THEN 0 ELSE 1 END FROM a UNION ALL SELECT k, 'non_negative_metrics', below + CASE WHEN dead < 0 THEN 1 ELSE 0 END FROM a
 UNION ALL SELECT k, 'component_arithmetic', CASE WHEN n + n <> 2 * n + more_stock THEN 1 ELSE 0 END FROM a UNION ALL SELECT k, 'district_arithmetic', CASE WHEN n > 0 AND people <> people + more_people THEN 1 ELSE 0 END FROM a
 UNION ALL SELECT k, 'field_provenance', CASE WHEN page < 1 THEN 1 ELSE 0 END + unsourced FROM a UNION ALL SELECT k, 'temporal_contract', CASE WHEN day > DATE '2002-01-01' OR CAST(CAST(replace(left(fetched_at, 19), 'T', ' ') AS TIMESTAMP) + INTERVAL 330 MINUTE AS DATE) < day THEN 2 ELSE 0 END FROM a
 UNION ALL SELECT k, 'infrastructure_record_count', more_roads FROM a UNION ALL SELECT k, 'infrastructure_source_reconciliation', more_bridges FROM a UNION ALL SELECT k, 'coordinate_scope', lost FROM a),
l AS (SELECT k, "check", CASE WHEN bad = 0 THEN 'pass' WHEN "check" = 'infrastructure_source_reconciliation' AND warned = 1 THEN 'warn' ELSE 'fail' END AS status, CAST(bad AS INTEGER) AS n_paths FROM c JOIN v_bulletins USING (k))"""


@query("bulletin_checks", with_views(f'WITH {_CHECKS} SELECT k, "check", status, n_paths FROM l', *_BULLETINS))
def bulletin_checks(spark, d):
    checked = checks.suite(checks.read(_bulletins(spark, d), "body"), NOW)
    return checks.long(checked, "k").select("k", "check", "status", F.size("paths").alias("n_paths"))


@query("bulletin_states", with_views(f"""WITH {_CHECKS},
f AS (SELECT k, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'warn') AS warned, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (status = 'fail'), '') AS failures FROM l GROUP BY 1),
p AS (SELECT stream, arg_max(day, (day, k)) AS cday, arg_max(k, (day, k)) AS ck, arg_max(fetched_at, (day, k)) AS cf FROM v_bulletins WHERE k % 2 = 0 GROUP BY 1)
SELECT k, CASE WHEN failed > 0 THEN 'quarantined' WHEN day < cday THEN 'historical' WHEN day = cday AND k <> ck AND fetched_at <= cf THEN 'superseded' WHEN date_diff('day', day, DATE '2002-01-01') > {FRESH} THEN 'historical' WHEN f.warned > 0 THEN 'validated_partial' ELSE 'validated' END AS state,
 CASE WHEN failed > 0 THEN 'none' WHEN f.warned > 0 THEN '{checks.COUNT_PROFILE}' ELSE 'impact-v1' END AS profile, CASE WHEN failed > 0 THEN 0 WHEN f.warned > 0 THEN 7 ELSE 6 END AS n_allowed, failures FROM v_bulletins JOIN f USING (k) LEFT JOIN p USING (stream)""", *_BULLETINS))
def bulletin_states(spark, d):
    """Each bulletin against the current one of its stream: here the newest with an even number."""
    newest = F.max(F.struct("day", "k", "revision_id", "fetched_at"))
    current = view(spark, d, "v_bulletins").where("k % 2 = 0").groupBy("stream").agg(newest.alias("m"))
    current = current.select("stream", F.struct(F.col("m.day").alias("report_date"), "m.revision_id", F.col("m.fetched_at").cast("timestamp").alias("fetched_at")).alias("current"))
    checked = checks.suite(checks.read(_bulletins(spark, d).join(current, "stream", "left"), "body"), NOW)
    s = checks.state(checked, NOW, FRESH)
    return s.select("k", "state", "profile", F.size("allowed_fields").alias("n_allowed"), F.array_join(F.array_sort("failures"), ",").alias("failures"))
