"""Queries on crowd reports, deliveries and payload contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import text as t
from freshet.operators import links
from freshet.operators import reports as r
from freshet.plans.bindings import AS_OF, table, view, with_views
from freshet.plans.registry import query


def _rep(spark, d):
    return view(spark, d, "v_reports")


def _now(at=AS_OF):
    return F.lit(at).cast("timestamp_ntz")


@query("quorum_counts", with_views(f"SELECT locality_id, depth_class, n AS reports, n >= 2 AS published FROM (SELECT locality_id, depth_class, count(*) AS n FROM v_reports WHERE submitted_at > TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR GROUP BY 1, 2)", "v_reports"))
def quorum_counts(spark, d):
    return r.quorum(_rep(spark, d), _now() - F.expr("interval 6 hours"))


_PAIRS = "SELECT a.report_id AS a, b.report_id AS b FROM v_reports a JOIN v_reports b ON round_even(a.lon, 3) = round_even(b.lon, 3) AND round_even(a.lat, 3) = round_even(b.lat, 3) AND a.depth_class = 'dry' AND b.depth_class <> 'dry' AND abs(epoch_us(a.submitted_at) - epoch_us(b.submitted_at)) <= 1800000000"


@query("contradiction_join", with_views(f"SELECT locality_id, count(*) AS reports, count(*) FILTER (report_id IN (SELECT a FROM ({_PAIRS}) UNION ALL SELECT b FROM ({_PAIRS}))) AS contradicted FROM v_reports GROUP BY 1", "v_reports"))
def contradiction_join(spark, d):
    return r.flagged(_rep(spark, d)).groupBy("locality_id").agg(F.count("*").alias("reports"), F.count_if("contradicted").alias("contradicted"))


@query("decay_visibility", with_views("SELECT report_id, round(greatest(0.0, least(1.0, 1 - age / 6)), 6) AS confidence, age <= 12 AS visible FROM (SELECT report_id, ((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(submitted_at)) // 1000000) / 3600.0 AS age FROM v_reports WHERE submitted_at <= TIMESTAMP '2024-01-20 00:00:00' AND submitted_at > TIMESTAMP '2024-01-18 00:00:00')", "v_reports"))
def decay_visibility(spark, d):
    at = "2024-01-20 00:00:00"
    age = F.timestamp_diff("SECOND", F.col("submitted_at"), _now(at)) / 3600
    some = _rep(spark, d).where((F.col("submitted_at") <= _now(at)) & (F.col("submitted_at") > _now("2024-01-18 00:00:00")))
    return some.select("report_id", F.round(r.decay(age), 6).alias("confidence"), (age <= 12).alias("visible"))


@query("reconcile_public", with_views("SELECT count(*) AS reports, count(DISTINCT locality_id) AS localities, count(DISTINCT device_id) AS devices, count(*) FILTER (depth_class = 'dry') AS dry, count(*) FILTER (depth_class = 'waist_plus') AS deep FROM v_reports", "v_reports"))
def reconcile_public(spark, d):
    return _rep(spark, d).agg(
        F.count("*").alias("reports"), F.count_distinct("locality_id").alias("localities"), F.count_distinct("device_id").alias("devices"),
        F.count_if(F.col("depth_class") == "dry").alias("dry"), F.count_if(F.col("depth_class") == "waist_plus").alias("deep"),
    )


@query("coarsen_coords", with_views("SELECT round_even(lon + 0.0003, 3) AS lon, round_even(lat + 0.0003, 3) AS lat, count(*) AS reports FROM v_reports GROUP BY 1, 2", "v_reports"))
def coarsen_coords(spark, d):
    return _rep(spark, d).groupBy(r.coarse(F.col("lon") + 0.0003).alias("lon"), r.coarse(F.col("lat") + 0.0003).alias("lat")).agg(F.count("*").alias("reports"))


@query("salted_hash", with_views("SELECT device_id, m AS month, sha256('pepper' || chr(0) || CAST(device_id AS VARCHAR) || chr(0) || m) AS device_hash, count(*) AS reports FROM (SELECT device_id, strftime(submitted_at, '%Y-%m') AS m FROM v_reports) GROUP BY 1, 2, 3", "v_reports"))
def salted_hash(spark, d):
    g = _rep(spark, d).groupBy("device_id", F.date_format("submitted_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("reports"))
    return g.select("device_id", "month", t.salted(F.col("device_id").cast("string"), "pepper", F.col("month")).alias("device_hash"), "reports")


@query("closed_vocab", with_views("SELECT depth_class, CASE WHEN depth_class IN ('dry', 'ankle', 'knee') THEN 'accepted' ELSE 'quarantined' END AS route, count(*) AS reports FROM v_reports GROUP BY 1, 2", "v_reports"))
def closed_vocab(spark, d):
    """An unknown word is quarantined, never guessed."""
    route = F.when(F.col("depth_class").isin("dry", "ankle", "knee"), "accepted").otherwise("quarantined")
    return _rep(spark, d).groupBy("depth_class", route.alias("route")).agg(F.count("*").alias("reports"))


@query("validate_submission", with_views("""SELECT reasons, count(*) AS rows FROM (SELECT concat_ws(',', CASE WHEN lo IS NULL OR lat IS NULL THEN 'no_place' END, CASE WHEN NOT (lo BETWEEN 89 AND 97 AND lat BETWEEN 23 AND 29) THEN 'outside' END,
 CASE WHEN NOT coalesce(dc IN ('dry', 'ankle', 'knee', 'waist_plus'), false) THEN 'depth' END, CASE WHEN dev IS NULL THEN 'no_device' END) AS reasons FROM (SELECT CASE WHEN report_id % 7 = 0 THEN NULL WHEN report_id % 11 = 0 THEN 12.0 ELSE lon END AS lo, lat,
 CASE WHEN report_id % 5 = 0 THEN 'deep' ELSE depth_class END AS dc, CASE WHEN report_id % 13 <> 0 THEN device_id END AS dev FROM v_reports)) GROUP BY 1""", "v_reports"))
def validate_submission(spark, d):
    k = lambda n: F.col("report_id") % n
    rows = _rep(spark, d).withColumns({
        "lon": F.when(k(7) == 0, None).when(k(11) == 0, 12.0).otherwise(F.col("lon")), "depth_class": F.when(k(5) == 0, "deep").otherwise(F.col("depth_class")),
        "device_id": F.when(k(13) != 0, F.col("device_id")),
    })
    return r.validate(rows).groupBy("reasons").agg(F.count("*").alias("rows"))


@query("active_event", with_views("""SELECT gauge_id, newest, danger, danger > 0 AND h <= 6 AS active FROM (SELECT gauge_id, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS newest, count(*) FILTER (level_m >= danger_level_m AND observed_at > TIMESTAMP '2024-01-30 00:00:00') AS danger,
 date_diff('second', max(observed_at), TIMESTAMP '2024-01-31 00:00:00') / 3600.0 AS h FROM v_readings JOIN v_stations USING (gauge_id) GROUP BY 1)""", "v_readings", "v_stations"))
def active_event(spark, d):
    j = view(spark, d, "v_readings").join(view(spark, d, "v_stations"), "gauge_id")
    high = (F.col("level_m") >= F.col("danger_level_m")) & (F.col("observed_at") > _now("2024-01-30 00:00:00"))
    g = j.groupBy("gauge_id").agg(F.max("observed_at").alias("at"), F.count_if(high).alias("danger"))
    fresh = F.timestamp_diff("SECOND", F.col("at"), _now()) / 3600 <= 6
    return g.select("gauge_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("newest"), "danger", ((F.col("danger") > 0) & fresh).alias("active"))


@query("rate_limit", with_views("SELECT subject_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, greatest(0, count(*) - 5) AS rejected FROM v_deliveries GROUP BY subject_id, date_trunc('day', ts)", "v_deliveries"))
def rate_limit(spark, d):
    return r.bucket_verdicts(view(spark, d, "v_deliveries"), "subject_id", "ts", "1 day", 5)


@query("delivery_dedupe", with_views("SELECT event_type, count(*) AS deliveries, count(DISTINCT delivery_id % 4000) AS kept FROM v_deliveries GROUP BY 1", "v_deliveries"))
def delivery_dedupe(spark, d):
    v = view(spark, d, "v_deliveries").withColumn("k", F.col("delivery_id") % 4000)
    once = v.dropDuplicates(["event_type", "k"]).groupBy("event_type").agg(F.count("*").alias("kept"))
    return v.groupBy("event_type").agg(F.count("*").alias("deliveries")).join(once, "event_type").select("event_type", "deliveries", "kept")


_ALERTS = "SELECT user_id AS subject_id, ts AS t, CAST(event_id % 3 AS INTEGER) AS severity, event_id FROM events WHERE event_type = 'error'"
_DUE = "e.t >= f.last + INTERVAL 6 HOUR OR e.severity > f.sev"


@query("push_cooldown", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t, severity, event_id) AS k FROM ({_ALERTS})),
f AS (SELECT subject_id, k, t AS last, severity AS sev, 1 AS n FROM e WHERE k = 1 UNION ALL SELECT f.subject_id, e.k, CASE WHEN {_DUE} THEN e.t ELSE f.last END, CASE WHEN {_DUE} THEN e.severity ELSE f.sev END,
 f.n + CASE WHEN {_DUE} THEN 1 ELSE 0 END FROM f JOIN e ON e.subject_id = f.subject_id AND e.k = f.k + 1)
SELECT subject_id, max(k) AS events, max(n) AS pushed, strftime(max(last), '%Y-%m-%d %H:%M:%S') AS last_push FROM f GROUP BY 1""")
def push_cooldown(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("subject_id"), F.col("ts").alias("at"), (F.col("event_id") % 3).cast("int").alias("severity"), "event_id")
    return r.cooled_pushes(e, "subject_id", 6).withColumn("last_push", F.date_format("last_push", "yyyy-MM-dd HH:mm:ss"))


@query("export_window", with_views("SELECT r.report_id, r.depth_class, e.event_type AS verification FROM v_reports r LEFT JOIN (SELECT event_id % 5000 AS report_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) e USING (report_id) WHERE submitted_at >= TIMESTAMP '2024-01-10 00:00:00' AND submitted_at < TIMESTAMP '2024-01-12 00:00:00'", "v_reports"))
def export_window(spark, d):
    """Reports of a half-open window with their latest verification; the window filter reaches the scan."""
    last = table(spark, d, "events").groupBy((F.col("event_id") % 5000).alias("report_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("verification"))
    some = _rep(spark, d).where((F.col("submitted_at") >= _now("2024-01-10 00:00:00")) & (F.col("submitted_at") < _now("2024-01-12 00:00:00")))
    return some.join(last, "report_id", "left").select("report_id", "depth_class", "verification")


@query("feed_union", with_views("SELECT CASE WHEN depth_class = 'dry' THEN 'dry' ELSE 'wet' END AS kind, strftime(max(submitted_at), '%Y-%m-%d %H:%M:%S') AS stamp, count(*) AS rows FROM v_reports GROUP BY 1", "v_reports"))
def feed_union(spark, d):
    """Severity feeds in one table, stamped with each feed's own newest time."""
    dry, wet = _rep(spark, d).where("depth_class = 'dry'"), _rep(spark, d).where("depth_class <> 'dry'")
    both = dry.select(F.lit("dry").alias("kind"), "submitted_at").unionByName(wet.select(F.lit("wet").alias("kind"), "submitted_at"))
    g = both.groupBy("kind").agg(F.max("submitted_at").alias("s"), F.count("*").alias("rows"))
    return g.select("kind", F.date_format("s", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "rows")


@query("run_ledger", with_views("SELECT strftime(submitted_at, '%Y-%m-%d') AS day, count(*) AS runs, max(report_id) AS last_run, md5(concat_ws('|', max(report_id), count(*))) AS digest FROM v_reports GROUP BY 1", "v_reports"))
def run_ledger(spark, d):
    g = _rep(spark, d).groupBy(F.date_format("submitted_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("runs"), F.max("report_id").alias("last_run"))
    return g.withColumn("digest", F.md5(F.concat_ws("|", "last_run", "runs")))


@query("json_contract", """SELECT event_type, count(*) AS rows, count(*) FILTER (k BETWEEN 0 AND 79) AS accepted, count(*) FILTER (NOT coalesce(k BETWEEN 0 AND 79, false)) AS quarantined, CAST(sum(k) FILTER (k BETWEEN 0 AND 79) AS BIGINT) AS total
FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""")
def json_contract(spark, d):
    """Payloads are parsed by a pinned schema; a breach of the contract quarantines the payload."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    ok = F.coalesce(F.col("k").between(0, 79), F.lit(False))
    return e.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("quarantined"), F.sum(F.when(ok, F.col("k"))).alias("total"))


@query("sealed_keys", "SELECT event_type, count(*) FILTER (len(list_filter(json_keys(props), lambda x: x NOT IN ('k'))) > 0) AS unexpected, count(*) AS rows FROM events GROUP BY 1")
def sealed_keys(spark, d):
    extra = F.size(F.array_except(F.json_object_keys("props"), F.array(F.lit("k"))))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(extra > 0).alias("unexpected"), F.count("*").alias("rows"))


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"
_PHONE = r"\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?[ -][0-9]{3}[ -][0-9]{4}"


@query("pii_scan", f"SELECT doc_id, len(regexp_extract_all(text, '{_MAIL}')) AS mails, len(regexp_extract_all(text, '{_PHONE}')) AS phones FROM documents WHERE regexp_matches(text, '{_MAIL}') OR regexp_matches(text, '{_PHONE}')")
def pii_scan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").where(F.col("text").rlike(_MAIL) | F.col("text").rlike(_PHONE))
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("mails"), F.size(F.regexp_extract_all("text", F.lit(_PHONE), F.lit(0))).alias("phones"))


@query("link_discovery", with_views(r"""SELECT page_id, link, CASE WHEN regexp_matches(lower(link), '\.pdf($|\?)') THEN 'pdf' WHEN regexp_matches(link, '^https?://') THEN 'page' ELSE 'relative' END AS kind, count(*) AS times
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM v_links) GROUP BY 1, 2, 3""", "v_links"))
def link_discovery(spark, d):
    links = view(spark, d, "v_links").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    kind = F.when(F.lower("link").rlike(r"\.pdf($|\?)"), "pdf").when(F.col("link").rlike("^https?://"), "page").otherwise("relative")
    return links.groupBy("page_id", "link", kind.alias("kind")).agg(F.count("*").alias("times"))


_P = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$'"
_DOTS = """(SELECT array_to_string(CASE WHEN string_split(raw, '/')[-1] IN ('.', '..') THEN list_append(kept, '') ELSE kept END, '/') FROM (SELECT list_reduce(list_transform(string_split(raw, '/'), lambda x: [x]),
 lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN CASE WHEN len(acc) > 1 THEN acc[:-2] ELSE acc END ELSE list_concat(acc, x) END, []::VARCHAR[]) AS kept))"""
_RESOLVED = f"""SELECT site, page_id, url AS base, href, title, CASE WHEN scheme <> '' THEN href WHEN host <> '' THEN head || href WHEN path = '' THEN root || bpath || CASE WHEN q = '' THEN bq ELSE q END || frag ELSE root || {_DOTS} || q || frag END AS link
 FROM (SELECT *, CASE WHEN path[1:1] = '/' THEN path ELSE regexp_replace(CASE WHEN bpath = '' THEN '/' ELSE bpath END, '[^/]*$', '') || path END AS raw FROM (
  SELECT *, regexp_extract(href, {_P}, 1) AS scheme, regexp_extract(href, {_P}, 2) AS host, regexp_extract(href, {_P}, 3) AS path, regexp_extract(href, {_P}, 4) AS q, regexp_extract(href, {_P}, 5) AS frag,
   regexp_extract(url, {_P}, 1) || ':' AS head, regexp_extract(url, {_P}, 1) || ':' || regexp_extract(url, {_P}, 2) AS root, regexp_extract(url, {_P}, 3) AS bpath, regexp_extract(url, {_P}, 4) AS bq
  FROM (SELECT site, page_id, url, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&amp;', '&'), '[ ]+', ' ', 'g')) AS title
   FROM (SELECT site, page_id, url, unnest(regexp_extract_all(html, '<a ([^>]*)>(.*?)</a>', 1)) AS tag, unnest(regexp_extract_all(html, '<a ([^>]*)>(.*?)</a>', 2)) AS body FROM v_landed)) WHERE href <> ''))"""
_FOUND = f"SELECT * FROM ({_RESOLVED}) WHERE regexp_matches(lower(link), '^[a-z]+://([^/?#]*[.])?example[.]org([/?#]|$)')"
_DOCUMENTS = f"""SELECT site, link AS url, min(title) AS title FROM (SELECT site, link, title FROM ({_FOUND}) WHERE regexp_matches(title, '(?i)relief camps?|ddmp') AND regexp_matches(lower(link), '^[^?]*[.]pdf([?]|$)')
 UNION ALL SELECT a.site, b.link, a.title FROM ({_FOUND}) a JOIN ({_FOUND}) b ON regexp_replace(a.link, '#.*$', '') = b.base AND regexp_matches(a.title, '(?i)relief camps?|ddmp') AND NOT regexp_matches(lower(a.link), '^[^?]*[.]pdf([?]|$)') AND regexp_matches(lower(b.link), '^[^?]*[.]pdf([?]|$)')) GROUP BY 1, 2"""


@query("link_resolution", with_views(f"SELECT page_id, href, link AS url, title, count(*) AS times FROM ({_RESOLVED}) GROUP BY 1, 2, 3, 4", "v_landed"))
def link_resolution(spark, d):
    """Every anchor of every page, made absolute from its page."""
    return links.links(view(spark, d, "v_landed"), "page_id").groupBy("page_id", "href", "url", "title").agg(F.count("*").alias("times"))


@query("link_documents", with_views(f"SELECT site, url, title, CASE WHEN regexp_matches(title, '(?i)relief') THEN 'dedicated_camp_list' ELSE 'contingency_plan' END AS document_type FROM ({_DOCUMENTS})", "v_landed"))
def link_documents(spark, d):
    """Documents by one hop or two, per site."""
    return links.documents(view(spark, d, "v_landed"), "site", ["example.org"])


@query("link_groups", with_views(f"SELECT site, pages, landed, coalesce(documents, 0) AS documents, CASE WHEN documents > 0 THEN 'found' ELSE 'no_candidate_found' END AS status FROM (SELECT site, count(*) AS pages, count(html) AS landed FROM v_landed GROUP BY 1) LEFT JOIN (SELECT site, count(*) AS documents FROM ({_DOCUMENTS}) GROUP BY 1) USING (site)", "v_landed"))
def link_groups(spark, d):
    pages = view(spark, d, "v_landed")
    return links.group_status(pages, links.documents(pages, "site", ["example.org"]), "site")
