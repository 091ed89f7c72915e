"""Queries of the stateful stream operators: the driver's events land in three parts by time, and the stream is drained
after each, from its checkpoint. SQL twins fold the same rows with recursive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.plans.bindings import table, view, with_views
from freshet.plans.registry import query
from freshet.shared import new_path
from freshet.streaming import granules as gr
from freshet.streaming import stateful as st


def _drained(df, spark, at, operator, name, parts=3):
    """What the stream operator makes of df, landed in parts of equal time spans."""
    source, out, state = (new_path(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        df.write.parquet(source)
        return spark.createDataFrame([], operator(spark.readStream.schema(df.schema).parquet(source)).schema)
    step = (high - low) / parts
    for i in range(parts):
        after = F.col(at) >= low + i * step if i else F.lit(True)
        before = F.col(at) < low + (i + 1) * step if i < parts - 1 else F.lit(True)
        df.where(after & before).write.mode("append").parquet(source)
        stream = operator(spark.readStream.schema(df.schema).parquet(source))
        st.drain(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


_SAID = ["begin", "accept_responsibility", "location_shared", "depth_selected", "submit"] * 3 + ["change_depth", "emergency_help", "continue_reporting", "repeat", "restart", "cancel", "emergency_help", "continue_reporting"]
_SAID_SQL = "[" + ", ".join(f"'{x}'" for x in _SAID) + "]"
_EVENTS = f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'telegram' END AS channel, CAST(user_id AS VARCHAR) AS subject_id, strftime(ts, '%Y-%m') AS period, event_id, ts,
 {_SAID_SQL}[event_id % {len(_SAID)} + 1] AS event, 24 + (event_id % 700) / 100.0::DOUBLE AS lat, 90 + (event_id % 50) / 10.0::DOUBLE + 0.0005 AS lon, CASE WHEN event_id % 3 = 0 THEN 'L' || (event_id % 9) END AS loc,
 ['dry', 'ankle', 'knee', 'waist_plus', 'deep'][event_id % 5 + 1] AS dep FROM events"""


@query("conversation_stream", f"""WITH RECURSIVE ev AS ({_EVENTS}),
e AS (SELECT *, row_number() OVER w AS k, coalesce(ts >= lag(ts) OVER w + INTERVAL 24 HOUR, true) AS fresh, lead(ts) OVER w AS later FROM ev WINDOW w AS (PARTITION BY channel, subject_id, period ORDER BY ts, event_id)),
f AS (
 SELECT channel, subject_id, period, CAST(0 AS BIGINT) AS k, 'idle' AS before, 'idle' AS state, CAST(NULL AS VARCHAR) AS resume, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS VARCHAR) AS loc, CAST(NULL AS VARCHAR) AS dep, 'moved' AS outcome
 FROM e WHERE k = 1
 UNION ALL
 SELECT channel, subject_id, period, k, b, CASE WHEN outcome = 'moved' THEN nxt ELSE b END,
  CASE WHEN outcome <> 'moved' THEN r WHEN event = 'emergency_help' THEN CASE WHEN b IN ('responsibility_notice', 'awaiting_location', 'awaiting_depth', 'review') THEN b ELSE 'responsibility_notice' END
   WHEN event IN ('cancel', 'submit', 'restart', 'continue_reporting') THEN NULL ELSE r END,
  CASE WHEN outcome = 'moved' AND event = 'restart' THEN NULL WHEN outcome = 'moved' AND event = 'location_shared' THEN floor(elat * 1000 + 0.5) / 1000 ELSE la END,
  CASE WHEN outcome = 'moved' AND event = 'restart' THEN NULL WHEN outcome = 'moved' AND event = 'location_shared' THEN floor(elon * 1000 + 0.5) / 1000 ELSE lo END,
  CASE WHEN outcome = 'moved' AND event = 'restart' THEN NULL WHEN outcome = 'moved' AND event = 'location_shared' THEN eloc ELSE l END,
  CASE WHEN outcome = 'moved' AND event IN ('restart', 'change_depth') THEN NULL WHEN outcome = 'moved' AND event = 'depth_selected' THEN edep ELSE d END, outcome
 FROM (SELECT *, CASE WHEN event = 'repeat' THEN 'repeated' WHEN nxt IS NULL THEN 'invalid' WHEN event = 'location_shared' AND NOT (elat BETWEEN 24 AND 29.5 AND elon BETWEEN 89 AND 97) THEN 'refused'
   WHEN event = 'depth_selected' AND edep = 'deep' THEN 'refused' WHEN event = 'submit' AND (la IS NULL OR d IS NULL) THEN 'refused' ELSE 'moved' END AS outcome
  FROM (SELECT *, CASE WHEN event = 'emergency_help' AND NOT fin THEN 'emergency_guidance' WHEN event = 'restart' AND fin THEN 'responsibility_notice' WHEN event = 'cancel' AND NOT fin THEN 'cancelled'
    WHEN event = 'continue_reporting' AND b = 'emergency_guidance' THEN coalesce(r, 'responsibility_notice') WHEN b = 'idle' AND event = 'begin' THEN 'responsibility_notice'
    WHEN b = 'responsibility_notice' AND event = 'accept_responsibility' THEN 'awaiting_location' WHEN b = 'awaiting_location' AND event = 'location_shared' THEN 'awaiting_depth'
    WHEN b = 'awaiting_depth' AND event = 'depth_selected' THEN 'review' WHEN b = 'review' AND event = 'change_depth' THEN 'awaiting_depth' WHEN b = 'review' AND event = 'submit' THEN 'submitted' END AS nxt
   FROM (SELECT f.channel, f.subject_id, f.period, e.k, e.event, e.lat AS elat, e.lon AS elon, e.loc AS eloc, e.dep AS edep, CASE WHEN fresh THEN 'idle' ELSE f.state END AS b,
     CASE WHEN NOT fresh THEN f.resume END AS r, CASE WHEN NOT fresh THEN f.lat END AS la, CASE WHEN NOT fresh THEN f.lon END AS lo, CASE WHEN NOT fresh THEN f.loc END AS l, CASE WHEN NOT fresh THEN f.dep END AS d,
     NOT fresh AND f.state IN ('submitted', 'cancelled', 'expired') AS fin FROM f JOIN e ON e.channel = f.channel AND e.subject_id = f.subject_id AND e.period = f.period AND e.k = f.k + 1))) ),
g AS (SELECT f.*, e.event_id, e.ts, e.event, e.later FROM f JOIN e USING (channel, subject_id, period, k))
SELECT channel, subject_id, period, CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event, before AS state_before, state, outcome, lat, lon, loc AS locality_id, dep AS depth_class, event = 'submit' AND outcome = 'moved' AS persisted FROM g
UNION ALL SELECT channel, subject_id, period, NULL, strftime(ts + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S'), 'expire', state, 'expired', 'moved', lat, lon, loc, dep, false FROM g
 WHERE state NOT IN ('submitted', 'cancelled', 'expired') AND (later >= ts + INTERVAL 24 HOUR OR (later IS NULL AND ts + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR))""")
def conversation_stream(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (i % len(_SAID) + 1).cast("int"))
    depth = F.element_at(F.array(*[F.lit(x) for x in ("dry", "ankle", "knee", "waist_plus", "deep")]), (i % 5 + 1).cast("int"))
    rows = e.select(
        F.when(F.col("user_id") % 2 == 0, "web").otherwise("telegram").alias("channel"), F.col("user_id").alias("subject_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), said.alias("event"),
        (24 + (i % 700) / 100).alias("lat"), (90 + (i % 50) / 10 + 0.0005).alias("lon"), F.when(i % 3 == 0, F.concat(F.lit("L"), (i % 9).cast("string"))).alias("locality_id"), depth.alias("depth_class"),
    )
    return _drained(rows, spark, "ts", st.conversations, "conversations").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


_LEVELS = """SELECT gauge_id, observed_at AS t, level_m AS m, CAST(extract('hour' FROM observed_at) AS INTEGER) * 7 % 60 - 20.0::DOUBLE AS trend, 90.0::DOUBLE AS danger, 200.0::DOUBLE AS highest,
 CASE WHEN gauge_id < 'S_15' THEN 150.0::DOUBLE END AS peak, CASE WHEN extract('hour' FROM observed_at) = 3 THEN level_m * 1.1 END AS forecast FROM v_readings_sparse"""


def _near(target):
    return f"({target} IS NOT NULL AND CASE WHEN e.forecast IS NOT NULL THEN e.forecast >= {target} ELSE e.trend > 0 AND {target} > e.m AND ({target} - e.m) / (e.trend / 100) <= 12 END)"


_ID = """sha256('["' || gauge_id || '",' || epoch_us("at") || ',"' || kind || '","' || severity || '","' || reason || '",' || push || ']')"""


@query("alert_stream", with_views(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY t) AS k FROM ({_LEVELS})),
f AS (
 SELECT gauge_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS t, CAST(NULL AS DOUBLE) AS level, 0 AS low, CAST(NULL AS TIMESTAMP) AS pushed, CAST(NULL AS INTEGER) AS pushed_as, CAST(NULL AS INTEGER) AS open, CAST(NULL AS TIMESTAMP) AS expires,
  CAST(NULL AS INTEGER) AS sev, false AS push, CAST(NULL AS INTEGER) AS ended, CAST(NULL AS TIMESTAMP) AS ended_at FROM e WHERE k = 1
 UNION ALL
 SELECT gauge_id, k, t, m, low, CASE WHEN push THEN t ELSE pushed END, CASE WHEN push THEN sev ELSE pushed_as END, CASE WHEN sev IS NULL THEN open WHEN sev > 0 THEN sev END, CASE WHEN sev IS NULL THEN expires WHEN sev > 0 THEN t + INTERVAL 12 HOUR END, sev, push, ended, ended_at
 FROM (SELECT *, coalesce(sev IS NOT NULL AND (pushed IS NULL OR t >= pushed + INTERVAL 6 HOUR OR sev > pushed_as), false) AS push
  FROM (SELECT *, CASE WHEN severe THEN 4 WHEN high THEN 3 WHEN crossed THEN 2 WHEN open IS NOT NULL AND low >= 3 THEN 0 END AS sev
   FROM (SELECT f.gauge_id, e.k, e.t, e.m, f.pushed, f.pushed_as, CASE WHEN e.m < e.danger THEN f.low + 1 ELSE 0 END AS low, CASE WHEN e.t >= f.expires THEN NULL ELSE f.open END AS open, CASE WHEN e.t >= f.expires THEN NULL ELSE f.expires END AS expires,
     CASE WHEN e.t >= f.expires THEN f.open END AS ended, CASE WHEN e.t >= f.expires THEN f.expires END AS ended_at, e.m >= e.highest OR {_near('e.highest')} AS severe, {_near('e.peak')} AS high, coalesce(f.level < e.danger AND e.danger <= e.m AND e.trend > 0, false) AS crossed
    FROM f JOIN e ON e.gauge_id = f.gauge_id AND e.k = f.k + 1)))
), n AS (SELECT unnest([0, 2, 3, 4]) AS sev, unnest(['all_clear', 'watch', 'high', 'severe']) AS severity,
 unnest(['Three consecutive readings below the danger level', 'Crossed the official danger level while rising', 'Projected above the most recent reference flood within 12 hours', 'At or projected above the official highest flood level']) AS reason),
o AS (SELECT gauge_id, t AS at, 'issued' AS kind, severity, reason, push, NOT push AS suppressed, t + INTERVAL 12 HOUR AS expires_at FROM f JOIN n USING (sev)
 UNION ALL SELECT gauge_id, ended_at, 'expired', severity, 'No trigger for as long as an alert lasts', false, false, ended_at FROM f JOIN n ON n.sev = f.ended
 UNION ALL SELECT gauge_id, expires, 'expired', severity, 'No trigger for as long as an alert lasts', false, false, expires FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY gauge_id ORDER BY k DESC) = 1) l JOIN n ON n.sev = l.open
  WHERE expires <= (SELECT max(t) FROM e) - INTERVAL 30 MINUTE)
SELECT gauge_id, strftime("at", '%Y-%m-%d %H:%M:%S') AS at, kind, severity, reason, push, suppressed, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at, {_ID} AS alert_id FROM o""", "v_readings_sparse").replace("WITH v_readings", "WITH RECURSIVE v_readings"))
def alert_stream(spark, d):
    hour = F.hour("observed_at")
    rows = view(spark, d, "v_readings_sparse").select(
        "gauge_id", F.col("observed_at").cast("timestamp").alias("observed_at"), "level_m", (hour * 7 % 60 - 20.0).alias("trend_cm_per_hr"), F.lit(90.0).alias("danger_level_m"), F.lit(200.0).alias("highest_flood_level_m"),
        F.when(F.col("gauge_id") < "S_15", 150.0).alias("reference_peak_m"), F.when(hour == 3, F.col("level_m") * 1.1).alias("forecast_level_m"),
    )
    out = _drained(rows, spark, "observed_at", st.alerts, "alerts")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("at", "expires_at")})


@query("silent_gauges", with_views("""WITH r AS (SELECT gauge_id, observed_at AS t, lag(observed_at) OVER w AS before, lead(observed_at) OVER w AS later FROM v_readings_sparse WINDOW w AS (PARTITION BY gauge_id ORDER BY observed_at))
SELECT gauge_id, strftime("at", '%Y-%m-%d %H:%M:%S') AS at, status, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_observed_at FROM (
 SELECT gauge_id, t AS at, 'fresh' AS status, t AS last FROM r WHERE before IS NULL OR t >= before + INTERVAL 6 HOUR
 UNION ALL SELECT gauge_id, t + INTERVAL 6 HOUR, 'no_data', t FROM r WHERE later >= t + INTERVAL 6 HOUR OR (later IS NULL AND t + INTERVAL 6 HOUR <= (SELECT max(t) FROM r) - INTERVAL 30 MINUTE))""", "v_readings_sparse"))
def silent_gauges(spark, d):
    rows = view(spark, d, "v_readings_sparse").select("gauge_id", F.col("observed_at").cast("timestamp").alias("observed_at"))
    out = _drained(rows, spark, "observed_at", st.silences, "silences")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("at", "last_observed_at")})


_BUSY = (("event_10m", 600, 2), ("event_day", 86_400, 10)), (("network_day", 86_400, 25),), (("report_10m", 600, 1), ("report_day", 86_400, 3))


def _rank(limits, key, test):
    return ", ".join(f"row_number() OVER (PARTITION BY {key}, epoch_us(ts) // {s * 1_000_000} ORDER BY ts, event_id) > {n} AND {test} AS {scope}" for scope, s, n in limits)


@query("rate_verdicts", f"""WITH e AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'telegram' END AS channel, user_id % 40 AS who, CASE WHEN event_id % 7 > 0 THEN 'n' || (user_id % 6) END AS net, ts, event_type IN ('purchase', 'signup') AS rep FROM events),
a AS (SELECT *, {_rank(_BUSY[0], "channel, who", "true")} FROM e), b AS (SELECT *, CASE WHEN event_10m THEN 'event_10m' WHEN event_day THEN 'event_day' END AS o1 FROM a),
c AS (SELECT *, coalesce(o1 IS NULL AND channel = 'web' AND net IS NOT NULL, false) AS w FROM b), n AS (SELECT *, {_rank(_BUSY[1], "w, net", "w")} FROM c),
m AS (SELECT *, CASE WHEN o1 IS NOT NULL THEN o1 WHEN network_day THEN 'network_day' END AS o2 FROM n), p AS (SELECT *, o2 IS NULL AND rep AS y FROM m), q AS (SELECT *, {_rank(_BUSY[2], "y, channel, who", "y")} FROM p),
z AS (SELECT *, CASE WHEN o2 IS NOT NULL THEN o2 WHEN report_10m THEN 'report_10m' WHEN report_day THEN 'report_day' END AS over FROM q)
SELECT CAST(event_id AS VARCHAR) AS event_id, channel, CAST(who AS VARCHAR) AS subject_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, over IS NULL AS allowed, over, CASE WHEN over = 'network_day' THEN 3600 WHEN over IS NOT NULL THEN 600 ELSE 0 END AS retry_after FROM z""")
def rate_verdicts(spark, d):
    """Limits lower than the operator's own, so that each of them refuses something."""
    u = F.col("user_id")
    rows = table(spark, d, "events").select(
        "event_id", F.when(u % 2 == 0, "web").otherwise("telegram").alias("channel"), (u % 40).alias("subject_id"), F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("n"), (u % 6).cast("string"))).alias("network"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("purchase", "signup").alias("is_report"),
    )
    out = _drained(rows, spark, "ts", lambda s: st.rate_verdicts(s, "1 hour", *_BUSY), "verdicts")
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


_CUTS = {"C0,C1,C2": ("C0", "C1", "C2"), "C0,C1,C2,C3": ("C0", "C1", "C2", "C3")}
_CUT = """SELECT substr(sha256('{name}'), 1, 12) AS digest, run, granule, part, count(*) AS readings, string_agg(cell_id || interval_start || rate_mm_h, ',' ORDER BY cell_id, interval_start) AS content, sum(rate_mm_h) AS mm
 FROM v_granules WHERE cell_id IN ({cells}) GROUP BY run, granule, part"""
_BOTH_CUTS = " UNION ALL ".join(_CUT.format(name=n, cells=", ".join(f"'{c}'" for c in cs)) for n, cs in _CUTS.items())


@query("granule_store", with_views(f"""SELECT digest, run, granule, max(readings) FILTER (part = 0) AS readings, count(*) AS payloads, count(*) FILTER (part = 1 AND content = kept) AS same, count(*) FILTER (part = 1 AND content <> kept) AS changed,
 CAST(max(mm) FILTER (part = 0) AS DECIMAL(28, 6)) AS rate_sum FROM (SELECT *, first_value(content) OVER (PARTITION BY digest, run, granule ORDER BY part) AS kept FROM ({_BOTH_CUTS})) GROUP BY 1, 2, 3""", "v_granules"))
def granule_store(spark, d):
    """Granules by run and day, fetched and, for odd days, fetched again; first for three cells, then for a wider set."""
    source, path = new_path(spark, "granules-in"), new_path(spark, "granules")
    rows = view(spark, d, "v_granules")
    cells = {n: spark.createDataFrame([(c,) for c in cs], "cell_id string") for n, cs in _CUTS.items()}
    for part in (0, 1):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        for name, wanted in cells.items():
            stream = spark.readStream.schema(rows.drop("part").schema).parquet(source)
            gr.store(stream, wanted, path, f"{path}/checkpoint-{len(name)}").awaitTermination()
    sums = None
    for wanted in cells.values():
        got = gr.read_cuts(spark, path, wanted).groupBy("digest", "run", "granule").agg(F.count("*").alias("readings"), F.sum("rate_mm_h").alias("rate_sum"))
        sums = got if sums is None else sums.unionByName(got)
    of = lambda o: F.count_if(F.col("outcome") == o)
    seen = gr.ledger(spark, path).groupBy("digest", "run", "granule").agg(F.count("*").alias("payloads"), of("same").alias("same"), of("changed").alias("changed"))
    return seen.join(sums, ["digest", "run", "granule"])
