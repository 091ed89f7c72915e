import random
from datetime import datetime, timedelta

from freshet.streaming import stateful as st

T0 = datetime(2024, 7, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def run(spark, tmp_path, operator, batches, schema):
    """The operator's rows over batches, each read as one micro-batch."""
    source = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    st.drain(operator(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.conf.get(name) == before
    return spark.read.parquet(str(tmp_path / "out")).collect()


TALK = "channel string, subject_id long, event_id long, ts timestamp, event string, lat double, lon double, locality_id string, depth_class string"


def said(n, hours, event, lat=None, lon=None, loc=None, depth=None, who=1):
    return ("web", who, n, at(hours), event, lat, lon, loc, depth)


def test_a_conversation_over_batches(spark, tmp_path):
    batches = [
        [said(1, 0, "begin"), said(2, 0.1, "submit"), said(3, 0.2, "accept_responsibility"), said(4, 0.3, "emergency_help")],
        [said(5, 1, "continue_reporting"), said(6, 1.1, "location_shared", 10.0, 92.0), said(7, 1.2, "location_shared", 26.12345, 92.98765, "L1"), said(8, 1.3, "depth_selected", depth="deep"), said(20, 1, "begin", who=2)],
        [said(9, 2, "depth_selected", depth="knee"), said(10, 2.1, "repeat"), said(11, 2.2, "submit"), said(12, 2.3, "cancel"), said(13, 2.4, "restart"), said(14, 2.5, None)],
        [said(15, 40, "accept_responsibility"), said(30, 60, "begin", who=3)],
    ]
    got = {(r.event_id or f"expired {r.subject_id}"): (r.state_before, r.state, r.outcome) for r in run(spark, tmp_path, st.conversations, batches, TALK)}
    assert got == {
        "1": ("idle", "responsibility_notice", "moved"), "2": ("responsibility_notice", "responsibility_notice", "invalid"), "3": ("responsibility_notice", "awaiting_location", "moved"),
        "4": ("awaiting_location", "emergency_guidance", "moved"), "5": ("emergency_guidance", "awaiting_location", "moved"), "6": ("awaiting_location", "awaiting_location", "refused"),
        "7": ("awaiting_location", "awaiting_depth", "moved"), "8": ("awaiting_depth", "awaiting_depth", "refused"), "9": ("awaiting_depth", "review", "moved"), "10": ("review", "review", "repeated"),
        "11": ("review", "submitted", "moved"), "12": ("submitted", "submitted", "invalid"), "13": ("submitted", "responsibility_notice", "moved"),
        "14": ("responsibility_notice", "responsibility_notice", "invalid"), "expired 1": ("responsibility_notice", "expired", "moved"), "15": ("idle", "idle", "invalid"),
        "20": ("idle", "responsibility_notice", "moved"), "expired 2": ("responsibility_notice", "expired", "moved"), "30": ("idle", "responsibility_notice", "moved"),
    }


def test_a_report_keeps_its_rounded_place(spark, tmp_path):
    whole = [said(1, 0, "begin"), said(2, 0.1, "accept_responsibility"), said(3, 0.2, "location_shared", 26.12345, 92.98765, "L1"), said(4, 0.3, "depth_selected", depth="knee"), said(5, 0.4, "change_depth"), said(6, 0.5, "depth_selected", depth="dry"), said(7, 0.6, "submit")]
    rows = [r for r in run(spark, tmp_path, st.conversations, [whole], TALK) if r.persisted]
    assert [(r.event_id, r.lat, r.lon, r.locality_id, r.depth_class) for r in rows] == [("7", 26.123, 92.988, "L1", "dry")]


LEVELS = "gauge_id string, observed_at timestamp, level_m double, trend_cm_per_hr double, danger_level_m double, highest_flood_level_m double, reference_peak_m double, forecast_level_m double"


def level(gauge, hours, m, trend=0.0, reference=None, forecast=None):
    return (gauge, at(hours), m, float(trend), 50.0, 60.0, reference, forecast)


def test_alerts_are_issued_cooled_cleared_and_end(spark, tmp_path):
    batches = [
        [level("a", 0, 49.0), level("a", 1, 50.5, 20), level("a", 2, 49.5), level("a", 3, 51.0, 20), level("a", 4, 60.0, 30)],
        [level("a", 5, 49.0), level("a", 6, None), level("a", 7, 48.0), level("a", 8, 47.0), level("a", 9, 46.0), level("b", 0.5, 61.0)],
        [level("c", 20, 55.0, 10.0, reference=55.5), level("d", 20, 40.0, forecast=60.0), level("e", 20, 59.0, 1.0)],
        [level("c", 40, 40.0)],
    ]
    got = sorted((r.gauge_id, r.at, r.kind, r.severity, r.push) for r in run(spark, tmp_path, st.alerts, batches, LEVELS))
    assert got == [
        ("a", at(1), "issued", "watch", True), ("a", at(3), "issued", "watch", False), ("a", at(4), "issued", "severe", True), ("a", at(8), "issued", "all_clear", False),
        ("b", at(0.5), "issued", "severe", True), ("b", at(12.5), "expired", "severe", False), ("c", at(20), "issued", "high", True), ("c", at(32), "expired", "high", False),
        ("d", at(20), "issued", "severe", True), ("d", at(32), "expired", "severe", False),
    ]


def test_silent_gauges_are_told_by_timers(spark, tmp_path):
    batches = [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("b", at(9)), ("c", at(9))], [("c", at(14)), ("b", at(16))]]
    got = sorted((r.gauge_id, r.at, r.status, r.last_observed_at) for r in run(spark, tmp_path, st.silences, batches, "gauge_id string, observed_at timestamp"))
    assert got == [
        ("a", at(0), "fresh", at(0)), ("a", at(8), "no_data", at(2)), ("b", at(1), "fresh", at(1)), ("b", at(7), "no_data", at(1)), ("b", at(9), "fresh", at(9)), ("b", at(15), "no_data", at(9)),
        ("b", at(16), "fresh", at(16)), ("c", at(9), "fresh", at(9)),
    ]


def verdicts(rows, events, network, reports):
    """The limits one after the other, event by event."""
    counts, out = {}, {}

    def over(limits, key, ts):
        first = None
        for scope, seconds, limit in limits:
            k = scope, key, int((ts - datetime(1970, 1, 1)).total_seconds()) // seconds
            counts[k] = counts.get(k, 0) + 1
            if counts[k] > limit and first is None:
                first = scope
        return first

    for i, channel, who, net, ts, report in rows:
        found = over(events, (channel, who), ts)
        if not found and channel == "web" and net:
            found = over(network, net, ts)
        if not found and report:
            found = over(reports, (channel, who), ts)
        out[str(i)] = found
    return out


def test_several_limits_at_once(spark, tmp_path):
    draw = random.Random(7)
    rows, ts = [], T0
    for i in range(400):
        ts += timedelta(minutes=draw.choice([0, 1, 1, 2, 60 if draw.random() < 0.05 else 1]))
        rows.append((i, draw.choice(["web", "telegram"]), draw.randrange(4), draw.choice(["n1", "n2", None]), ts, draw.choice([True, False, None])))
    limits = (("event_10m", 600, 3), ("event_day", 86_400, 50)), (("network_day", 86_400, 40),), (("report_10m", 600, 1), ("report_day", 86_400, 12))
    want = verdicts(rows, *limits)
    schema = "event_id long, channel string, subject_id long, network string, ts timestamp, is_report boolean"
    got = run(spark, tmp_path, lambda s: st.rate_verdicts(s, "1 hour", *limits), [rows[:130], rows[130:260], rows[260:]], schema)
    assert {r.event_id: r.over for r in got} == want and len(got) == len(rows)
    assert set(want.values()) == {None, "event_10m", "event_day", "network_day", "report_10m", "report_day"}
    assert {r.retry_after for r in got if r.over == "network_day"} == {3600} and all((r.retry_after == 0) == r.allowed for r in got)
