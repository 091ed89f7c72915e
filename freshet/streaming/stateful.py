"""Stateful stream operators with timers: conversations, alerts, silent gauges and rate limits.

Each keeps a few numbers per key in named state variables. Rows of a key are put in order within a micro-batch, and a
deadline that passes between two rows is applied before the later row, so results do not depend on where batches end;
event-time timers apply it for keys that send nothing more, once the watermark has passed it. Streams need the RocksDB
state store, which `drain` sets while it starts one. Times go in and out as timestamps; inside they are microseconds.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

HOUR = 3_600_000_000

# Events that lead from a state to the next, states that guidance can return to, and final states.
MOVES = {
    ("idle", "begin"): "responsibility_notice",
    ("responsibility_notice", "accept_responsibility"): "awaiting_location",
    ("awaiting_location", "location_shared"): "awaiting_depth",
    ("awaiting_depth", "depth_selected"): "review",
    ("review", "change_depth"): "awaiting_depth",
    ("review", "submit"): "submitted",
}
RESUMABLE = ("responsibility_notice", "awaiting_location", "awaiting_depth", "review")
TERMINAL = ("submitted", "cancelled", "expired")
DEPTHS = ("dry", "ankle", "knee", "waist_plus")
BOUNDS = {"lat": (24.0, 29.5), "lon": (89.0, 97.0)}
SEVERITY_RANK = {"all_clear": 0, "info": 1, "watch": 2, "high": 3, "severe": 4}


def drain(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over what is there, appended to Parquet files, with the state store that timers need."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
    return query


class _Keyed(StatefulProcessor):
    """One tuple of state per key, and at most one timer."""

    state = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.held.get() if self.held.exists() else None
        for row in sorted(rows, key=lambda r: (r["_at"], str(r["_id"]).rjust(20))):
            due = self.due(state)
            if due is not None and row["_at"] >= due:
                state, out = self.late(key, state, due)
                yield from out
            state, out = self.row(key, state, row)
            yield from out
        self._keep(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.held.get() if self.held.exists() else None
        due = self.due(state)
        if due is not None and -(-due // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            state, out = self.late(key, state, due)
            yield from out
            self._keep(state)

    def _keep(self, state) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.held.clear()
            return
        self.held.update(tuple(state))
        due = self.due(state)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, at: str | None = None) -> DataFrame:
    mode = {"eventTimeColumnName": at} if at else {}
    return rows.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime", **mode)


def _timed(rows: DataFrame, at: str, late: str, id_col: str) -> DataFrame:
    """rows with their watermark, time in microseconds and id; rows without a time are left out."""
    marked = rows.where(F.col(at).isNotNull()).withWatermark(at, late) if late else rows
    return marked.withColumn("_at", F.unix_micros(at)).withColumn("_id", F.col(id_col))


class _Conversation(_Keyed):
    """state: conversation state, state to return to, rounded place, locality, depth, time of the last event."""

    state = "state string, resume string, lat double, lon double, locality string, depth string, last long"

    def __init__(self, silence: int):
        self.silence = silence

    def due(self, s):
        return s[6] + self.silence if s else None

    def late(self, key, s, due):
        """Open conversations expire; all begin anew."""
        if s[0] in TERMINAL:
            return None, []
        return None, [self._out(key, None, due, "expire", s[0], "expired", "moved", s)]

    def _out(self, key, event_id, at, event, before, after, outcome, s):
        return Row(channel=key[0], subject_id=key[1], period=key[2], event_id=event_id, _at=at, event=event, state_before=before, state=after, outcome=outcome,
                   lat=s[2], lon=s[3], locality_id=s[4], depth_class=s[5], persisted=event == "submit" and outcome == "moved")

    def row(self, key, s, r):
        s = list(s) if s else ["idle", None, None, None, None, None, r["_at"]]
        before, event, outcome = s[0], r["event"], "moved"
        if event == "emergency_help" and before not in TERMINAL:
            s[0], s[1] = "emergency_guidance", before if before in RESUMABLE else "responsibility_notice"
        elif event == "restart" and before in TERMINAL:
            s = ["responsibility_notice", None, None, None, None, None, s[6]]
        elif event in ("cancel", "expire") and before not in TERMINAL:
            s[0], s[1] = {"cancel": "cancelled", "expire": "expired"}[event], None
        elif event == "repeat":
            outcome = "repeated"
        elif before == "emergency_guidance" and event == "continue_reporting":
            s[0], s[1] = s[1] if s[1] in RESUMABLE else "responsibility_notice", None
        elif (before, event) not in MOVES:
            outcome = "invalid"
        elif event == "location_shared" and not all(r[c] is not None and lo <= r[c] <= hi for c, (lo, hi) in BOUNDS.items()):
            outcome = "refused"
        elif event == "depth_selected" and r["depth_class"] not in DEPTHS:
            outcome = "refused"
        elif event == "submit" and (s[2] is None or s[5] is None):
            outcome = "refused"
        else:
            s[0] = MOVES[before, event]
            if event == "location_shared":
                # three decimals, halves towards the north and east
                s[2], s[3], s[4] = (r["lat"] * 1000 + 0.5) // 1 / 1000, (r["lon"] * 1000 + 0.5) // 1 / 1000, r["locality_id"] or None
            elif event in ("depth_selected", "change_depth"):
                s[5] = r["depth_class"] if event == "depth_selected" else None
            elif event == "submit":
                s[1] = None
        s[6] = max(s[6], r["_at"])
        return s, [self._out(key, r["_id"], r["_at"], event, before, s[0], outcome, s)]


def conversations(events: DataFrame, late: str = "1 hour", silence_hours: int = 24) -> DataFrame:
    """The reporting conversation of every subject, one row per event and one per conversation that expires.

    events(channel, subject_id, event_id, ts, event, lat, lon, locality_id, depth_class), a stream. A conversation belongs
    to a channel, a subject and a month (identities change with it) and begins idle. outcome: moved; repeated (the
    prompt again); invalid (no such event in that state); refused (place outside, unknown depth, incomplete report).
    After so many hours without an event an open one expires, and the next event of any begins anew. An unknown or null
    event is invalid. persisted marks the reports to store."""
    keyed = _timed(events, "ts", late, "event_id").withColumn("period", F.date_format("ts", "yyyy-MM"))
    schema = """channel string, subject_id string, period string, event_id string, _at long, event string, state_before string, state string, outcome string,
        lat double, lon double, locality_id string, depth_class string, persisted boolean"""
    rows = keyed.select("channel", F.col("subject_id").cast("string").alias("subject_id"), "period", F.col("_id").cast("string").alias("_id"), "_at", "ts", "event", "lat", "lon", "locality_id", "depth_class")
    out = _run(rows, ["channel", "subject_id", "period"], _Conversation(silence_hours * HOUR), schema)
    return out.withColumn("at", F.timestamp_micros("_at")).drop("_at")


class _Alerts(_Keyed):
    """state: last level, readings below danger in a row, time and severity of the last push, open alert and its end."""

    state = "level double, low int, pushed long, pushed_as string, open string, expires long"

    def __init__(self, cooldown: int, lasts: int, horizon: float):
        self.cooldown, self.lasts, self.horizon = cooldown, lasts, horizon

    def due(self, s):
        return s[5] if s and s[4] else None

    def late(self, key, s, due):
        out = Row(gauge_id=key[0], _at=due, kind="expired", severity=s[4], reason="No trigger for as long as an alert lasts", push=False, suppressed=False, expires=due)
        return (*s[:4], None, None), [self._named(out)]

    @staticmethod
    def _named(row: Row) -> Row:
        fields = row.asDict()
        text = json.dumps([fields[k] for k in ("gauge_id", "_at", "kind", "severity", "reason", "push")], separators=(",", ":"))
        return Row(**fields, alert_id=hashlib.sha256(text.encode()).hexdigest())

    def _projected(self, r, target) -> bool:
        if target is None:
            return False
        if r["forecast_level_m"] is not None:
            return r["forecast_level_m"] >= target
        trend = r["trend_cm_per_hr"]
        return trend is not None and trend > 0 and target > r["level_m"] and (target - r["level_m"]) / (trend / 100) <= self.horizon

    def row(self, key, s, r):
        level, danger, highest = r["level_m"], r["danger_level_m"], r["highest_flood_level_m"]
        s = list(s) if s else [None, 0, None, None, None, None]
        if level is None:
            return s, []
        s[1] = s[1] + 1 if danger is not None and level < danger else 0
        found = None
        if highest is not None and (level >= highest or self._projected(r, highest)):
            found = "severe", "At or projected above the official highest flood level"
        elif self._projected(r, r["reference_peak_m"]):
            found = "high", "Projected above the most recent reference flood within 12 hours"
        elif danger is not None and s[0] is not None and s[0] < danger <= level and (r["trend_cm_per_hr"] or 0) > 0:
            found = "watch", "Crossed the official danger level while rising"
        elif s[4] and s[1] >= 3:
            found = "all_clear", "Three consecutive readings below the danger level"
        s[0] = level
        if not found:
            return s, []
        severity, reason = found
        push = s[2] is None or r["_at"] - s[2] >= self.cooldown or SEVERITY_RANK[severity] > SEVERITY_RANK[s[3]]
        if push:
            s[2], s[3] = r["_at"], severity
        expires = r["_at"] + self.lasts
        s[4], s[5] = (None, None) if severity == "all_clear" else (severity, expires)
        return s, [self._named(Row(gauge_id=key[0], _at=r["_at"], kind="issued", severity=severity, reason=reason, push=push, suppressed=not push, expires=expires))]


def alerts(readings: DataFrame, late: str = "30 minutes", cooldown_hours: int = 6, lasts_hours: int = 12, horizon_hours: float = 12.0) -> DataFrame:
    """Alerts of every gauge: one row where a reading gives one, one where an alert ends for want of a trigger.

    readings(gauge_id, observed_at, level_m, trend_cm_per_hr, danger_level_m, highest_flood_level_m, reference_peak_m,
    forecast_level_m), a stream. severe: at or projected above the highest flood level; high: projected above the latest
    reference peak; watch: from below danger to danger or above while rising; all_clear: an alert stands and three
    readings in a row are below danger. Projections take an approved forecast, else the trend within the horizon.
    push: the first, or after the cooldown, or more severe than the last pushed. An alert ends after lasts_hours
    without a trigger, also if the gauge falls silent. Readings without a level are passed over. alert_id is a SHA-256
    of gauge, time, kind, severity, reason and push."""
    numbers = ["level_m", "trend_cm_per_hr", "danger_level_m", "highest_flood_level_m", "reference_peak_m", "forecast_level_m"]
    rows = _timed(readings, "observed_at", late, "observed_at").select("gauge_id", "observed_at", "_at", F.lit(0).alias("_id"), *[F.col(c).cast("double").alias(c) for c in numbers])
    schema = "gauge_id string, _at long, kind string, severity string, reason string, push boolean, suppressed boolean, expires long, alert_id string"
    out = _run(rows, ["gauge_id"], _Alerts(cooldown_hours * HOUR, lasts_hours * HOUR, horizon_hours), schema)
    return out.select("gauge_id", F.timestamp_micros("_at").alias("at"), "kind", "severity", "reason", "push", "suppressed", F.timestamp_micros("expires").alias("expires_at"), "alert_id")


class _Silence(_Keyed):
    """state: time of the last reading, and whether the gauge counts as silent."""

    state = "last long, silent boolean"

    def __init__(self, hours: float):
        self.wait = int(hours * HOUR)

    def due(self, s):
        return s[0] + self.wait if s and not s[1] else None

    def late(self, key, s, due):
        return (s[0], True), [Row(gauge_id=key[0], _at=due, status="no_data", last=s[0])]

    def row(self, key, s, r):
        back = [] if s and not s[1] else [Row(gauge_id=key[0], _at=r["_at"], status="fresh", last=r["_at"])]
        return (max(r["_at"], s[0] if s else r["_at"]), False), back


def silences(readings: DataFrame, hours: float = 6, late: str = "30 minutes") -> DataFrame:
    """(gauge_id, at, status, last_observed_at): when a gauge falls silent (no_data, so many hours after its last reading)
    and when it is heard (fresh). readings(gauge_id, observed_at), a stream."""
    rows = _timed(readings, "observed_at", late, "observed_at").select("gauge_id", "observed_at", "_at", F.lit(0).alias("_id"))
    out = _run(rows, ["gauge_id"], _Silence(hours), "gauge_id string, _at long, status string, last long")
    return out.select("gauge_id", F.timestamp_micros("_at").alias("at"), "status", F.timestamp_micros("last").alias("last_observed_at"))


class _Limits(StatefulProcessor):
    """Counters of fixed windows per key, as one JSON text that is read and written once per micro-batch; windows that lie
    two windows behind the watermark are dropped then, or by the key's one timer if it sends nothing more."""

    def __init__(self, limits: tuple[tuple[str, int, int], ...]):
        self.limits = limits

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "counts string")

    def _read(self) -> dict[str, dict[int, int]]:
        text = json.loads(self.held.get()[0]) if self.held.exists() else {}
        return {scope: {int(at): n for at, n in text.get(scope, {}).items()} for scope, _, _ in self.limits}

    def _write(self, counts: dict[str, dict[int, int]], now: int) -> None:
        span = {scope: 2 * seconds * 1_000_000 for scope, seconds, _ in self.limits}
        kept = {scope: {at: n for at, n in starts.items() if at + span[scope] > now} for scope, starts in counts.items()}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not any(kept.values()):
            self.held.clear()
            return
        self.held.update((json.dumps(kept),))
        self.handle.registerTimer(max(max(starts) + span[scope] for scope, starts in kept.items() if starts) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True)
        df = df.assign(_k=df["row_id"].str.rjust(20)).sort_values(["at_us", "_k"], kind="stable", ignore_index=True)
        over = df["over"].astype(object).where(df["over"].notna(), None).to_numpy(copy=True)
        counted = np.flatnonzero(df["over"].isna().to_numpy() & df["counts"].to_numpy(bool))
        if len(counted):
            held, at, refused = self._read(), df["at_us"].to_numpy(np.int64)[counted], np.full(len(counted), None, object)
            for scope, seconds, limit in self.limits:  # all are counted, also when one refuses
                starts, first, window, n = np.unique(at - at % (seconds * 1_000_000), return_index=True, return_inverse=True, return_counts=True)
                before = np.array([held[scope].get(x, 0) for x in starts.tolist()])
                beyond = before[window] + np.arange(len(at)) - first[window] + 1 > limit
                refused[beyond & pd.isna(refused)] = scope
                held[scope].update(zip(starts.tolist(), (before + n).tolist(), strict=True))
            over[counted] = refused
            self._write(held, timerValues.getCurrentWatermarkInMs() * 1000)
        yield df.drop(columns=["limit_key", "counts", "over", "_k"]).assign(over=over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._write(self._read(), expiredTimerInfo.getExpiryTimeInMs() * 1000)
        yield from ()

    def close(self) -> None:
        pass


# Scope, seconds of a window, events allowed in it.
EVENT_LIMITS = (("event_10m", 600, 30), ("event_day", 86_400, 200))
NETWORK_LIMITS = (("network_day", 86_400, 500),)
REPORT_LIMITS = (("report_10m", 600, 5), ("report_day", 86_400, 20))
RETRY_SECONDS = {"network_day": 3600}


def _limited(rows: DataFrame, key: Column, counts: Column, limits) -> DataFrame:
    """rows with over, the first scope whose limit a row passes. Only rows that are not over yet and that counts. A key's
    rows of one micro-batch are one frame; names with a leading underscore would be lost there."""
    keep = [c for c in rows.columns if c != "over"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "over") + ", over string"
    keyed = rows.select(*keep, "over", counts.alias("counts"), key.alias("limit_key")).groupBy("limit_key")
    return keyed.transformWithStateInPandas(_Limits(limits), schema, "Append", "EventTime", eventTimeColumnName="ts")


def rate_verdicts(events: DataFrame, late: str = "1 hour", event_limits=EVENT_LIMITS, network_limits=NETWORK_LIMITS, report_limits=REPORT_LIMITS) -> DataFrame:
    """(event_id, channel, subject_id, ts, allowed, over, retry_after): a verdict on every event by several limits at once.

    events(event_id, channel, subject_id, network, ts, is_report), a stream. Windows are fixed (ten minutes, UTC days).
    A subject's event counts in both its windows, also when one refuses it. What passes counts for its network, on the
    web channel and if the network is known; what passes that and is a report counts against the report limits. over
    names the first limit passed; retry_after is 0 where none is. Events without a time are left out."""
    rows = _timed(events, "ts", late, "event_id").select(F.col("_at").alias("at_us"), F.col("_id").cast("string").alias("row_id"), "channel", F.col("subject_id").cast("string").alias("subject_id"), "network", "ts", F.coalesce("is_report", F.lit(False)).alias("is_report"), F.lit(None).cast("string").alias("over"))
    subject = F.concat_ws("|", F.lit("s"), "channel", "subject_id")
    web = (F.col("channel") == "web") & F.col("network").isNotNull()
    one = _limited(rows, subject, F.lit(True), event_limits)
    two = _limited(one, F.when(web, F.concat_ws("|", F.lit("n"), "network")).otherwise(subject), F.coalesce(web, F.lit(False)), network_limits)
    three = _limited(two, subject, F.col("is_report"), report_limits)
    wait = F.when(F.col("over").isNull(), 0)
    for scope, seconds in RETRY_SECONDS.items():
        wait = wait.when(F.col("over") == scope, seconds)
    return three.select(F.col("row_id").alias("event_id"), "channel", "subject_id", "ts", F.col("over").isNull().alias("allowed"), "over", wait.otherwise(600).cast("int").alias("retry_after"))
