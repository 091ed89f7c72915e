import json
from datetime import datetime, timedelta

import pytest
from freshet.sources import files
from freshet.streaming import operators as s
from pyspark.sql import functions as F

T0 = datetime(2024, 7, 1)


def stream(spark, tmp_path, batches, schema):
    path = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(out, tmp_path, mode="append"):
    name = "q" + tmp_path.name.replace("-", "_")
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name).collect()


def test_first_write_wins_within_the_watermark(spark, tmp_path):
    b = [[("a", T0, 1.0), ("a", T0 + timedelta(hours=1), 2.0)], [("a", T0, 9.0), ("b", T0, 3.0)]]
    got = drained(s.first_writes(stream(spark, tmp_path, b, "gauge_id string, observed_at timestamp, level_m double"), ["gauge_id", "observed_at"]), tmp_path)
    assert len(got) == 3 and {r["gauge_id"] for r in got} == {"a", "b"}


def test_alert_memory_across_batches(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    b = [[("a", at(0), 1), ("a", at(2), 1)], [("a", at(3), 2), ("a", at(5), 2)], [("a", at(10), 2)]]
    out = s.alert_states(stream(spark, tmp_path, b, "gauge_id string, observed_at timestamp, severity int").withWatermark("observed_at", "1 hour"))
    got = sorted((r["pushed_at"], r["severity"]) for r in drained(out, tmp_path))
    assert [(t.hour, v) for t, v in got] == [(0, 1), (3, 2), (10, 2)]


def test_appended_keys_are_not_written_again(spark, tmp_path):
    b = [[("a", T0, 1.0, 1)], [("a", T0, 2.0, 2), ("b", T0, 3.0, 3)]]
    src = stream(spark, tmp_path, b, "gauge_id string, observed_at timestamp, level_m double, n int")
    s.append_to(src, str(tmp_path / "out"), str(tmp_path / "cp"), ["gauge_id", "observed_at"], lambda: [F.col("n")]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("gauge_id").count().collect()
    assert {r["gauge_id"]: r["count"] for r in got} == {"a": 1, "b": 1}


def test_trailing_totals_refuse_gaps(spark, tmp_path):
    rows = [("c", T0 + timedelta(minutes=30 * i), 2.0) for i in range(8) if i != 5] + [("c", T0 + timedelta(days=2), 0.0)]
    got = drained(s.trailing_totals(stream(spark, tmp_path, [rows, [("c", T0 + timedelta(days=4), 0.0)]], "cell_id string, interval_start timestamp, rate_mm_h double"), hours=1), tmp_path)
    whole = {r["as_of"]: r["total_mm"] for r in got if r["total_mm"] is not None}
    assert set(whole.values()) == {2.0} and len(whole) == 5


def test_series_quarantine(spark, tmp_path):
    lines = [json.dumps({"gauge_id": "a", "level_m": 1.5, "observed_at": "2024-07-01T10:00:00+05:30"}), "{broken", json.dumps({"gauge_id": "a", "level_m": 2.0, "observed_at": "soon"})]
    (tmp_path / "x.json").write_text("\n".join(lines))
    good, bad = files.series(spark, str(tmp_path))
    assert [r["level_m"] for r in good.collect()] == [1.5] and bad.count() == 2


def test_csv_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gauge_id,observed_at,level_m\na,2024-07-01 10:00:00,1.5\na,never,2\na,2024-07-01 11:00:00,x\n")
    assert files.gauge_csv(spark, str(tmp_path / "a.csv")).count() == 1
    (tmp_path / "b.csv").write_text("gauge_id,level_m\na,1\n")
    with pytest.raises(ValueError, match="observed_at"):
        files.gauge_csv(spark, str(tmp_path / "b.csv"))


def test_inbox_and_grid_files(spark, tmp_path):
    inbox, grid = tmp_path / "inbox", tmp_path / "grid"
    inbox.mkdir(), grid.mkdir()
    (inbox / "a.json").write_text('{"record_type": "report", "x": 1}')
    (inbox / "b.json").write_text('{"submissions": [{"record_type": "report"}, {"record_type": "odd"}]}')
    (inbox / "c.json").write_text("")
    got = {(r["file"], r["accepted"]) for r in files.inbox(spark, str(inbox), ("report",)).collect()}
    assert got == {("a.json", True), ("b.json", False)}
    (grid / "g.txt").write_text("lon, 90.0, 90.1\nlat, 25.0, 25.1\n1.0, -9999.9\n2.0, 3.0\n")
    (grid / "h.txt").write_text("lon, 90.0, 90.1\nlat, 25.0\n1.0\n")
    cells = sorted((r["lon"], r["lat"], r["rate"]) for r in files.grid_text(spark, str(grid)).collect())
    assert cells == [(90.0, 25.0, 1.0), (90.0, 25.1, 2.0), (90.1, 25.0, None), (90.1, 25.1, 3.0)]


def test_grid_rows_and_axes_have_no_limit(spark, tmp_path):
    n = 100_100
    lines = ["lon, 90.0", "lat, " + ", ".join(str(i / 1000) for i in range(n)), *("1.5" for _ in range(n))]
    (tmp_path / "g.txt").write_text("\n".join(lines))
    (tmp_path / "short.txt").write_text("lon")
    (tmp_path / "empty.txt").write_text("")
    assert files.grid_text(spark, str(tmp_path)).agg(F.count("*"), F.max("lat")).first() == (n, (n - 1) / 1000)
