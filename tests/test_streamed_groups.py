import hashlib
from datetime import datetime, timedelta

from freshet.operators import publication as p
from freshet.operators import reports as r
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().toString()


def test_cooldown_holds_no_group(spark):
    t = datetime(2024, 7, 1)
    rows = [(k % 3 or None, t + timedelta(minutes=97 * ((k * 7919) % 20_011)), k % 4, k) for k in range(20_000)]
    got = r.cooled_pushes(spark.createDataFrame(rows, "k int, at timestamp_ntz, severity int, event_id int"), "k", 6)
    assert "collect_list" not in plan(got)
    want = {}
    for k in (None, 1, 2):
        n = pushed = 0
        at, sev = None, -1
        for _, x, s, _ in sorted((y for y in rows if y[0] == k), key=lambda y: y[1:]):
            n += 1
            if at is None or x >= at + timedelta(hours=6) or s > sev:
                pushed, at, sev = pushed + 1, x, s
        want[k] = (n, pushed, at)
    assert {x["k"]: (x["events"], x["pushed"], x["last_push"]) for x in got.collect()} == want


def test_content_revision_holds_no_group(spark):
    got = p.content_revision(spark.range(30_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v")), ["k"], ["k", "v"])
    assert "collect_list" not in plan(got)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {(x["k"], x["rows"], x["revision"]) for x in got.collect()} == {(k, 15_000, sha("".join(sorted(sha(f"{k}|{v}") for v in range(k, 30_000, 2))))) for k in (0, 1)}
