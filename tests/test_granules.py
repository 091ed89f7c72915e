"""Granules by micro-batch: stored once, changes reported, wider cuts fetched again, repeated batches harmless."""

from datetime import datetime
from decimal import Decimal

from freshet.streaming import granules as g

SCHEMA = "run string, granule string, fetched_at timestamp_ntz, cell_id string, interval_start timestamp_ntz, rate_mm_h decimal(18,6)"


def rows(granule, hour, *rates, run="late"):
    return [(run, granule, datetime(2024, 1, 1, hour), f"C{i}", datetime(2024, 1, 1), Decimal(r)) for i, r in enumerate(rates) if r is not None]


def test_store_once_and_wider_cuts(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    cells = lambda *c: spark.createDataFrame([(x,) for x in c], "cell_id string")
    two, three = cells("C1", "C0", "C1"), cells("C0", "C1", "C2")

    def land(*parts):
        spark.createDataFrame([r for p in parts for r in p], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(wanted, checkpoint):
        g.store(spark.readStream.schema(SCHEMA).parquet(source), wanted, path, f"file://{tmp_path}/{checkpoint}").awaitTermination()

    def outcomes(wanted):
        d = g.cells_digest(wanted).first()[0]
        return sorted((r.granule, r.fetched_at.hour, r.outcome) for r in g.ledger(spark, path).where(f"digest = '{d}'").collect())

    def cut(wanted):
        return sorted((r.granule, r.cell_id, str(r.rate_mm_h.normalize())) for r in g.read_cuts(spark, path, wanted).collect())

    assert cut(two) == [] and g.ledger(spark, path).count() == 0
    land(rows("a", 1, "1", "2", "3"), rows("a", 2, "1", "2", "9"), rows("b", 1, "4", None, "5"), rows("b", 2, "7", None, "5"), rows("z", 1, None, None, "1"), [("late", None, datetime(2024, 1, 1), "C0", None, None)])
    run(two, "p")
    first = [("a", "C0", "1"), ("a", "C1", "2"), ("b", "C0", "4")]
    assert outcomes(two) == [("a", 1, "stored"), ("a", 2, "same"), ("b", 1, "stored"), ("b", 2, "changed")] and cut(two) == first
    run(two, "q")  # the batch is repeated under its own number
    assert outcomes(two) == [("a", 1, "stored"), ("a", 2, "same"), ("b", 1, "stored"), ("b", 2, "changed")] and cut(two) == first
    land(rows("a", 3, "1", "2", "3"), rows("a", 4, "0", "2"), rows("c", 3, "6"), rows("a", 3, "5", run="early"))
    run(two, "p")
    assert outcomes(two)[2:4] == [("a", 3, "same"), ("a", 3, "stored")] and ("a", 4, "changed") in outcomes(two) and cut(two) == sorted([*first, ("c", "C0", "6"), ("a", "C0", "5")])
    expected = spark.createDataFrame([("late", x) for x in "abcd"], "run string, granule string")
    assert [r.granule for r in g.missing(expected, spark, path, two).collect()] == ["d"] and g.missing(expected, spark, path, three).count() == 4
    run(three, "w")
    assert ("a", "C2", "3") in cut(three) and ("z", "C2", "1") in cut(three) and len(cut(two)) == 5
    assert ("a", 2, "changed") in outcomes(three)
