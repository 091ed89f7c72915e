import random
from datetime import datetime, timedelta

from freshet.functions import text as t
from freshet.functions.similarity import token_set
from freshet.operators import match as m
from freshet.operators import reports as r
from pyspark.sql import functions as F

T0 = datetime(2024, 7, 1)


def test_contradictions_across_a_bucket_border(spark):
    rows = [(1, T0 + timedelta(minutes=29), "dry", 90.0001, 26.0), (2, T0 + timedelta(minutes=31), "knee", 90.0, 26.0), (3, T0 + timedelta(minutes=90), "knee", 90.0, 26.0), (4, T0 + timedelta(minutes=30), "dry", 90.01, 26.0)]
    df = spark.createDataFrame(rows, "report_id long, submitted_at timestamp_ntz, depth_class string, lon double, lat double")
    assert {x["report_id"] for x in r.flagged(df).where("contradicted").collect()} == {1, 2}


def test_cooldown_counts_from_the_last_push(spark):
    rows = [("a", T0 + timedelta(hours=h), s, i) for i, (h, s) in enumerate([(0, 1), (4, 1), (5, 2), (10, 2), (11, 2)])]
    got = r.cooled_pushes(spark.createDataFrame(rows, "k string, at timestamp_ntz, severity int, event_id int"), "k", 6).first()
    assert (got["events"], got["pushed"], got["last_push"]) == (5, 3, T0 + timedelta(hours=11))


def test_claims_of_two_owners_are_dropped(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 1)], "k string, o int")
    assert [tuple(x) for x in m.unique_claims(df, "k", "o").collect()] == [("y", 1), ("y", 1)]


def test_runner_up_makes_a_match_ambiguous(spark):
    left = spark.createDataFrame([(1, "bor lp school", "d"), (2, "majuli high school", "d"), (3, "alone", "e")], "id int, name string, block string")
    right = spark.createDataFrame([(10, "bor lp school a", "d"), (11, "bor lp school b", "d"), (12, "majuli high school", "d")], "rid int, name string, block string")
    got = {x["id"]: (x["rid"], x["confidence"]) for x in m.fuzzy(left, right, "block").collect()}
    assert got[1][1] == "ambiguous" and got[2] == (12, "high") and got[3] == (None, "unverified")


def test_token_sets():
    assert token_set("a b", "b a c") == 100 and token_set("", "a") == 0 and token_set("abc", "abd") < 100


def test_text_functions(spark):
    df = spark.createDataFrame([("  Dhubri-Town! ", "Mayong (12), Bor Gaon (3)", "98640 12345 / 0361-2234567, x", [1.0, 2.0, 3.0, 6.0])], "a string, b string, c string, d array<double>")
    got = df.select(t.slug(F.col("a")).alias("s"), t.bracket_pairs(F.col("b")).alias("b"), t.phones(F.col("c")).alias("p"), t.first_sum(F.col("d")).alias("i")).first()
    assert got["s"] == "dhubri_town" and [tuple(x) for x in got["b"]] == [("Mayong", "12"), ("Bor Gaon", "3")]
    assert got["p"] == ["9864012345", "03612234567"] and got["i"] == 1
    none = spark.createDataFrame([("--", None, None, [1.0])], df.schema).select(t.slug(F.col("a")), t.first_sum(F.col("d"))).first()
    assert tuple(none) == ("unknown", None)


def test_flags_equal_pairs_without_making_them(spark):
    rng = random.Random(5)
    rows = [(i, 91.0 + rng.randrange(3) / 1000, 26.0, start + timedelta(microseconds=rng.randrange(4 * 3600) * 10**6 + rng.choice([0, 500_000])), rng.choice(["dry", "dry", "knee", None])) for i, start in enumerate([datetime(2024, 1, 1)] * 300)]
    rows += [(300, 95.0, 26.0, datetime(2024, 1, 1, 0, 0), "dry"), (301, 95.0, 26.0, datetime(2024, 1, 1, 0, 30), "knee"), (302, None, 26.0, datetime(2024, 1, 1), "dry"), (303, None, 26.0, datetime(2024, 1, 1), "knee"), (304, 95.0, 26.0, None, "knee")]
    df = spark.createDataFrame(rows, "report_id int, lon double, lat double, submitted_at timestamp_ntz, depth_class string")
    for minutes in (30, 5):
        want = {x for pair in r.contradictions(df, minutes).collect() for x in pair}
        got = r.flagged(df, minutes)
        assert got.columns == [*df.columns, "contradicted"] and got.count() == len(rows)
        assert {x["report_id"] for x in got.where("contradicted").collect()} == want and (minutes == 5 or {300, 301} <= want)
