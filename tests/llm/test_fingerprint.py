import random

import pytest
from freshet.llm.fingerprint import _common, fingerprint, fingerprints, likeness, with_next
from freshet.llm.fingerprint_queries import SCHEMA, compare, edited


def test_common_subsequence_by_table():
    draw = random.Random(2)
    for _ in range(60):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randrange(1, 30))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert _common(a, b) == t[-1][-1]


@pytest.mark.parametrize("size", [1, 20, 200, 3000, 80_000])
def test_edits_stay_near_and_others_do_not(size):
    draw = random.Random(size)
    a, b = ("".join(draw.choice("abcdefgh ijk\n") for _ in range(size)) for _ in range(2))
    assert likeness(fingerprint(a), fingerprint(a)) == 1
    assert size < 20 or likeness(fingerprint(a), fingerprint(edited(a, b))) > 0.5
    assert size < 20 or likeness(fingerprint(a), fingerprint(b)) < 0.3


def test_odd_texts():
    assert fingerprint(None) == fingerprint("") == "1::"
    assert likeness(fingerprint(""), fingerprint("x")) == 0
    assert len(fingerprint("a" * 100_000)) < 150


def test_next_rows_equal_brute_force(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(10**9) if i % 3 else i, "".join(draw.choice("xyz ") for _ in range(draw.randrange(60))), "q") for i in range(300)]
    rows = list({r[0]: r for r in rows}.values()) + [(10**12, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, group string").repartition(6)
    order = sorted(rows, reverse=True)
    want = [compare(r[0], r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)]
    got = [r.asDict() for r in with_next(df, compare, SCHEMA, rows=20).collect()]
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(want, key=lambda r: r["doc_id"])
    assert with_next(df.limit(0), compare, SCHEMA).collect() == []
    alone = with_next(df.where("doc_id = 1000000000000"), compare, SCHEMA).collect()
    assert [(r["n_chars"], r["near_next"]) for r in alone] == [(0, 1.0)]
    twice = spark.createDataFrame([(1, "same text", "q")] * 3 + [(None, "n", "q")], df.schema)
    assert len(with_next(twice, compare, SCHEMA).collect()) == 4


def test_fingerprint_column(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints(df).collect()}
    assert got[1] == got[2] == fingerprint("same") and got[3] == "1::"
