import random

import pytest
from freshet.functions.similarity import token_set
from freshet.operators import match as m

WORDS = ["bor", "gaon", "majuli", "high", "lower", "primary", "school", "college", "girls", "no", "2", "bar", "gaun", "majoli"]


def brute(left, right):
    """The reference's law over all pairs of a block."""
    out = {}
    for i, name, village, block in left:
        scored = []
        if any(w in name for w in m.SCHOOL_WORDS):
            for rid, other, at, b in right:
                if b == block and b is not None:
                    agreed = bool(village and at and token_set(village, at) >= 90)
                    scored.append((-round(token_set(name, other) + (5 if agreed else 0), 6), rid, agreed))
        scored.sort()
        if not scored:
            out[i] = (None, None, False, False, "unverified")
            continue
        total, rid, agreed = -scored[0][0], scored[0][1], scored[0][2]
        close = len(scored) > 1 and round(total + scored[1][0], 6) <= 5
        raw = round(total - (5 if agreed else 0), 6)
        level = "unverified" if close else "high" if raw >= 92 and agreed else "medium" if raw >= 80 else "unverified"
        out[i] = (rid, raw, agreed, close, level)
    return out


def frames(spark, left, right):
    return spark.createDataFrame(left, "id int, name string, village string, block string"), spark.createDataFrame(right, "rid int, name string, village string, block string")


def result(df):
    return {r["id"]: (r["rid"], r["score"], r["village_match"], r["ambiguous"], r["confidence"]) for r in df.collect()}


@pytest.mark.parametrize("size", [7, 100])
def test_match_equals_all_pairs(spark, size):
    draw = random.Random(5)
    name = lambda: " ".join(draw.choices(WORDS, k=draw.randint(0, 4)))
    rows = lambda n: [(i, name(), draw.choice(["", None, "bor gaon", "bar gaon", "majuli"]), draw.choice(["d", "d", "e", None])) for i in range(n)]
    left, right = [*rows(150), (900, "bor school", "x", "only left")], rows(180)
    assert result(m.school_match(*frames(spark, left, right), "block", size=size)) == brute(left, right)


def test_village_settles_and_high_needs_it(spark):
    left = [(1, "bor lower primary school", "majuli", "d"), (2, "dhubri college", None, "e"), (3, "relief hall", "majuli", "d")]
    right = [(10, "bor lower primary school", "dhubri", "d"), (11, "bor lower primary schoel", "majuli", "d"), (12, "dhubri college", "x", "e")]
    got = result(m.school_match(*frames(spark, left, right), "block"))
    assert got == brute(left, right)
    assert got[2][4] == "medium" and got[3][4] == "unverified" and got[3][0] is None
    far = [(10, "bor lower primary scho", "dhubri", "d"), (11, "bor lower primary school", "majuli", "d")]
    assert result(m.school_match(*frames(spark, left[:1], far), "block"))[1][::4] == (11, "high")
