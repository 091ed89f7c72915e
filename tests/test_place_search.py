import random

import pytest
from freshet.operators import shapes as sh

NAMES = ["Dibrugarh", "Jorhat", "Sivasagar", "Sibsagar", "Guwahati", "Gauhati", "Bijoynagar", "Garhgaon", "Majuli", "Ouguri", "Zoo Road", "Kuckoo", "Śivasāgar", "অসম", "Dhubri", "Dubri Bazar"]
ASKED = ["garh", "Zorhat", "shivsagar", "gauhati", "vijoi", "a", "sh", "ug", "oo", "000", "", "অসম", "agarh", "dhubri", "qu", "nothing here"]


def rank(name, query):
    """The reference's rank."""
    (n, f, s), (qn, qf, qs) = sh.search_forms(name), sh.search_forms(query)
    if not qn:
        return None
    found = [n.startswith(qn), qn in n, f.startswith(qf), qf in f, len(qs) >= 3 and s.startswith(qs)]
    return found.index(True) if any(found) else None


@pytest.mark.parametrize("limit", [sh.BROADCAST_FORMS, 0])
def test_search_finds_what_brute_force_finds(spark, limit):
    draw = random.Random(3)
    names = NAMES + ["".join(draw.choice("abghjrsvyzo0") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    asked = ASKED + [n[draw.randint(0, 2) :][: draw.randint(1, 5)] for n in names[:60]]
    places = list(enumerate(names))
    got = sh.ranked_search(spark.createDataFrame([(q,) for q in asked], "q string"), spark.createDataFrame(places, "place_id long, name string"), 5, limit)
    want = set()
    for q in set(asked):
        met = sorted((r, len(n), n, i) for i, n in places if (r := rank(n, q)) is not None)
        want |= {(q, i, r, k + 1) for k, (r, _, _, i) in enumerate(met[:5])}
    assert {(r["q"], r["place_id"], r["rank"], r["place"]) for r in got.collect()} == want
    assert {("garh", 0, 1), ("Zorhat", 1, 2)} <= {w[:3] for w in want}


def test_old_blocking_loses_a_match_inside_a_name(spark):
    q, places = spark.createDataFrame([("garh",)], "q string"), spark.createDataFrame([(0, "Dibrugarh")], "place_id long, name string")
    assert sh.search(q, places, 3).count() == 0 and sh.ranked_search(q, places, 3).count() == 1
