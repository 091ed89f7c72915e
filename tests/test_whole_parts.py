from collections import defaultdict

from freshet.operators import match as m
from freshet.plans import registry
from freshet.plans.bindings import table

SF = "/root/testdata/sf0.01"


def tiers(left, right):
    out = {}
    for i, n, b in left:
        named, same = sorted(r for r, x, _ in right if x == n), sorted(r for r, x, y in right if (x, y) == (n, b))
        state = "matched" if len(same) == 1 else "ambiguous" if same else "other_district" if len(named) == 1 else "ambiguous" if named else "unresolved"
        out[i] = (state, {"matched": same, "other_district": named}.get(state, [None])[0])
    return out


def test_all_parts_are_claimed_and_matched(spark):
    parts = [tuple(r) for r in table(spark, SF, "part").select("p_partkey", "p_name", "p_brand").collect()]
    owners = defaultdict(list)
    for _, n, b in parts:
        owners[n].append(b)
    got = {(r["k"], r["owner"], r["parts"]) for r in registry.QUERIES["unique_claimant_all"](spark, SF).collect()}
    assert got == {(n, b[0], len(b)) for n, b in owners.items() if len(set(b)) == 1}
    assert {r["id"]: (r["state"], r["rid"]) for r in registry.QUERIES["tiered_match_all"](spark, SF).collect()} == tiers(parts, parts)


def test_tiers_of_a_fixture(spark):
    left, right = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "x"), (5, "d", "x")], [(10, "a", "x"), (11, "a", "z"), (12, "b", "y"), (13, "d", "x"), (14, "d", "x")]
    got = m.tiered(spark.createDataFrame(left, "id int, n string, b string"), spark.createDataFrame(right, "rid int, n string, b string"), "n", "b")
    assert {r["id"]: (r["state"], r["rid"]) for r in got.collect()} == tiers(left, right)
