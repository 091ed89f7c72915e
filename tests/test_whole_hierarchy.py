from collections import defaultdict

from freshet.plans import registry
from freshet.plans.bindings import view

SF = "/root/testdata/sf0.001"


def test_every_pointer_is_followed(spark):
    best = {}
    for r in view(spark, SF, "v_revisions").where("publication_state <> 'quarantined'").collect():
        row = ((r["report_date"], r["fetched_at"], r["revision_id"]), r["metric"])
        best[r["entity_id"]] = max(best.get(r["entity_id"], row), row)
    got = {(r["entity_id"], r["revision_id"], r["metric"]) for r in registry.QUERIES["pointer_read_all"](spark, SF).collect()}
    assert got == {(e, at[2], m) for e, (at, m) in best.items()}
    assert any(e % 3 for e, _, _ in got)


def test_every_circle_is_verified(spark):
    parts = defaultdict(int)
    for r in view(spark, SF, "v_hierarchy").collect():
        parts[r["district"]] += 1
    got = {r["district"]: (r["parts"], r["verdict"]) for r in registry.QUERIES["checkpoint_verify_all"](spark, SF).collect()}
    assert got == {k: (n, "not_applicable" if k.endswith("7") else "fail" if k.endswith("3") else "pass") for k, n in parts.items()}
