import json
import random
import re

from freshet.operators import privacy

ROWS = [
    (1, json.dumps({"report_id": "9876543210", "where": {"lon": 91.1234, "lat": 26}, "notes": ["fine", {"said": "mail a@b.co"}]}), ["91.1234"]),
    (2, json.dumps({"Phone-Number": None, "a": {"house": {}}, "landmark": ["x 9876543210.", "+919876543210 19876543210"]}), None),
    (3, "{broken", None), (4, None, None), (5, "[]", ["1"]), (6, json.dumps({"ok": True, "n": 1, "t": "1"}), ["1", None]),
    (7, '{"a": 1, "a": 2}', None), (8, "[" * 40 + "]" * 40, None), (9, json.dumps('quote \\" [[[[ a@b.co'), None), (1, json.dumps({"x": ["", None]}), None),
]


def test_every_path_is_looked_at(spark):
    df = spark.createDataFrame(ROWS, "id int, j string, b array<string>")
    got = {tuple(r) for r in privacy.findings(df, "id", "j", df.b).collect()}
    assert got == {
        (1, "$.where.lon", "banned"), (1, "$.notes[1].said", "email"), (2, "$.Phone-Number", "field"), (2, "$.a.house", "field"), (2, "$.landmark[0]", "phone"),
        (3, "$", "unreadable"), (4, "$", "unreadable"), (6, "$.n", "banned"), (6, "$.t", "banned"), (7, "$", "unreadable"), (8, "$", "deep"), (9, "$", "email"),
    }
    out = {r.id: r.reasons for r in privacy.split(df, "id", privacy.findings(df, "id", "j", df.b)).collect()}
    assert out[5] is None and out[2] == ["field $.Phone-Number", "field $.a.house", "phone $.landmark[0]"]


def test_empty_table(spark):
    assert privacy.findings(spark.createDataFrame([], "id int, j string"), "id", "j").count() == 0


def test_equals_a_recursive_walk(spark):
    rng = random.Random(3)

    def tree(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            return {rng.choice(["a", "b", "device_id", "gauge_id", "note", "E-Mail"]): tree(depth - 1) for _ in range(rng.randrange(4))}
        if depth and kind < 0.7:
            return [tree(depth - 1) for _ in range(rng.randrange(4))]
        return rng.choice([None, True, 1, 2.5, "2.5", "", "plain", "9123456789", "o@p.q"])

    def walk(v, path, key, out):
        if isinstance(v, dict):
            for k, x in v.items():
                if k.lower().replace("-", "").replace("_", "") in {p.replace("_", "") for p in privacy.PII_KEYS}:
                    out.add((f"{path}.{k}", "field"))
                walk(x, f"{path}.{k}", k, out)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", key, out)
        elif isinstance(v, str):
            if (key or "").replace("_", "") not in privacy.UNSCANNED_KEYS:
                out |= {(path, n) for n, p in (("email", privacy.EMAIL), ("phone", privacy.PHONE)) if re.search(p, v)}
            if v == "2.5":
                out.add((path, "banned"))
        elif not isinstance(v, bool) and v == 2.5:
            out.add((path, "banned"))

    trees = [tree(5) for _ in range(300)]
    want = set()
    for i, t in enumerate(trees):
        out = set()
        walk(t, "$", None, out)
        want |= {(i, *o) for o in out}
    df = spark.createDataFrame([(i, json.dumps(t), ["2.5"]) for i, t in enumerate(trees)], "id int, j string, b array<string>")
    assert {tuple(r) for r in privacy.findings(df, "id", "j", df.b).collect()} == want and len(want) > 100
