import numpy as np
from freshet.llm.ann import Settings, nearest, probes


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        score = sorted((-float(np.sum(np.array(v) * np.array(w))), i) for i, w in rows if i != q)
        out[q] = [i for _, i in score[:k]]
    return out


def test_recall_with_a_hot_bucket_and_uneven_norms(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(3000, 16)) * g.uniform(0.5, 2, (3000, 1))
    x[:1000] = x[0] + g.normal(size=(1000, 16)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, key string")
    got = nearest(df, "pmod(id, 20) = 0", settings=Settings(bucket=128)).toPandas()
    want = exact(rows, rows[::20], 20)
    hit = [len(set(want[q]) & set(p.vec_id)) / 20 for q, p in got.groupby("query_id")]
    assert len(hit) == 150 and np.mean(hit) >= 0.9
    assert (got.groupby("query_id")["rank"].max() == 20).all()


def test_small_tables_are_exact_with_ties_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 0.0])]
    odd = [(40, None), (60, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows + odd + [(3, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = nearest(df, "pmod(id, 20) = 0", k=3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0)]
    assert nearest(df.limit(0), "pmod(id, 20) = 0").collect() == []
    assert nearest(df.where("vec_id = 40"), "pmod(id, 20) = 0").collect() == []


def test_probes_come_in_order_of_success():
    p = np.array([0.1, 0.5, 2.8])
    cells = probes(p, 27)
    cost = [sum(0 if c == f else ((x - f) ** 2 if c < f else (f + 1 - x) ** 2) for c, f, x in zip(cell, np.floor(p), p, strict=True)) for cell in cells]
    assert len({tuple(c) for c in cells}) == 27 and cost == sorted(cost) and cost[0] == 0
