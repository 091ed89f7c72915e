import math
from collections import Counter

import numpy as np
import pytest
from freshet.llm import whitening
from freshet.llm.whitening import whiten
from freshet.llm.whitening_queries import op13_embedding_whitening

SF = "/root/testdata/sf0.001"


def brute(rows, components=16, counts=False):
    """The contract with whole numbers and numpy: ({id: [(component, deviation, |whitened|, explained)]}, n)."""
    fit, kept = Counter(), []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            x = tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)
            fit[x] += 1
            kept.append((i, x))
    xs = list(fit)
    w = np.array([fit[x] if counts else 1 for x in xs], float)
    n = int(w.sum())
    sums = [sum(x[j] * int(m) for x, m in zip(xs, w)) for j in range(len(xs[0]))]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in xs])
    cov = (centred * w[:, None]).T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = int((e[:components] > 1e-12 * e[0]).sum())
    white = dict(zip(xs, centred @ v[:, :k] / np.sqrt(e[:k])))
    out = []
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out += [(i, c + 1, n, deviation, white[x][c], e[c] / e.sum()) for c in range(k)]
    return out


def same(got, want):
    got = sorted((r.vec_id is None, r.vec_id or 0, r.component, r.deviation, abs(r.whitened), r.n, r.explained) for r in got)
    want = sorted((i is None, i or 0, c, d, abs(w), n, p) for i, c, n, d, w, p in want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-7, atol=1e-7)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = op13_embedding_whitening(spark, SF).collect()
    same(got, brute(rows))
    assert {c for c in Counter(r.component for r in got)} == set(range(1, 17))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-4


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, key string, n int").repartition(4)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_copies_nulls_and_odd_vectors(spark, weights):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(60, 5)).astype(np.float32) * [1, 2, 3, 0.5, 8]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1])]  # a hot group, repeats, null ids
    odd = [(1, None), (2, []), (3, [1.0, None, 1.0, 1.0, 1.0]), (4, [float("nan")] * 5), (5, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (6, [1.0, 2.0])]
    same(whiten(table(spark, rows + odd), components=3, weights=weights).collect(), brute(rows, 3, weights == "counts"))


def test_hot_groups_are_dealt_over_salts(spark):
    rows = [(i, [float(i % 2 == 0) * (i % 50), 1.0 * (i % 3)]) for i in range(600)]
    got = whiten(table(spark, rows)).collect()
    same(got, brute(rows))
    assert 1 / whitening.HOT >= 500


def test_few_vectors_and_wide_numbers(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # nothing varies
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]  # one component only
    same(whiten(table(spark, flat)).collect(), brute(flat))
    far = [(i, [float(i) * 2**22, float(i * i) * 2**16]) for i in range(6)]  # n x beyond what 64-bit products hold
    got = whiten(table(spark, far)).collect()
    want = brute(far)
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d if d < 1 << 63 else None) for i, _, _, d, _, _ in want}
    assert any(d >= 1 << 63 for _, _, _, d, _, _ in want) and any(1 << 53 < d < 1 << 63 for _, _, _, d, _, _ in want)
