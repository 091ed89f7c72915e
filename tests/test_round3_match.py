import random

from freshet.functions import similarity as sim


def test_two_names_are_scored_once_for_all_their_villages(monkeypatch):
    """Ten names in forty villages on both sides: a hundred pairs of names, not 160,000 pairs of rows."""
    calls = []
    real = sim.token_set
    monkeypatch.setattr(sim, "token_set", lambda a, b: calls.append((a, b)) or real(a, b))
    rows = [(f"{w} school", f"v{v} place") for w in ("bor", "dhubri", "majuli", "high", "lower", "girls", "no", "bar", "gaun", "kali") for v in range(40)]
    got = sim.best_two(rows, rows)
    assert len(calls) <= 100 + 40 * 40
    assert all((105.0, True, k) in found for k, found in enumerate(got))


def test_best_two_are_those_of_all_pairs():
    draw = random.Random(9)
    words = ["bor", "gaon", "majuli", "high", "school", "no", "2", "xyz"]
    some = lambda n: [(" ".join(draw.choices(words, k=draw.randint(0, 3))), draw.choice(["", "bor gaon", "majuli"])) for _ in range(n)]
    for size in (0, 1, 2, 30):
        left, right = some(25), some(size)
        for (n, v), found in zip(left, sim.best_two(left, right, step=2), strict=True):
            totals = sorted((-sim.token_set(n, m) - (5.0 if v and w and sim.token_set(v, w) >= 90 else 0.0), i) for i, (m, w) in enumerate(right))
            cut = totals[min(1, len(totals) - 1)][0] if totals else 0
            assert sorted((-t, i) for t, _, i in found) == [(t, i) for t, i in totals if t <= cut]
