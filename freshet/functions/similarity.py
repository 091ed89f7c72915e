"""Token-set similarity, batched through Arrow: Spark has no indel ratio of its own."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b); two empty strings are equal."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set(a: str | None, b: str | None) -> float:
    """Best ratio among the common words and the common words with either rest; 0 if a side has no words."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, ra, rb = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not ra or not rb):
        return 100.0
    one, two = f"{both} {ra}".strip(), f"{both} {rb}".strip()
    found = [indel_ratio(one, two)]
    if both:
        found += [indel_ratio(both, one), indel_ratio(both, two)]
    return max(found)


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) for x, y in zip(a, b, strict=True)])


def _bag(names: list[str], letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """How often each letter occurs in the sorted distinct words of each name, and their length."""
    texts = [" ".join(sorted(set(n.split()))) for n in names]
    out = np.zeros((len(texts), len(letters)), np.int32)
    for i, t in enumerate(texts):
        for c, n in Counter(t).items():
            out[i, letters[c]] = n
    return out, np.array([len(t) for t in texts], np.int64)


@lru_cache(1 << 18)
def _pair(a: str, b: str) -> float:
    return token_set(a, b)


def best_two(left: list[tuple[str, str]], right: list[tuple[str, str]], bonus: float = 5.0, agree: float = 90.0, step: int = 16) -> list[list[tuple[float, bool, int]]]:
    """For each (name, village) of left, the two best of right as (score with bonus, villages agree, index), and all
    that tie with the second.

    A pair of distinct names is scored once, whatever the number of their villages; the villages only choose who gets the
    bonus. The ratio is bounded from above by the greater of 200 times the common letters over both lengths and of what the
    common words alone give (100 if one name has all words of the other). Names are scored from the highest bound down,
    until bound and bonus are below the second best of every village of the name."""
    if not right:
        return [[] for _ in left]
    names, at = np.unique(np.array([n for n, _ in right], object), return_inverse=True)
    towns, town = np.unique(np.array([v for _, v in right], object), return_inverse=True)
    names, rows_of = list(names), {}
    for k, (n, v) in enumerate(left):
        rows_of.setdefault(n, {}).setdefault(v, []).append(k)
    letters = {c: i for i, c in enumerate(sorted({c for n, _ in [*left, *right] for c in n} | {" "}))}
    mine = list(rows_of)
    bag_l, len_l = _bag(mine, letters)
    bag_r, len_r = _bag(names, letters)
    holds: dict[str, set[int]] = {}
    for i, n in enumerate(names):
        for word in set(n.split()):
            holds.setdefault(word, set()).add(i)
    n_words = np.array([len(set(n.split())) for n in names])
    same = {v: np.array([bool(v and x) and _pair(v, x) >= agree for x in towns]) for v in {x for _, x in left}}
    agrees = {v: hit[town] for v, hit in same.items()}
    out: list[list[tuple[float, bool, int]]] = [[] for _ in left]
    for k, name in enumerate(mine):
        scores = np.full(len(names), -np.inf)
        words = set(name.split())
        common, both = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for w in words:
            for i in holds.get(w, ()):
                common[i] += 1
                both[i] += len(w) + 1
        both = np.maximum(0, both - 1)
        letters_ = 200.0 * np.minimum(bag_r, bag_l[k]).sum(axis=1) / np.maximum(1, len_r + len_l[k])
        bound = np.maximum(letters_, 200.0 * both / np.maximum(1, both + np.minimum(len_r, len_l[k])))
        bound = np.where((common > 0) & ((common == len(words)) | (common == n_words)), 100.0, bound) + 1e-6
        later = np.argsort(-bound, kind="stable").tolist()
        plus = {v: bonus * agrees[v] for v in rows_of[name]}
        least = bonus if any(agrees[v].any() for v in plus) else 0.0

        def second(v: str, scores=scores, plus=plus) -> float:
            totals = scores[at] + plus[v]
            return float(np.partition(totals, -2)[-2]) if len(totals) > 1 else -np.inf

        while later:
            if bound[later[0]] + least < min(second(v) for v in plus):
                break
            for i in later[:step]:
                scores[i] = _pair(name, names[i])
            later = later[step:]
        for v, rows in rows_of[name].items():
            totals, hit = scores[at] + plus[v], agrees[v]
            found = [(float(totals[i]), bool(hit[i]), int(i)) for i in np.flatnonzero(totals >= max(second(v), 0.0))]
            for r in rows:
                out[r] = found
    return out
