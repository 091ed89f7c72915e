import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from freshet.llm import phrases
from freshet.llm.phrases import collocations
from freshet.llm.tries import Trie
from freshet.shared import keep


def brute(rows, least, longest=4, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(w)
            f.update((lang or "und", w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in found.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = [b for (other, x), b in found.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if all(100 * b < 80 * a for b in inside):
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:first])]
    return sorted(ranked)


def corpus():
    draw = random.Random(3)
    rows = [(" ".join(draw.choice("a b c D e É f g".split()) + draw.choice(["", "", ",", ".", "\t"]) for _ in range(60)), draw.choice(["en", "fr", None, "und"])) for _ in range(40)]
    rows += [("New York city new york CITY! new york", "en")] * 7 + [(None, "en"), ("", "fr"), (" ,. ", "de"), ("x " * 50, "x")]
    rows.append(("cut, here. " * 200_000 + "never " * 300_000, "cut"))
    rows.append((" ".join(draw.choice(["long", "text", "word"]) for _ in range(300_000)), "long"))
    return rows


def got(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).collect())


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "text string, lang string, word string, s1 int").repartition(5)
    want = brute(rows, 5)
    assert got(df, least=5) == want
    assert {r[0] for r in want} >= {"en", "fr", "und", "x", "long"}
    monkeypatch.setattr(phrases, "TRIE", 40)  # many tries
    assert got(df, least=5, first=3) == brute(rows, 5, first=3)


def test_setting_of_the_session_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    assert got(spark.createDataFrame([], "text string, lang string")) == []
    assert got(spark.createDataFrame([("a b", "en")], "text string, lang string")) == []
    assert spark.conf.get(name) == before


COUNTER = phrases._counter


def clashing(seed):
    """All words share a symbol under the first seed."""

    def run(batches):
        for b in COUNTER(seed)(batches):
            yield b.set_column(0, "s1", pa.array([7] * len(b))) if seed == 0 else b

    return run


def test_words_that_share_a_symbol_take_another_seed(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_counter", clashing)
    words, seed = phrases.word_counts(spark.createDataFrame([("en", "a b c")], "lang string, text string"))
    assert seed == 1 and words.count() == 3


@pytest.mark.parametrize("n", [1, 500, 20_000])
def test_trie_counts_like_a_dictionary(n):
    draw = np.random.default_rng(n)
    text = draw.zipf(1.3, 20_000).clip(max=3000).astype(np.uint64)
    runs = {tuple(text[i : i + m].tolist()) for i in draw.integers(0, len(text) - 4, n).tolist() for m in (2, 3, 4)[: 1 + i % 3]}
    runs = sorted(runs)
    trie = Trie.of(np.array([(*r, *[0] * (4 - len(r))) for r in runs], np.uint64))
    codes = trie.codes(text)
    codes[::97] = -1
    cut = np.where(codes < 0, np.uint64(0), text).tolist()
    want = Counter(tuple(cut[i : i + m]) for m in (2, 3, 4) for i in range(len(cut) - m + 1))
    assert trie.count(codes).tolist() == [want[r] for r in runs]


def test_trie_of_nothing():
    trie = Trie.of(np.zeros((0, 4), np.uint64))
    assert trie.count(trie.codes(np.array([1, 2], np.uint64))).tolist() == []


def test_runs_are_dealt_before_they_are_grouped(spark, monkeypatch):
    plans = []

    def kept(df, name):
        if name == "level":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(phrases, "keep", kept)
    phrases.collocations(spark.createDataFrame([("en", "a b c d. " * 40)], "lang string, text string")).collect()
    assert len(plans) == 3
    for plan in plans:
        above, _, below = plan.partition("Exchange hashpartitioning")
        assert "HashAggregate" in above and "MapInArrow" in below and "HashAggregate" not in below
