import random
import re

import pytest
from freshet.llm.components import components
from freshet.llm.minhash import Threshold, near_duplicates, sketch
from freshet.llm.text import shingles


def brute(rows, k, part, whole):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus():
    draw = random.Random(5)
    rows, base = [], [f"w{draw.randrange(400)}" for _ in range(60)]
    for i in range(40):  # one group, each a few words from the base
        words = list(base)
        for _ in range(draw.randrange(4)):
            words[draw.randrange(60)] = f"x{draw.randrange(50)}"
        rows.append((100 + i, " ".join(words)))
    chain = [f"c{i}" for i in range(90)]  # neighbours are linked, ends are not
    rows += [(200 + i, " ".join(chain[3 * i : 3 * i + 60])) for i in range(10)]
    rows += [(300 + i, " ".join(f"r{draw.randrange(900)}" for _ in range(30))) for i in range(30)]
    rows += [(1, "Same Text here now"), (2, "same\ttext here\nNOW"), (3, None), (4, ""), (5, " \n "), (6, "one two"), (7, "two one"), (8, "One  two")]
    return rows


@pytest.mark.parametrize("k,part,whole", [(4, 80, 100), (5, 4, 5)])
def test_components_equal_brute_force(spark, k, part, whole):
    rows = corpus()
    df = spark.createDataFrame([(*r, "junk") for r in rows], "doc_id long, text string, n string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, limit=Threshold(part, whole, k)).collect()}
    assert got == brute(rows, k, part, whole)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_duplicates(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "None", True)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_sketch_fills_and_estimates():
    a, b = shingles(" ".join(f"w{i}" for i in range(500)), 1), shingles(" ".join(f"w{i}" for i in range(250, 750)), 1)
    assert abs((sketch(a) == sketch(b)).mean() - 1 / 3) < 0.15
    assert len(set(sketch(shingles("one", 1)).tolist())) == 128


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, **{200 + i: 100 for i in range(50)}}
