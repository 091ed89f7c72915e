from freshet.llm import langid, quality
from pyspark.sql import functions as F

EN = "the river is high and the road near the old bridge was closed in the night by the police"
DE = "der fluss ist hoch und die strasse bei der alten bruecke wurde in der nacht von der polizei gesperrt"


def docs(spark):
    rows = [(i, " ".join((EN if i % 2 else DE).split()[i % 5 :]), "en" if i % 2 else "de", "x") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_language_of_held_out_and_odd_texts(spark):
    model = langid.fit(docs(spark))
    odd = spark.createDataFrame([(1, "the bridge was closed"), (2, "die alte bruecke"), (3, None), (4, ""), (5, "123 !?"), (6, "漢字"), (1, "the bridge was closed"), (7, EN * 2000)], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect()]
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (1, "en"), (7, "en")]
    scores = [r["lang_score"] for r in langid.predict(docs(spark), model).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_nothing_learned_gives_und(spark):
    model = langid.fit(docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(docs(spark), model).collect()} == {"und"}
    assert langid.predict(docs(spark).limit(0), model).collect() == []


def test_false_positives_are_corrected():
    import numpy as np

    own = langid.Settings(cells=1 << 16, hashes=1)
    text = " ".join(f"{a}{b}{c}" for a in "abcdef" for b in "ghijkl" for c in "mnopqr")
    cells = (np.random.default_rng(0).random(1 << 16) < 0.8).astype(np.int64) * 2
    known = langid._slots(langid.ngrams(text, own.sizes)[::2], own)[0]
    cells[known] |= 1
    model = langid.Model(["a", "b"], cells, own, np.array([len(known) / (1 << 16), 0.8]))
    assert langid.judge([text], model)[0] == ["a"]


def labelled(spark):
    good = [(i, f"A plain line about water number {i}, and nothing else.", 1) for i in range(80)]
    bad = [(100 + i, f"BUY!!! NOW $$$ {i} ### FREE*** CLICK%%%", 0) for i in range(20)]
    return spark.createDataFrame(good + bad, "doc_id long, text string, label int")


def test_quality_learns_and_scores_odd_texts(spark):
    rows = labelled(spark)
    model = quality.fit(rows)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(rows, model).collect()}
    assert all((got[i] >= 0.3) == (i < 100) for i in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000), (3, "x " * 100_000)], "doc_id long, text string")
    some = [r["quality_score"] for r in quality.score(odd, model).collect()]
    assert all(0 <= s <= 1 for s in some) and some[0] == some[1] and some[2] == some[3]


def test_quality_without_labels(spark):
    model = quality.fit(labelled(spark).withColumn("label", F.lit(None).cast("int")))
    assert {r["quality_score"] for r in quality.score(labelled(spark), model).collect()} == {0.5}


def test_sum_of_squares_identity():
    import numpy as np

    g = np.random.default_rng(0)
    x, w, v = g.normal(size=(3, 6)), g.normal(size=6), g.normal(size=(6, 2))
    m = quality.Model(0.3, w, v, quality.Settings())
    pairs = [0.3 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(quality.raw_scores(x, m), pairs)
