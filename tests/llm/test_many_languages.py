from freshet.llm import langid


def test_seventy_languages_are_learned_and_told_apart(spark):
    rows = [(f"{i}-{k}", " ".join([chr(0x4E00 + 3 * i) + chr(0x4E01 + 3 * i) + chr(0x4E02 + 3 * i)] * (k + 3)), f"l{i:02d}") for i in range(70) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = langid.fit(docs, langid.Settings(cells=1 << 16))
    assert len(model.langs) == 70 and model.cells.shape[0] == 2
    assert langid.predict(docs, model).where("lang_pred <> lang").count() == 0
