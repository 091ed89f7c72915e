import corpus_pipeline


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    good = [(i, f"The water at station {i} rose slowly over the day and fell again in the evening, said the report number {i * 7} of {i}.", "en", f"s{i % 3}", 90) for i in range(60)]
    bad = [(100 + i, f"BUY!!! {i} NOW*** CASH$$$ {i * i} FREE### WIN%%%", "en", "s0", 40) for i in range(20)]
    docs = spark.createDataFrame([*good, *bad, (200, None, None, None, None), (201, "", "en", "s1", 0), (202, good[3][1], "en", "s1", 90)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 120)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = corpus_pipeline.keep(stage(spark, d, str(tmp_path)), "test")
        assert d.columns == corpus_pipeline.COLUMNS
        names[name] = {r["doc_id"] for r in d.collect()}
    assert names["language ID"] >= set(range(60)) and not names["language ID"] & {200, 201}
    assert names["quality classifier"] >= set(range(60)) and not names["quality classifier"] & set(range(100, 120))
    assert names["MinHash near-dedup"] == set(range(60))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["decodes"] and r["doc_id"] < 60 for r in out)
