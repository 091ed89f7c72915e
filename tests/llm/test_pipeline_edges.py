import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "The water at station {0} rose slowly over the day and fell again in the evening, said the report number {0} of {0} to the town."


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_dedup_keeps_one_row_of_equal_texts(spark, tmp_path):
    rows = [(i, TEXT.format(i * 977), "en", "s", 1) for i in range(1, 6)] + [(1, TEXT.format(977), "en", "s", 1), (None, TEXT.format(977), "en", "s", 1), (None, TEXT.format(5), "en", "s", 1)]
    rows += [(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0)]
    docs = table(spark, tmp_path, rows)
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    texts = [r[1] for r in got if r[1]]
    assert len(texts) == len(set(texts)) == 6 and sorted(r[0] for r in got if r[1] and r[0]) == [1, 2, 3, 4, 5]
    assert sum(not r[1] for r in got) == 3


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2])
def test_stages_of_empty_tables_and_nulls(spark, tmp_path, rows):
    docs = table(spark, tmp_path, rows)
    for name, stage in corpus_pipeline.STAGES:
        wide = docs.selectExpr("*", "1 as judged", "2 as nth", "3 as block", "'x' as code")
        out = stage(spark, wide, str(tmp_path))
        assert out.count() <= 2 and (name == "SentencePiece" or out.columns == corpus_pipeline.COLUMNS)


def test_mixing_and_sentencepiece_of_one_long_text(spark, tmp_path):
    rows = [(1, "word " * 200_000, "en", "a", 1), (2, "other words", "en", None, 1), (2, "other words", "en", None, 1)]
    docs = table(spark, tmp_path, rows)
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.count() >= 3
    out = corpus_pipeline.sentencepiece(spark, docs, str(tmp_path)).collect()
    assert len(out) == 3 and all(r["decodes"] for r in out) and max(r["n_pieces"] for r in out) >= 200_000
