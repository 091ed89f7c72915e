"""op4 and op10: language and quality of every document, learned on a fixed part of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.llm import langid, quality


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(True))


def language_model(docs):
    return langid.fit(docs.select("doc_id", "text", "lang").where(~held_out()))


def quality_model(docs, labels):
    """Labels of one document that contradict each other are not used."""
    clear = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    return quality.fit(docs.select("doc_id", "text").where(~held_out()).join(clear.select("doc_id", "label"), "doc_id"))


def op4_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.predict(docs.select("doc_id", "text"), language_model(docs))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_hits").alias("hits"))


def op10_quality_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs.select("doc_id", "text"), quality_model(docs, labels))
    score = F.col("quality_score")
    return got.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_language_id": op4_language_id, "op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
