"""From raw documents to piece ids: five stages, each written as Parquet and read again as the next one's input.

Every stage reads the columns of documents only, so others cannot clash, and gives an empty table for an empty one.
Its docstring says what it does with nulls, empty texts and repeated rows. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.llm import langid, quality
from freshet.llm.classifier_queries import language_model, quality_model
from freshet.llm.minhash import near_duplicates
from freshet.llm.mixing import count_words, emit
from freshet.llm.sentencepiece_queries import encoded
from freshet.shared import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected as no language if the filter of its best language holds fewer of its n-grams than this part.
LEAST_HITS = 0.35
LEAST_QUALITY = 0.3
#: Bytes of text that one task encodes at a time; executors that ran the stages before have less memory left.
BLOCK_BYTES = 2 << 20


def language_id(spark, docs, sf_dir):
    """Texts without letters, and those whose n-grams are hardly known in any language, go.

    Null and empty texts have no letter and go. Null ids and repeated rows are judged like any others, by text alone;
    languages that tie are told apart by code point. With no language in docs nothing can be judged and all go."""
    got = langid.predict(docs.select(*COLUMNS), language_model(docs))
    return got.where((F.col("lang_pred") != "und") & (F.col("lang_hits") >= LEAST_HITS)).select(*COLUMNS)


def quality_classifier(spark, docs, sf_dir):
    """Texts that are scored below LEAST_QUALITY go.

    Null and empty texts are scored like others, on their structure alone; null ids and repeated rows by text alone. A
    score equal to the limit stays. Without labels every score is one half and all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs.select(*COLUMNS), quality_model(docs, labels)).where(F.col("quality_score") >= LEAST_QUALITY).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Of each component of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays.

    One row of it: where an id is null or repeated, rows are numbered, and of rows with the smallest id one stays, ids
    before nulls. Texts that are null or have no word are linked with nothing and stay. Ids decide ties."""
    d = docs.select(*COLUMNS)
    if d.where("doc_id is null").isEmpty() and d.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = near_duplicates(d).where("not kept").select("doc_id").distinct()
        return d.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    rows = keep(d.withColumn("nth", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, id_col="nth").select("nth", "component_id").join(rows.select("nth", "doc_id"), "nth")
    stays = found.groupBy("component_id").agg(F.min_by("nth", F.struct(F.col("doc_id").isNull(), "doc_id", "nth")).alias("nth"))
    return rows.join(stays, "nth", "left_semi").select(*COLUMNS)


def mixing(spark, docs, sf_dir):
    """Documents are repeated or left out so that sources come near their target shares.

    A null source is a source of its own. Null and empty texts have no words; they are repeated like others of their
    source. Null ids and repeated rows are drawn like any others. Reruns agree."""
    return emit(docs.select(*COLUMNS), count_words(F.col("text")))


def sentencepiece(spark, docs, sf_dir):
    """Piece ids of every text, and whether they decode to it again.

    Null text: nulls. Empty text: no ids. Null ids and repeated rows are encoded like any others; the copies that mixing
    puts next to each other are encoded once."""
    return encoded(docs, ("lang", "source"), block_bytes=BLOCK_BYTES, collapse=True)


STAGES = [
    ("language ID", language_id), ("quality classifier", quality_classifier), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("SentencePiece", sentencepiece),
]


def run(spark, sf_dir):
    """The stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "stage")
    return docs


ORACLE_SQL = None
