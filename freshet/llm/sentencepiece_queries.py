"""op3: the piece ids of all documents, and whether they decode to the text again; the same of the unigram form."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.llm.sentencepiece import BLOCK, UNIGRAM, Pieces, changed, encode

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def encoded(docs, keep_cols=(), pieces=None, block_bytes=BLOCK, collapse=False):
    """(doc_id, <keep_cols...>, n_pieces, piece_ids, decodes) of documents; nulls for a null text. A text that holds
    the space mark itself decodes to spaces there, as in the library, and is compared so."""
    out = encode(docs, pieces or Pieces.load(MODEL), keep_cols=keep_cols, verify=True, block_bytes=block_bytes, collapse=collapse)
    n = F.when(F.col("piece_ids").isNotNull(), F.size("piece_ids"))
    return out.select("doc_id", *keep_cols, n.alias("n_pieces"), "piece_ids", "decodes")


def op3_sentencepiece(spark, sf_dir):
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def unigram_pieces(spark, sf_dir):
    """The same vocabulary read as a unigram model: the fold is Viterbi over the pieces' scores."""
    pieces = Pieces.of(changed(Pieces.load(MODEL).model, kind=UNIGRAM))
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces=pieces)


QUERIES = {"op3_sentencepiece": op3_sentencepiece, "unigram_pieces": unigram_pieces}
ORACLES: dict[str, str] = {}
