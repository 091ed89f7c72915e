"""op12: tokens of all documents."""

from __future__ import annotations

from freshet.llm.sentencepiece import Pieces
from freshet.llm.transducer import token_counts


def op12_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), Pieces.load(str(public_tokenizers.path("piece_bpe_32k.model"))))


QUERIES = {"op12_token_counts": op12_token_counts}
ORACLES: dict[str, str] = {}
