"""op7: fingerprints of all documents, of edited versions, and how alike they are."""

from __future__ import annotations

import hashlib

from freshet.llm.fingerprint import fingerprint, likeness, with_next

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The last third of the text replaced by the first as many code points of the text after it."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def compare(doc_id, text, after):
    changed = edited(text, after)
    own, other, following = fingerprint(text), fingerprint(changed), fingerprint(after)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": own,
        "edited_fingerprint": other, "near_edited": likeness(own, other), "near_next": likeness(own, following),
    }


def op7_document_fingerprints(spark, sf_dir):
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), compare, SCHEMA)


QUERIES = {"op7_document_fingerprints": op7_document_fingerprints}
ORACLES: dict[str, str] = {}
