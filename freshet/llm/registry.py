"""Queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from freshet.llm import ann_queries, classifier_queries, dedup_queries, fingerprint_queries, mixing_queries, phrase_queries, sentencepiece_queries, sharding_queries, token_queries, url_queries, warc_queries, whitening_queries

_MODULES = [ann_queries, url_queries, sentencepiece_queries, classifier_queries, mixing_queries, sharding_queries, fingerprint_queries, dedup_queries, warc_queries, phrase_queries, token_queries, whitening_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
