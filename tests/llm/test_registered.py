"""The registered queries over the given tables, against brute force, held-out labels or what they must hold."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from freshet.llm import registry
from freshet.llm.sentencepiece_queries import MODEL

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")


def run(spark, name, sf_dir=SMALL):
    return registry.QUERIES[name](spark, sf_dir)


def documents(spark, sf_dir=SMALL):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("sf", ["0.001", "0.1"])  # below and above 1,024 rows
def test_op1_recall(spark, sf):
    d = f"/root/testdata/sf{sf}"
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.array(e.embedding.tolist(), dtype=np.float64), e.vec_id.to_numpy()
    got = run(spark, "op1_multiprobe_neighbours", d).toPandas()
    of = dict(zip(ids.tolist(), range(len(ids)), strict=True))
    hits = []
    for q, part in got.groupby("query_id"):
        score = x @ x[of[q]]
        score[of[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hits.append(len(best & set(part.vec_id)) / 20)
        assert np.allclose(part.sort_values("rank").score, [x[of[v]] @ x[of[q]] for v in part.sort_values("rank").vec_id], rtol=1e-9)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


def test_op3_ids_equal_the_library(spark):
    texts, library = documents(spark), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = run(spark, "op3_sentencepiece").collect()
    assert len(got) == len(texts)
    for r in got:
        assert texts[r["doc_id"]] is None or (r["piece_ids"] == library.encode(texts[r["doc_id"]]) and r["decodes"] and r["n_pieces"] == len(r["piece_ids"]))


def test_op4_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    got = run(spark, "op4_language_id", MIDDLE).collect()
    assert len(got) == len(lang) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert len(right) > 100 and np.mean(right) >= 0.97


def test_op10_held_out_quality(spark):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    got = run(spark, "op10_quality_classifier", MIDDLE).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    own = [(r["score"], r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    good, bad = [s for s, _, y in own if y == 1], [s for s, _, y in own if y == 0]
    assert len(own) > 50 and np.mean([p == y for _, p, y in own]) >= 0.9
    assert np.mean([a > b for a in good for b in bad]) >= 0.9


def test_op6_shards(spark):
    texts = documents(spark, MIDDLE)
    got = run(spark, "op6_consistent_hash_shards", MIDDLE).collect()
    load, slots, shards, weight = defaultdict(int), defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards[raw].add(r["shard"])
        weight[raw] += r["size"]
    mean = sum(load.values()) / 8
    assert len(got) == len(texts) and max(load.values()) <= 1.01 * mean and min(load.values()) >= 0.97 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for raw, s in shards.items() if weight[raw] <= mean / 2)


def test_op7_edits_and_likeness(spark):
    texts = documents(spark)
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in run(spark, "op7_document_fingerprints").collect()}
    by_text = defaultdict(set)
    for i, doc_id in enumerate(order):
        own, nxt = texts[doc_id] or "", texts[order[(i + 1) % len(order)]] or ""
        n = len(own) // 3
        edited = own[: len(own) - n] + nxt[:n]
        r = got[doc_id]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[own].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values()) and len(got) == len(texts)
    long = [r for r in got.values() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2


def test_op8_components_equal_brute_force(spark):
    lower = {i: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()) for i, t in documents(spark).items()}
    sets = {}
    for i, raw in lower.items():
        words = raw.split()
        words = [w for w in bytes(raw).translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]
        sets[i] = {tuple(words[j : j + 4]) for j in range(max(1, len(words) - 3))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op8_minhash_near_dedup").collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}
