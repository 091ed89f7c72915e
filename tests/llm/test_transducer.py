import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from freshet.llm import transducer
from freshet.llm.sentencepiece import BPE, MARK, Pieces
from freshet.llm.token_queries import op12_token_counts
from freshet.llm.transducer import Transducer, token_counts

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"


def library(texts):
    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=MODEL).encode([t or "" for t in texts], num_threads=1)]


def odd_texts():
    draw = random.Random(2)
    return [
        None, "", " ", "   ", "a" * 5000, "ab" * 3000, "\n\n\t x", f"{MARK}a {MARK}", "日本語テキスト" * 50, "🎉🎉 é́", "<s> </s><unk> <0x0A>",
        "".join(chr(draw.randrange(32, 0x3000)) for _ in range(3000)), "".join(draw.choice("abcdefgh0123=/+") for _ in range(20_000)), "\x00a\x00",
        "x" * 49 + " " + "y" * 48, "\r\n", " lead", "trail ", "word " * 300_000, "".join(draw.choice("ab") for _ in range(600_000)),
    ]


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(MODEL)


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op12_token_counts(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for (i, text), n in zip(docs.items(), library(docs.values()), strict=True):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 4096)


def test_odd_texts_nulls_repeats_and_clashing_names(spark, pieces):
    texts = odd_texts()
    rows = [(None if i % 5 == 0 else i // 2, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, _text int").repartition(3)
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts(df, pieces).collect())
    assert got == sorted((len((t or "").encode()), n) for t, n in zip(texts, library(texts), strict=True))
    assert token_counts(df.limit(0), pieces).collect() == []


@pytest.mark.parametrize("chunk, states", [(1, 200_000), (3, 40), (48, 40)])
def test_chunks_of_any_size_and_compiling_anew(pieces, monkeypatch, chunk, states):
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    monkeypatch.setattr(transducer, "STATES", states)
    texts = [t for t in odd_texts() if len(t or "") < 30_000]
    machine = Transducer(pieces)
    for _ in range(2):
        assert machine.count(texts).tolist() == library(texts)


def naive(text, rank):
    x = list(MARK + text.replace(" ", MARK)) if text else []
    while True:
        merges = [(rank[a + b], i) for i, (a, b) in enumerate(zip(x, x[1:])) if a + b in rank]
        if not merges:
            return sum(1 if t in rank else len(t.encode()) for t in x)
        i = min(merges)[1]
        x[i : i + 2] = [x[i] + x[i + 1]]


@pytest.mark.parametrize("seed", range(40))
def test_any_vocabulary_equals_merging_by_rank(seed):
    """Also pieces that no merges build, characters that are no pieces, and pieces of one rank."""
    draw = random.Random(seed)
    letters = f"abcé{MARK}"
    held = {"".join(draw.choice(letters) for _ in range(draw.randrange(1, 6))) for _ in range(draw.randrange(3, 40))}
    rows = [(x, i, -float(draw.randrange(30))) for i, x in enumerate(sorted(held))]
    p = Pieces(b"", BPE, rows, 0, list(range(1000, 1256)), True, False)
    texts = ["".join(draw.choice("aabcé d") for _ in range(draw.randrange(0, 40))) for _ in range(60)]
    rank = {x: -s for x, _, s in rows}
    assert Transducer(p).count(texts).tolist() == [naive(t, rank) for t in texts]


def test_models_without_byte_pieces_are_refused(pieces):
    with pytest.raises(ValueError):
        Transducer(Pieces(b"", BPE, pieces.rows, 0, [], True, False))


def test_one_table_grows_with_many_keys(pieces):
    machine = Transducer(pieces)
    keys = np.arange(0, 400_000, 2)
    for part in np.array_split(keys, 7):
        machine._put(part, (part % 1000).astype(np.int32), (part % 50).astype(np.int16))
    slot = machine._find(keys)
    assert (machine.keys[slot] == keys).all() and (machine.next[slot] == keys % 1000).all() and (machine.gain[slot] == keys % 50).all()
    assert (machine.keys[machine._find(keys + 1)] < 0).all()
