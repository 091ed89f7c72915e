import random
import struct

import pytest
import sentencepiece
from freshet.llm import sentencepiece as module
from freshet.llm.sentencepiece import BPE, UNIGRAM, Pieces, _fields, _needed, changed, decode, encode
from freshet.llm.sentencepiece_queries import MODEL

TEXTS = [
    "The river rose by two metres.", " a  b   c ", "line one\nline  two\n\n", "", "tab\there", "naïve café 漢字 😀 \u0301", "x" * 200, "a" * 60 + " b", "    " * 9 + "deep", "ends with space ", "\n", "UPPER lower 123,456.78",
    "=" * 63, "ab" * 700 + " tail", " " * 37 + "x", "thththe" * 20, "word " * 30_000, "a" * 5000 + " end", "one\x01two\x01\x01",
]


def rows(spark):
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choice("etaoin shrdlu\nßé.,") for _ in range(draw.randrange(1, 200))) for _ in range(60)]
    return texts, spark.createDataFrame([*((i, t, "z") for i, t in enumerate(texts)), (None, "null id", "z"), (999, None, "z"), (0, texts[0], "z")], "doc_id long, text string, code string")


def with_moderate_scores(model):
    """Scores of at least -40000: beside -1e9 the library's 32-bit sums are not exact."""

    def moderate(piece):
        return b"".join(piece[s:v] + struct.pack("<f", max(-40_000, struct.unpack("<f", piece[v:e])[0])) if f == 2 else piece[s:e] for f, _, s, v, e in _fields(piece))

    return b"".join(model[s:v] + moderate(model[v:e]) if f == 1 else model[s:e] for f, _, s, v, e in _fields(model))


@pytest.mark.parametrize("kind", [BPE, UNIGRAM])
def test_ids_equal_the_library(spark, kind):
    with open(MODEL, "rb") as f:
        model = changed(f.read(), kind=kind)
    model = with_moderate_scores(model) if kind == UNIGRAM else model
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = Pieces.of(model)
    assert pieces.kind == kind
    texts, df = rows(spark)
    got = decode(encode(df, pieces, keep_cols=("code",)), pieces).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r["doc_id"] == 999:
            assert r["piece_ids"] is None and r["decoded"] is None
        elif r["doc_id"] is not None:
            assert r["piece_ids"] == library.encode(texts[r["doc_id"]]), texts[r["doc_id"]]
            assert r["decoded"] == texts[r["doc_id"]]


def test_blocks_and_clashing_columns(spark):
    """Texts spread over several blocks, and columns named like those that are used inside."""
    texts, df = rows(spark)
    named = df.selectExpr("doc_id as block", "text as z", "code as text")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = encode(named, Pieces.load(MODEL), "block", "z", keep_cols=("text",), blocks=5)
    assert got.columns == ["block", "text", "piece_ids"]
    for r in got.collect():
        if r["block"] is not None and r["block"] != 999:
            assert r["text"] == "z" and r["piece_ids"] == library.encode(texts[r["block"]])


def test_partitions_with_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "PARTITIONS", 2)
    texts, df = rows(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = encode(df, Pieces.load(MODEL), verify=True, block_bytes=20_000).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 999:
            assert r["decodes"] and r["piece_ids"] == library.encode(texts[r["doc_id"]])


def test_decode_of_foreign_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    cases = [[], [259], [3 + 0xE4], [3 + 0xE6, 3 + 0xBC, 3 + 0xA2], [0, 300, 0]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*cases, None])], "n int, piece_ids array<int>")
    got = {r["n"]: r["decoded"] for r in decode(df, Pieces.load(MODEL)).collect()}
    assert [got[i] for i in range(len(cases))] == [library.decode(c) for c in cases] and got[len(cases)] is None


def test_empty_table(spark):
    _, df = rows(spark)
    assert encode(df.limit(0), Pieces.load(MODEL)).collect() == []


def test_repeated_rows_are_encoded_once_and_given_back(spark):
    import pyarrow as pa
    from freshet.llm.sentencepiece import _collapsed

    rows = pa.RecordBatch.from_pydict({"c0": [1, 1, 1, None, None, 2], "text": ["a", "a", None, None, None, "b"], "times": pa.array([1] * 6, pa.int32())})
    assert _collapsed(rows).to_pydict() == {"c0": [1, 1, None, 2], "text": ["a", None, None, "b"], "times": [2, 1, 2, 1]}
    assert len(_collapsed(rows.slice(0, 0))) == 0
    docs = [(i // 3, None if i % 7 == 0 else f"some text {i // 6}", "x") for i in range(60)] + [(None, "tail", None)] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string, times string").coalesce(1)
    p = Pieces.load(MODEL)
    plain = encode(df, p, keep_cols=("times",), verify=True).collect()
    once = encode(df, p, keep_cols=("times",), verify=True, collapse=True)
    assert once.columns == ["doc_id", "times", "piece_ids", "decodes"]
    assert sorted(map(repr, once.collect())) == sorted(map(repr, plain))


def test_pieces_that_others_beat_are_on_no_best_path():
    with open(MODEL, "rb") as f:
        pieces = Pieces.of(changed(f.read(), kind=UNIGRAM))
    needed = _needed(pieces)
    assert {x for x, _, _ in pieces.rows if len(x) == 1} <= {x for x, _, _ in needed} and 2 * len(needed) < len(pieces.rows)

    def path(word, rows):
        best = [(0.0, -1)]
        for j in range(1, len(word) + 1):
            best.append(max(((best[i][0] + rows[word[i:j]], -i) for i in range(max(0, j - 16), j) if word[i:j] in rows), default=(best[j - 1][0] - 1e10, 1 - j)))
        return best

    some, whole = {x: s for x, _, s in needed}, {x: s for x, _, s in pieces.rows}
    draw = random.Random(7)
    for _ in range(2000):
        word = "".join(draw.choice(pieces.rows)[0] for _ in range(draw.randint(1, 5)))
        assert path(word, some) == path(word, whole)
