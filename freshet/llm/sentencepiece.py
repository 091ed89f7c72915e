"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words wherever no piece of the model holds the two neighbouring characters, so no piece reaches
across a cut. For the distinct words, all substrings up to the longest piece are exploded and equi-joined to the piece
table; what matches are the edges of the word's lattice. Edges are grouped by word and folded with Spark's aggregate():

- unigram models: Viterbi, the path with the highest sum of scores, over the pieces that can be on such a path;
- BPE models: their scores are merge ranks, for which the best sum is not what SentencePiece computes, so the fold
  applies the merges in rank order to the word's boundaries. That gives the library's ids.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.text import U64, range_hashes, release, unused
from freshet.shared import small_batches

MARK = "▁"
#: Characters of the longest word whose lattice one row holds; a longer run without any cut is encoded in the task
#: that holds the text. Up to SHORT characters the boundaries of a word fit into the bits of a number.
LONGEST_WORD, SHORT = 4096, 62
#: Bytes of text of a block. Larger blocks repeat fewer words and take more memory in their task.
BLOCK = 8 << 20
#: Shuffle partitions at most; beyond that a partition holds several blocks or buckets, one after the other.
PARTITIONS = 20_000
#: Bytes of text per word bucket: the edges of one bucket are sorted in memory.
BUCKET = 8 << 20
#: Characters that are cut at a time.
CHUNK = 1 << 18
UNIGRAM, BPE = 1, 2
#: Bits of the length and the start of an edge, below its rank; the length is lowest.
_LENGTH, _START = 8, 13


def _fields(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(field, wire type, start of the field, start and end of its value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        start = at
        tag, at = varint(at)
        if tag & 7 == 2:
            size, at = varint(at)
        else:
            size = {0: varint(at)[1] - at, 1: 8, 5: 4}[tag & 7]
        yield tag >> 3, tag & 7, start, at, at + size
        at += size


def changed(model: bytes, kind: int | None = None, prefix: bool | None = None) -> bytes:
    """The model with another model type, or with the leading space mark switched on, or off with spaces left alone."""

    def with_flag(message: bytes, number: int, value: int) -> bytes:
        rest = b"".join(message[s:e] for f, _, s, _, e in _fields(message) if f != number)
        return rest + bytes([number << 3, value])

    out = b""
    for f, _, s, v, e in _fields(model):
        part = model[v:e]
        if f == 2 and kind is not None:
            part = with_flag(part, 3, kind)
        elif f == 3 and prefix is not None:
            part = with_flag(part, 3, int(prefix)) if prefix else with_flag(with_flag(part, 3, 0), 4, 0)
        else:
            out += model[s:e]
            continue
        size, length = len(part), b""
        while size > 127:
            length, size = length + bytes([size & 127 | 128]), size >> 7
        out += bytes([f << 3 | 2]) + length + bytes([size]) + part
    return out


@dataclass
class Pieces:
    """Piece table of a model: (piece, id, score) of normal pieces, byte pieces by value, and flags."""

    model: bytes
    kind: int
    rows: list[tuple[str, int, float]]
    unknown: int
    byte_ids: list[int]
    add_prefix: bool
    drop_spaces: bool

    @staticmethod
    def load(path: str) -> Pieces:
        """Read a model file on the driver; only its bytes travel. Its size bounds everything that is broadcast."""
        with open(path, "rb") as f:
            return Pieces.of(f.read())

    @staticmethod
    def of(model: bytes) -> Pieces:
        rows, byte_ids, unknown, index = [], {}, 0, 0
        kind, prefix, drop, charsmap = UNIGRAM, True, True, b""
        for f, _, _, v, e in _fields(model):
            own = model[v:e]
            if f == 1:
                piece, score, sort = "", 0.0, 1
                for g, wire, _, a, b in _fields(own):
                    if g == 1:
                        piece = own[a:b].decode()
                    elif g == 2:
                        score = struct.unpack("<f", own[a:b])[0]
                    elif g == 3 and wire == 0:
                        sort = own[a]
                if sort == 1:
                    rows.append((piece, index, score))
                elif sort == 2:
                    unknown = index
                elif sort == 6:
                    byte_ids[int(piece[3:5], 16)] = index
                elif sort == 4:
                    raise ValueError("models with user-defined pieces are not supported")
                index += 1
            elif f == 2:
                kind = next((own[a] for g, _, _, a, _ in _fields(own) if g == 3), UNIGRAM)
            elif f == 3:
                for g, _, _, a, b in _fields(own):
                    charsmap = own[a:b] if g == 2 else charsmap
                    prefix = bool(own[a]) if g == 3 else prefix
                    drop = bool(own[a]) if g == 4 else drop
        if charsmap or kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without a character map")
        return Pieces(model, kind, rows, unknown, [byte_ids[i] for i in range(256)] if len(byte_ids) == 256 else [], prefix, drop)

    @property
    def separator(self) -> str:
        """A character that is in no piece of several, so in no word beside others."""
        held = {c for x, _, _ in self.rows if len(x) > 1 for c in x}
        return next(c for c in map(chr, (*range(1, 32), *range(0xE000, 0xF900))) if c not in held)

    @property
    def width(self) -> int:
        """Bytes of one id."""
        return 2 if max(i for _, i, _ in self.rows) < 65_536 else 4


def normalised(text: str, p: Pieces) -> str:
    """Space marks for spaces and, if the model says so, one in front; empty stays empty."""
    if p.drop_spaces:
        text = " ".join(x for x in text.split(" ") if x)
    return (MARK if p.add_prefix and text else "") + text.replace(" ", MARK)


class Cutter:
    """Cuts texts into words between characters that no piece holds next to each other.

    Pairs are looked up in a table of fixed size by a hash; where two pairs share a place, one cut may be missing,
    which makes a word longer and no result different."""

    _PLACES = 1 << 22

    def __init__(self, p: Pieces):
        chars = sorted({c for x, _, _ in p.rows if len(x) > 1 for c in x})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.base = len(chars) + 1
        pairs = {x[i : i + 2] for x, _, _ in p.rows for i in range(len(x) - 1)}
        self.joined = np.zeros(self._PLACES, bool)
        self.joined[[self._place(*self.number[[ord(c) for c in pair]]) for pair in pairs]] = True

    def _place(self, a, b):
        return (a * np.int64(self.base) + b) & (self._PLACES - 1)

    def words(self, texts: Iterable[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(characters, starts, ends, hashes of the words, number of words before the end of each text that ends here),
        for about CHUNK characters at a time; a long text spans several."""
        parts, size, stops = [], 0, []
        for text in texts:
            for at in range(0, max(1, len(text)), CHUNK):
                parts.append(text[at : at + CHUNK])
                size += len(parts[-1])
                if at + CHUNK >= len(text):
                    stops.append(size)
                if size >= CHUNK or len(stops) >= CHUNK:
                    s = "".join(parts)
                    edges, out = self._cut(s, stops)
                    yield s, *out
                    parts, size, stops = [s[edges[-1] :]], len(s) - int(edges[-1]), []
        if stops:
            s = "".join(parts)
            yield s, *self._cut(s, stops)[1]

    def _cut(self, s: str, stops: list[int]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        u = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        flag = np.zeros(len(u) + 1, bool)
        c = self.number[u]
        flag[1:-1] = ~self.joined[self._place(c[:-1], c[1:])]
        flag[0] = True
        flag[stops] = True
        edges = np.flatnonzero(flag)
        return edges, (edges[:-1], edges[1:], range_hashes(u.astype(U64), edges[:-1], edges[1:]), np.searchsorted(edges[1:], stops, "right"))


def _out_of_order(p: Pieces) -> set[str]:
    """Pieces that applying merges by rank, each once, does not build from their own characters, or that share a rank.
    In a word without such pieces a merge is possible at its turn or never: the ends of a piece are boundaries at its
    turn if they are later, and then what lies between them is the piece. With such pieces the best merge is looked for
    at each step."""
    rank = {x: -s for x, _, s in p.rows if len(x) > 1}
    times = Counter(rank.values())
    found = {x for x, r in rank.items() if times[r] > 1}
    for x, own in rank.items():
        n, bounds = len(x), set(range(len(x) + 1))
        edges = sorted((rank[x[i:j]], i, j) for i in range(n) for j in range(i + 2, n + 1) if x[i:j] in rank)
        for r, i, j in edges:
            inner = bounds.intersection(range(i + 1, j))
            if r <= own and i in bounds and j in bounds and len(inner) == 1:
                bounds -= inner
        if len(bounds) > 2:
            found.add(x)
    return found


def _needed(p: Pieces) -> list[tuple[str, int, float]]:
    """The rows of a unigram model without pieces that are on no best path: wherever such a piece fits, so do others that
    make up the same characters and sum to more. The difference must exceed what sums of a word's scores may round."""
    score = {x: s for x, _, s in p.rows}
    slack = LONGEST_WORD * max(map(abs, score.values()), default=0) * 2.0**-40
    kept = []
    for x, i, own in p.rows:
        best = [0.0]
        for j in range(1, len(x) + 1):
            best.append(max((best[a] + score[x[a:j]] for a in range(j) if j - a < len(x) and x[a:j] in score), default=-np.inf))
        if best[-1] <= own + slack:
            kept.append((x, i, own))
    return kept


def lattice(words: DataFrame, p: Pieces, keys: tuple[str, ...], carry: str) -> DataFrame:
    """words(<keys>, word, <carry>), one row per key and word -> (<keys>, word, <carry>, marks string).

    marks has a digit for each end of a character, last one first: 1 where one piece ends and the next begins, so
    "1" + "01" + "1" is a word of three characters whose last two are one piece. The caller deals the rows out by
    <keys>; nothing here is shuffled again. The piece table is broadcast: it is as large as the model file. Words must
    have at most LONGEST_WORD characters.
    """
    bpe = p.kind == BPE
    rows = p.rows if bpe else _needed(p)
    longest = max(len(x) for x, _, _ in rows)
    if longest >= 1 << _LENGTH:
        raise ValueError("pieces of at most 255 characters")
    late = _out_of_order(p) if bpe else set()
    turn = {s: r for r, s in enumerate(sorted({s for _, _, s in p.rows}, reverse=True))}
    table = words.sparkSession.createDataFrame([(x, turn[s] << (_LENGTH + _START) | len(x), x in late, s) for x, _, s in rows if len(x) > 1 or not bpe], "sub string, e long, late boolean, score double")
    starts = words.select(*keys, "word", carry, F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    # BPE starts from single characters, which need no edges; one row of each word stays to carry it
    least = F.when(F.col("i") == 0, 1).otherwise(2) if bpe else F.lit(1)
    to = F.greatest(least, F.least(F.lit(longest), F.length("word") - F.col("i")))
    lengths = starts.select("*", F.explode(F.sequence(least, to)).alias("l"))
    first = (F.col("i") == 0) & (F.col("l") == 1)
    subs = lengths.select(*keys, "word", F.when(first, F.col(carry)).alias(carry), "i", "l", F.substring("word", F.col("i") + 1, F.col("l")).alias("sub"))
    edges = subs.join(F.broadcast(table), "sub", "left")
    if bpe:
        edges = edges.where(F.col("e").isNotNull() | first)
        edge = F.when(F.col("e").isNotNull(), F.expr(f"named_struct('k', e + shiftleft(cast(i as bigint), {_LENGTH}), 'ends', shiftleft(1L, i) | shiftleft(1L, i + l), 'inner', shiftleft(shiftleft(1L, l - 1) - 1, i + 1))"))
    else:
        edges = edges.where("e is not null or l = 1")
        edge = F.expr(f"named_struct('k', i + l, 'i', i, 'v', coalesce(score, {min(s for _, _, s in p.rows) - 10!r}D))")
    more = [F.max("late").alias("late")] if late else []
    grouped = edges.groupBy("word", *keys).agg(F.collect_list(edge).alias("edges"), F.first(carry, ignorenulls=True).alias(carry), *more)
    return grouped.select(*keys, "word", carry, (_merged(bool(late)) if bpe else _viterbi()).alias("marks"))


def _merged(late: bool) -> F.Column:
    """The boundaries left after the merges by rank, leftmost first: an edge merges two symbols if both its ends are
    boundaries and one boundary lies inside. Boundaries are bits of a number, or in longer words the characters of a
    string."""
    short = """bin(aggregate(sort_array(edges), shiftrightunsigned(-1L, 63 - length(word)),
        (m, e) -> if((m & e.ends) = e.ends and bit_count(m & e.inner) = 1, m & ~e.inner, m)))"""
    i, n = f"cast(shiftright(e.k, {_LENGTH}) & {(1 << _START) - 1} as int)", f"cast(e.k & {(1 << _LENGTH) - 1} as int)"
    two = f"substr(m, {i} + 1, 1) = '1' and substr(m, {i} + {n} + 1, 1) = '1' and length(replace(substr(m, {i} + 2, {n} - 1), '0', '')) = 1"
    join, whole = f"overlay(m placing repeat('0', {n} - 1) from {i} + 2)", "repeat('1', length(word) + 1)"
    long = f"reverse(aggregate(sort_array(edges), {whole}, (m, e) -> if({two}, {join}, m)))"
    steps = f"""reverse(aggregate(sequence(1, length(word)), {whole},
        (m, _) -> transform(array(array_min(filter(edges, e -> {two}))), e -> if(e is null, m, {join}))[0]))"""
    return F.expr(f"case {f'when late then {steps}' if late else ''} when length(word) <= {SHORT} then {short} else {long} end")


def _viterbi() -> F.Column:
    """Best path by sum of scores. The fold goes over the edges by end and start; s holds the best sum of every
    position before the current end, b the start of its last edge. Ties: the earliest start."""
    back = """a -> aggregate(sequence(1, length(word)), named_struct('at', length(word), 'b', array_append(a.b, a.i), 'm', concat(repeat('0', length(word)), '1')),
        (x, _) -> if(x.at > 0, named_struct('at', x.b[x.at], 'b', x.b, 'm', overlay(x.m placing '1' from length(word) - x.at + 1)), x), x -> x.m)"""
    return F.expr(f"""aggregate(sort_array(edges), named_struct('k', 0, 'v', 0D, 'i', -1, 's', cast(array() as array<double>), 'b', cast(array() as array<int>)),
        (a, e) -> if(e.k = a.k,
            if(a.s[e.i] + e.v > a.v, named_struct('k', a.k, 'v', a.s[e.i] + e.v, 'i', e.i, 's', a.s, 'b', a.b), a),
            named_struct('k', e.k, 'v', if(e.i = a.k, a.v, a.s[e.i]) + e.v, 'i', e.i, 's', array_append(a.s, a.v), 'b', array_append(a.b, a.i))),
        {back})""")


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = (), blocks: int | None = None, verify: bool = False, block_bytes: int = BLOCK, collapse: bool = False) -> DataFrame:
    """(<id_col>, <keep_cols...>, piece_ids array<int>) of every row; with verify also decodes, whether the ids decode to
    the text again, with spaces for space marks and as many spaces as the model keeps (null for a null text).

    - Null text: null ids. Empty text: no ids. Characters without a piece: byte pieces; in models without those the
      unknown id, once for a run.
    - Null ids and repeated rows are encoded like any others. Empty table: empty result. Other columns of docs are not
      read, so their names cannot clash.
    - A text may have any length. Words of over LONGEST_WORD characters, that is runs without any cut, are encoded by
      the model itself, once per block.

    Texts go compressed, by a hash of their id, into blocks of about block_bytes (or into so many blocks); that is
    their only shuffle. Each block
    lists its distinct words, the words are brought together once for the lattice, and every block gets back the codes
    of its own words by their place in its list. A block has one dictionary, never the whole vocabulary of the
    corpus. In a block words are told apart by 64-bit hashes, which are alike for two of a million with odds of 3e-8.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kept = [id_col, *keep_cols]
    named = [f"c{i}" for i in range(len(kept))]
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, named, strict=True)], F.col(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    if collapse:
        named.append("times")
        d = d.withColumn("times", F.lit(1))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if blocks is None:
        blocks = max(1, -(-size // block_bytes))
    buckets = max(1, -(-size // BUCKET))
    spread = F.xxhash64(*named[: len(kept)], F.when(F.col("c0").isNull(), F.col("text")))
    d = d.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
    shared = spark.sparkContext.broadcast(pieces)

    packed = d.mapInArrow(_packer(collapse), "block int, z binary").repartition(min(blocks, PARTITIONS), "block")
    lists = packed.sortWithinPartitions("block").mapInArrow(_lister(shared, buckets), "h int, block int, first int, words string").repartition(min(buckets, PARTITIONS), "h")
    listed = lists.select("h", "block", "first", F.posexplode(F.split("words", pieces.separator)).alias("i", "word")).where("word <> ''")
    ref = F.expr("shiftleft(cast(block as bigint), 32) + first + i")
    words = listed.select("h", "word", ref.alias("ref")).groupBy("word", "h").agg(F.collect_list("ref").alias("refs"))
    coded = lattice(words, pieces, ("h",), "refs").select("refs", "word", "marks")
    back = coded.mapInArrow(_sender(shared), "block int, at binary, sizes binary, ids binary")
    more, often = ["decodes"] if verify else [], unused([*kept, "piece_ids", "decodes"], "times")
    made = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *([f"`{often}` int"] if collapse else []), "piece_ids array<int>", *(f"{c} boolean" for c in more)])
    names = [*kept, *([often] if collapse else []), "piece_ids", *more]
    out = packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_assembler(shared, named, names, verify), made)
    if not collapse:
        return out
    return out.withColumn(often, F.explode(F.sequence(F.lit(1), F.col(often)))).drop(often)


def _collapsed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows without those that equal the one before; times counts them."""
    same = np.ones(max(0, len(rows) - 1), bool)
    for name in rows.schema.names:
        if name != "times":
            c = rows.column(name)
            a, b = c.slice(1), c.slice(0, len(same))
            equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
            same &= equal | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(rows) else np.zeros(0, np.int64)
    kept = rows.take(pa.array(first))
    return kept.set_column(kept.schema.get_field_index("times"), "times", pa.array(np.diff(np.append(first, len(rows))), pa.int32()))


def _packer(collapse: bool):
    """Rows (<columns>, block) as compressed Arrow streams per block, sent on at 8 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))

        def sent() -> pa.RecordBatch:
            out = []
            for parts in held.values():
                table = pa.Table.from_batches(parts).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as to:
                    to.write_table(table)
                out.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(out, pa.binary())], ["block", "z"])

        for b in batches:
            if collapse:
                b = _collapsed(b)
            block = b.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            rows = b.drop_columns(["block"]).take(pa.array(order))
            for lo, hi in _runs(block[order]):
                held.setdefault(int(block[order[lo]]), []).append(rows.slice(lo, hi - lo))
            size += rows.nbytes
            if size > 8 << 20:
                yield sent()
                held, size = {}, 0
        if held:
            yield sent()
        held = rows = b = None
        release()

    return run


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    cuts = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(sorted_values)] if len(sorted_values) else [0]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _unpacked(z: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(z.as_buffer()) as stream:
        return stream.read_all()


def _normal(table: pa.Table, p: Pieces) -> Iterator[str]:
    for t in table.column("text").to_pylist():
        yield normalised(t or "", p)


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _lister(shared, buckets: int):
    """Packed texts sorted by block -> the distinct words of each block in the order of their hashes, cut into buckets
    by range of the hash: a word's place in the block is the first place of its row and its place in the row. Words
    that the lattice leaves out are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        cutter = Cutter(p)
        separator = p.separator
        now, known, words, hashes = None, np.zeros(0, U64), [], []

        def listed() -> pa.RecordBatch:
            h = np.concatenate(hashes)
            order = np.argsort(h)
            bucket = (((h[order] >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int32)
            own = [w if len(w) <= LONGEST_WORD and w != separator else "" for w in (words[i] for i in order.tolist())]
            runs = _runs(bucket)
            return pa.RecordBatch.from_arrays([
                pa.array(bucket[[lo for lo, _ in runs]]), pa.array(np.full(len(runs), now, np.int32)), pa.array([lo for lo, _ in runs], pa.int32()),
                pa.array([separator.join(own[lo:hi]) for lo, hi in runs], pa.string()),
            ], ["h", "block", "first", "words"])

        for b in batches:
            for block, z in zip(b.column("block").to_pylist(), b.column("z"), strict=True):
                if block != now:
                    if words:
                        yield listed()
                    now, known, words, hashes = block, np.zeros(0, U64), [], []
                for s, starts, ends, h, _ in cutter.words(_normal(_unpacked(z), p)):
                    own, first = np.unique(h, return_index=True)
                    place = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                    new = known[place] != own if len(known) else np.ones(len(own), bool)
                    first = first[new]
                    words.extend(s[a:e] for a, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True))
                    hashes.append(own[new])
                    known = np.sort(np.concatenate([known, own[new]]))
        if words:
            yield listed()
        known = words = hashes = None
        release()

    return run


def _piece_ids(words: pa.StringArray, marks: pa.StringArray, p: Pieces, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids per word, ids) of words cut at their marks; table: sorted hashes of the pieces, and their ids."""
    text = "".join(words.to_pylist())
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    digits = np.frombuffer("".join(m[-2::-1] for m in marks.to_pylist()).encode(), np.uint8) == ord("1")
    ends = np.flatnonzero(digits) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    h = range_hashes(u.astype(U64), starts, ends)
    at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    ids = np.where(table[0][at] == h, table[1][at], -1)
    word_ends = np.cumsum(pc.utf8_length(words).to_numpy())
    upto = np.concatenate([[0], np.searchsorted(ends, word_ends, "right")])
    bare = ids < 0
    if bare.any() and p.byte_ids:
        raw = [text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts[bare].tolist(), ends[bare].tolist(), strict=True)]
        n = np.ones(len(ids), np.int64)
        n[bare] = [len(x) for x in raw]
        upto = np.concatenate([[0], np.cumsum(n)])[upto]
        ids, bare = np.repeat(ids, n), np.repeat(bare, n)
        ids[bare] = np.array(p.byte_ids)[np.frombuffer(b"".join(raw), np.uint8)]
    ids[bare & (ids < 0)] = p.unknown
    return np.diff(upto), ids


def _sender(shared):
    """(refs, word, marks) of words -> the ids of each block's words, some hundred thousand words at a time; places are sent as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        kind = np.dtype(f"<u{p.width}")
        pieces = np.frombuffer("".join(x for x, _, _ in p.rows).encode("utf-32-le"), np.uint32).astype(U64)
        ends = np.cumsum([len(x) for x, _, _ in p.rows])
        h = range_hashes(pieces, np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(h)
        known = h[order], np.array([i for _, i, _ in p.rows])[order]

        def sent(refs: pa.ListArray, words: pa.StringArray, marks: pa.StringArray) -> pa.RecordBatch:
            sizes, ids = _piece_ids(words, marks, p, known)
            ref, often = refs.flatten().to_numpy(), np.diff(refs.offsets.to_numpy())
            block, at, row = ref >> 32, (ref & 0xFFFFFFFF).astype(np.int32), np.repeat(np.arange(len(often)), often)
            order = np.argsort(ref)
            block, at, row = block[order], at[order], row[order]
            n = sizes[row]
            ids = ids.astype(kind)[_gather((np.cumsum(sizes) - sizes)[row], n)]
            ends = np.concatenate([[0], np.cumsum(n)])
            n, runs = n.astype(np.uint16), _runs(block)
            return pa.RecordBatch.from_arrays([
                pa.array([int(block[lo]) for lo, _ in runs], pa.int32()), pa.array([np.diff(at[lo:hi], prepend=np.int32(0)).tobytes() for lo, hi in runs], pa.binary()),
                pa.array([n[lo:hi].tobytes() for lo, hi in runs], pa.binary()), pa.array([ids[ends[lo] : ends[hi]].tobytes() for lo, hi in runs], pa.binary()),
            ], ["block", "at", "sizes", "ids"])

        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            return sent(*(t.column(i).chunk(0) for i in range(3)))

        for b in batches:
            held.append(b)
            size += len(b.column(0).flatten())
            if size > 250_000:
                yield flushed()
                held, size = [], 0
        if size:
            yield flushed()
        release()

    return run


def _assembler(shared, named: list[str], out_names: list[str], verify: bool):
    def assemble(texts: pa.Table, codes: pa.Table) -> pa.Table:
        p = shared.value
        cutter = Cutter(p)
        tables = [_unpacked(z) for z in texts.column("z")]
        per_text, spans = [], []
        for t in tables:
            for _, _, _, h, done in cutter.words(_normal(t, p)):
                per_text.append(done)
                spans.append(h)
        known = np.unique(np.concatenate([np.zeros(0, U64), *(np.unique(h) for h in spans)]))
        sizes, starts, flat = np.full(len(known), -1, np.int64), np.zeros(len(known), np.int64), [np.zeros(0, np.int32)]
        total = 0
        for at, n, ids in zip(*(codes.column(c).to_pylist() for c in ("at", "sizes", "ids")), strict=True):
            at, n = np.cumsum(np.frombuffer(at, np.int32)), np.frombuffer(n, np.uint16).astype(np.int64)
            sizes[at], starts[at] = n, total + np.cumsum(n) - n
            flat.append(np.frombuffer(ids, f"<u{p.width}").astype(np.int32))
            total += len(flat[-1])
        absent = pa.concat_tables(tables).column("text").is_null().combine_chunks()
        if (sizes < 0).any():
            for place, ids in _by_model(tables, p, cutter, known, sizes < 0):
                sizes[place], starts[place] = len(ids), total
                flat.append(ids)
                total += len(ids)
        flat = np.concatenate(flat)
        spans = [np.searchsorted(known, h).astype(np.int32) for h in spans]
        del known
        ids, lengths, at, before = np.empty(sum(int(sizes[place].sum()) for place in spans), np.int32), [], 0, 0
        for place, done in zip(spans, per_text, strict=True):
            n = sizes[place]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids[at : at + ends[-1]] = flat[_gather(starts[place], n)]
            marks = np.concatenate([[-before], ends[done]])
            lengths.append(np.diff(marks))
            at, before = at + int(ends[-1]), int(ends[-1]) - int(marks[-1])
        del spans, flat
        lengths = np.concatenate([np.zeros(0, np.int64), *lengths])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        if not p.byte_ids:
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == p.unknown) & (ids[:-1] == p.unknown)
            again[offsets[:-1][lengths > 0]] = False
            offsets = offsets - np.concatenate([[0], np.cumsum(again)])[offsets]
            ids = ids[~again]
        more, first = [], 0
        if verify:
            text_of, same = _decoder(p), []
            for t in tables:
                at = offsets[first : first + len(t) + 1]
                got = text_of(ids[at[0] : at[-1]], at - at[0]).to_pylist()
                same += [x == y.replace(MARK, " ")[int(p.add_prefix) :] for x, y in zip(got, _normal(t, p), strict=True)]
                first += len(t)
            more = [pc.if_else(absent, pa.scalar(None, pa.bool_()), pa.array(same, pa.bool_()))]
        table = pa.concat_tables([t.drop_columns(["text"]) for t in tables])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=absent)
        release()
        return pa.Table.from_arrays([*(table.column(c) for c in named), lists, *more], names=out_names)

    return assemble


def _by_model(tables: list[pa.Table], p: Pieces, cutter: Cutter, known: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, ids) of the words that the lattice left out."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=changed(p.model, prefix=False))
    for t in tables:
        for s, starts, ends, h, _ in cutter.words(_normal(t, p)):
            place = np.searchsorted(known, h)
            for j in np.flatnonzero(wanted[place]).tolist():
                if wanted[place[j]]:
                    wanted[place[j]] = False
                    yield int(place[j]), np.array(library.encode(s[starts[j] : ends[j]].replace(MARK, " ")), np.int32)


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of the ids: null for null, empty for none. Ids outside the model and null ids count as
    unknown pieces. Bytes that are not UTF-8 become U+FFFD, as in the library. A column named out_col is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text_of = _decoder(shared.value)
        for part in batches:
            offsets = part.offsets.to_numpy().astype(np.int64)
            ids = part.values.fill_null(-1).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            text = text_of(ids, offsets - offsets[0])
            yield pc.if_else(part.is_valid(), text, pa.scalar(None, pa.string())) if part.null_count else text
        release()

    return rows.withColumn(out_col, run(F.col(ids_col)))


def _decoder(p: Pieces) -> Callable[[np.ndarray, np.ndarray], pa.StringArray]:
    """A function from ids, and where those of each text begin and end, to the texts."""
    n = max([*(i for _, i, _ in p.rows), *p.byte_ids, p.unknown]) + 1
    # the second half is for the first piece of a text, which loses the mark that encoding put in front
    raw = [" ⁇ ".encode()] * (2 * n)
    for x, i, _ in p.rows:
        raw[i] = x.replace(MARK, " ").encode()
        raw[n + i] = raw[i][1:] if p.add_prefix and x.startswith(MARK) else raw[i]
    for value, i in enumerate(p.byte_ids):
        raw[i] = raw[n + i] = bytes([value])
    whole = pa.array(raw, pa.binary())

    def text_of(ids: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
        if not len(ids):
            return pa.array([""] * (len(offsets) - 1), pa.string())
        ids = np.where((ids < 0) | (ids >= n), p.unknown, ids).astype(np.int64)
        ids[offsets[:-1][np.diff(offsets) > 0]] += n
        taken = whole.take(pa.array(ids))
        cuts = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1][offsets]
        data = taken.buffers()[2] or pa.py_buffer(b"")
        text = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.tobytes()), data)
        try:
            text.validate(full=True)
        except pa.ArrowInvalid:
            raw_text = data.to_pybytes()
            text = pa.array([raw_text[a:e].decode("utf-8", "replace") for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())
        return text

    return text_of
