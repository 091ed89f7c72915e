"""Token counts by a finite-state tokenizer: a BPE model as a deterministic transducer.

The last token of the encoding of a prefix is fixed by the prefix, and a token t may follow a token a exactly if merging
a and t by rank leaves both whole. A state therefore holds, for each start from which a piece may still end later, the
place in the tree of pieces, the last token before that start and the tokens there relative to now; reading a character
gives the next state and how many tokens the prefix has gained (at times a negative number). States and transitions
are compiled on the driver for all pieces and from there on as texts need them, up to a bound; then anew.

Texts are cut where no piece holds the two neighbouring characters, where every state is the first one again. What lies
between is cut into chunks, all read at once, one character of each at a time. A word of one chunk begins in the first
state. The chunks of a longer one get a map from the states they may be entered in to the state they are left in and
the tokens gained; the maps are composed by a parallel prefix scan (pointer doubling).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.sentencepiece import BPE, Cutter, Pieces, normalised
from freshet.llm.text import U64, release

#: Characters of a chunk.
CHUNK = 48
#: Compiled states at most; beyond that compilation begins anew after the texts at hand.
STATES = 200_000
#: Fields of one start within a state, as bits of a number: gained tokens, last token, place in the tree.
_GAIN, _LAST = 12, 24
_ZERO = 1 << (_GAIN - 1)
_MULT = U64(0x9E3779B97F4A7C15)


class Transducer:
    """Tokens of texts for one BPE model with byte pieces; compiles what it meets."""

    def __init__(self, pieces: Pieces):
        if pieces.kind != BPE or not pieces.byte_ids:
            raise ValueError("BPE models with byte pieces")
        self.pieces = pieces
        self.rank = {x: -s for x, _, s in pieces.rows}
        self.cutter = Cutter(pieces)
        self.chars = [""] + sorted({c for x in self.rank if len(x) > 1 for c in x})
        # a character that is no piece of its own counts as its bytes, but may still be merged
        self.tokens = ["", *self.rank, *(c for c in self.chars[1:] if c not in self.rank)]
        self.costs = [1 if x in self.rank else len(x.encode("utf-8", "surrogatepass")) for x in self.tokens]
        self.number = {x: i for i, x in enumerate(self.tokens)}
        self.tree: dict[tuple[int, str], int] = {}
        self.ends = [0]
        for i, x in enumerate(self.tokens[1:], 1):
            node = 0
            for c in x:
                node = self.tree.setdefault((node, c), len(self.ends))
                if node == len(self.ends):
                    self.ends.append(0)
            self.ends[node] = i
        self.inner = {node for node, _ in self.tree}
        # what a character that is in no piece of several is worth: one piece, or its bytes
        u = np.arange(0x110000)
        self.solo = (1 + (u > 0x7F) + (u > 0x7FF) + (u > 0xFFFF)).astype(np.int8)
        self.solo[[ord(x) for x in self.rank if len(x) == 1]] = 1
        self._begin()

    def _begin(self) -> None:
        self.follows: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple[int, ...], int] = {}
        self.starts: list[tuple[int, ...]] = []
        self.used = 0
        self._table(1 << 16)
        self._state((self._start(0, 0, 0),))

    def _table(self, size: int) -> None:
        self.shift = U64(64 - size.bit_length() + 1)
        self.keys, self.next, self.gain = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)

    @staticmethod
    def _start(node: int, last: int, gained: int) -> int:
        return (node << _LAST | last) << _GAIN | (gained + _ZERO)

    def _state(self, starts: tuple[int, ...]) -> int:
        found = self.states.setdefault(starts, len(self.starts))
        if found == len(self.starts):
            self.starts.append(starts)
        return found

    def _whole(self, text: str, at: int) -> bool:
        """Whether merges by rank, leftmost first, leave text as two tokens, before and after at (as one if at is 0)."""
        bounds = list(range(len(text) + 1))
        while True:
            merges = [(r, i) for i in range(len(bounds) - 2) if (r := self.rank.get(text[bounds[i] : bounds[i + 2]])) is not None]
            if not merges:
                return len(bounds) == 2 + (at > 0)
            gone = min(merges)[1] + 1
            if bounds[gone] == at:
                return False
            del bounds[gone]

    def _may_follow(self, a: int, t: int) -> bool:
        found = self.follows.get((a, t))
        if found is None:
            head, tail = self.tokens[a], self.tokens[t]
            found = self._whole(head + tail, len(head)) and (a == 0 or self._may_follow(0, t))
            self.follows[a, t] = found
        return found

    def _step(self, state: int, c: str) -> tuple[int, int]:
        """The state after c, and the tokens gained."""
        going, new, gained = [], 0, 0
        for packed in self.starts[state]:
            place, have = packed >> _GAIN, (packed & ((1 << _GAIN) - 1)) - _ZERO
            node, last = self.tree.get((place >> _LAST, c)), place & ((1 << _LAST) - 1)
            if node is None:
                continue
            token = self.ends[node]
            if token and not new and self._may_follow(last, token):
                new, gained = token, have + self.costs[token]
            if node in self.inner:
                going.append((node, last, have))
        return self._state((*(self._start(n, a, have - gained) for n, a, have in going), self._start(0, new, 0))), gained

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, or of the free places where they belong."""
        with np.errstate(over="ignore"):
            slot = ((keys.view(U64) * _MULT) >> self.shift).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return slot

    def _put(self, keys: np.ndarray, after: np.ndarray, gained: np.ndarray) -> None:
        if (self.used + len(keys)) * 3 > len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            held = self.keys[old], self.next[old], self.gain[old]
            self._table(1 << ((self.used + len(keys)) * 6).bit_length())
            self.used = 0
            self._put(*held)
        left = np.arange(len(keys))
        while len(left):  # keys that meet in one free slot go in one by one
            slot = self._find(keys[left])
            mine = np.unique(slot, return_index=True)[1]
            at = left[mine]
            self.keys[slot[mine]], self.next[slot[mine]], self.gain[slot[mine]] = keys[at], after[at], gained[at]
            left = np.delete(left, mine)
        self.used += len(keys)

    def _read(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, gained tokens) after the runs of codes from starts to ends, all entered in the given states."""
        order = np.argsort(starts - ends, kind="stable")
        at, sizes, now = starts[order], (ends - starts)[order], state[order]
        total = np.zeros(len(at), np.int64)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -k))  # runs of more than k characters lie in front
            keys = now[:live].astype(np.int64) * len(self.chars) + codes[at[:live] + k]
            slot = self._find(keys)
            absent = np.unique(keys[self.keys[slot] < 0])
            if len(absent):
                pairs = [divmod(key, len(self.chars)) for key in absent.tolist()]
                after, gained = np.array([self._step(n, self.chars[c]) for n, c in pairs], np.int32).T
                self._put(absent, after, gained.astype(np.int16))
                slot = self._find(keys)
            now[:live] = self.next[slot]
            total[:live] += self.gain[slot]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return now[back], total[back]

    def words(self, u: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of the words u[starts:ends] of code points; words begin and end at cuts."""
        out = self.solo[u[starts]].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        codes = self.cutter.number[u]
        some = np.flatnonzero(codes[starts] > 0)
        short = some[ends[some] - starts[some] <= CHUNK]
        out[short] = self._read(codes, starts[short], ends[short], np.zeros(len(short), np.int32))[1]
        long = some[ends[some] - starts[some] > CHUNK]
        if len(long):
            out[long] = self._long(codes, starts[long], ends[long])
        return out

    def _long(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of words of several chunks. A pair of chunk and entry state is a node, its edge leads to the next
        chunk in the state the chunk is left in. Nodes are made until every edge has its node; the first chunk of a
        word has one node only."""
        many = -(-(ends - starts) // CHUNK)
        word = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
        lo = starts[word] + nth * CHUNK
        hi = np.minimum(lo + CHUNK, ends[word])
        last = nth == many[word] - 1
        chunks, entered = np.arange(len(word)), np.zeros(len(word), np.int32)  # every chunk from the first state
        known = np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, ...]] = []
        while len(chunks):
            left, gained = self._read(codes, lo[chunks], hi[chunks], entered)
            node = chunks << 32 | entered
            target = np.where(last[chunks], -1, (chunks + 1) << 32 | left)
            held.append((node, target, gained))
            known = np.union1d(known, node)
            missing = np.setdiff1d(target[target >= 0], known)
            chunks, entered = missing >> 32, (missing & 0xFFFFFFFF).astype(np.int32)
        node, target, total = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(node)
        node, target, total = node[order], target[order], total[order]
        ahead = np.where(target >= 0, np.searchsorted(node, target), len(node))  # len(node) is the end
        ahead, total = np.append(ahead, len(node)), np.append(total, 0)
        while (ahead < len(node)).any():  # doubling: maps over 1, 2, 4, ... chunks
            total = total + total[ahead]
            ahead = ahead[ahead]
        return total[np.searchsorted(node, (np.cumsum(many) - many) << 32)]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null and empty texts have none."""
        out, before = [], 0
        for s, starts, ends, _, done in self.cutter.words(normalised(x or "", self.pieces) for x in texts):
            u = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
            sums = np.concatenate([[0], np.cumsum(self.words(u, starts, ends))])
            marks = np.concatenate([[-before], sums[done]])
            out.append(np.diff(marks))
            before = int(sums[-1] - marks[-1]) if len(done) else before + int(sums[-1])
            if len(self.starts) > STATES:
                self._begin()
        return np.concatenate([np.zeros(0, np.int64), *out])


def compiled(pieces: Pieces) -> Transducer:
    """The transducer with what its own pieces need, alone and at the beginning of a word."""
    found = Transducer(pieces)
    found.count([x for x, _, _ in pieces.rows])
    return found


def token_counts(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(<id_col>, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes and tokens of the whole text.

    The counts are those of the model's library without added tokens. Null text: as empty, no bytes and no tokens.
    Null ids and repeated rows are counted like any others. Empty table: no rows. Other columns are not read, so names
    cannot clash. One pass, no shuffle; the model and what is compiled of its pieces are broadcast, and a text of any
    length is held by one task only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compiled(pieces))

    @F.arrow_udf("long")
    def tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(shared.value.count(part.to_pylist()), pa.int64())
        release()

    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counted = d.select(id_col, F.octet_length("_text").cast("long").alias("n_bytes"), tokens("_text").alias("n_tokens"))
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
