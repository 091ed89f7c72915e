"""Double-array tries over sequences of 64-bit symbols, walked for all positions of a text at once.

A symbol is written as digits of six bits of its place in the trie's own sorted alphabet, so no node has more than 64
children and a child of node s by digit d lies in slot base[s] + d, where check holds s. Everything is numpy: building
places all nodes of one size at a time, walking takes one gather per digit for all positions together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 6
#: Nodes of more children than this get slots of their own; smaller ones are dealt into free slots.
_CROWD = 8


@dataclass
class Trie:
    """Phrases of 1 to depth symbols; leaf[s] is the number of the phrase that ends at state s, or -1."""

    alphabet: np.ndarray
    digits: int
    depth: int
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray
    size: int

    @staticmethod
    def of(phrases: np.ndarray) -> Trie:
        """phrases: distinct rows of symbols, 0 after a phrase's end; row numbers are the phrases' numbers."""
        phrases = np.asarray(phrases, np.uint64)
        alphabet = np.unique(phrases[phrases != 0])
        digits = max(1, -(-max(1, len(alphabet) - 1).bit_length() // BITS))
        depth = phrases.shape[1]
        place = np.searchsorted(alphabet, phrases).astype(np.int64)
        lengths = (phrases != 0).sum(1)
        node = np.zeros(len(phrases), np.int64)  # of the prefix read so far; 0 is the root
        parents, symbols, ends, total = [], [], np.full(len(phrases), -1, np.int64), 1
        for level in range(depth):
            live = np.flatnonzero(lengths > level)
            for k in reversed(range(digits)):
                digit = (place[live, level] >> (BITS * k)) & ((1 << BITS) - 1)
                edges, back = np.unique((node[live] << BITS) | digit, return_inverse=True)
                parents.append(edges >> BITS)
                symbols.append(edges & ((1 << BITS) - 1))
                node[live] = total + back
                total += len(edges)
            done = live[lengths[live] == level + 1]
            ends[done] = node[done]
        none = np.zeros(0, np.int64)
        return Trie(alphabet, digits, depth, *_placed(np.concatenate([none, *parents]), np.concatenate([none, *symbols]), total, ends), len(phrases))

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Places of symbols in the alphabet, -1 for others."""
        if not len(self.alphabet):
            return np.full(len(symbols), -1, np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at, -1).astype(np.int32)

    def count(self, codes: np.ndarray) -> np.ndarray:
        """How often each phrase occurs in a run of codes; -1 is in no phrase. All positions go a level at a time."""
        found = np.zeros(self.size, np.int64)
        at = np.flatnonzero(codes >= 0)
        state = np.zeros(len(at), np.int32)
        for level in range(self.depth):
            inside = at + level < len(codes)
            at, state = at[inside], state[inside]
            code = codes[at + level]
            known = code >= 0
            at, state, code = at[known], state[known], code[known]
            for k in reversed(range(self.digits)):
                slot = self.base[state] + ((code >> (BITS * k)) & ((1 << BITS) - 1))
                there = self.check[slot] == state
                at, state, code = at[there], slot[there], code[there]
            number = self.leaf[state]
            found += np.bincount(number[number >= 0], minlength=self.size)
        return found


def _placed(parents: np.ndarray, digits: np.ndarray, total: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, leaf) of a tree whose node i + 1 is reached from parents[i] by digits[i]; parents ascend."""
    width = 1 << BITS
    nodes, first, fan = np.unique(parents, return_index=True, return_counts=True)
    low = digits[first]
    span = digits[first + fan - 1] - low + 1
    large = fan > _CROWD
    own = int(span[large].sum())
    small = int(fan[~large].sum())
    size = 1 + own + 3 * small + 2 * width
    used = np.zeros(size + width, bool)
    used[0] = True  # the root's slot
    offset = np.zeros(len(nodes), np.int64)  # slot of the lowest child
    offset[large] = 1 + np.cumsum(span[large]) - span[large]

    def slots(which: np.ndarray) -> np.ndarray:
        f = fan[which]
        edge = np.repeat(first[which] - (np.cumsum(f) - f), f) + np.arange(f.sum())
        return np.repeat(offset[which] - low[which], f) + digits[edge]

    used[slots(np.flatnonzero(large))] = True
    draw = np.random.default_rng(1)
    for f in range(_CROWD, 1, -1):  # nodes of one size draw places together until each has one of its own
        wait = np.flatnonzero(fan == f)
        while len(wait):
            offset[wait] = draw.integers(1, size, len(wait))
            mine = slots(wait)
            owner = np.repeat(np.arange(len(wait)), f)
            claimed = np.zeros(len(mine), bool)
            claimed[np.unique(mine, return_index=True)[1]] = True
            free = claimed & ~used[mine]
            good = np.bincount(owner, weights=free, minlength=len(wait)) == f
            used[mine[good[owner]]] = True
            wait = wait[~good]
    single = np.flatnonzero(fan == 1)
    offset[single] = np.flatnonzero(~used)[: len(single)]
    place = np.zeros(total, np.int64)  # of each node; all but the root lie one width up, so no slot is below 0
    place[1:] = slots(np.arange(len(nodes))) + width
    base, check, leaf = (np.full(size + 3 * width, v, np.int32) for v in (0, -1, -1))
    base[place[nodes]] = offset - low + width
    check[place[1:]] = place[parents]
    leaf[place[ends]] = np.arange(len(ends))
    return base, check, leaf
