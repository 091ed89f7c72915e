"""Words, word hashes and shingles of one text as numpy arrays; used inside Arrow-batched tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 form; A-Z can be lower-cased first.
Every hash is a fixed function of the bytes, so results agree between runs and executors.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def release() -> None:
    """Give unused memory back to the system: Python workers outlive their stage, and what they hold counts."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def unused(columns: list[str], name: str) -> str:
    """A column name like the given one that the columns do not hold."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.concatenate([np.ones(1, U64), np.full(size - 1, base, U64)]).cumprod(dtype=U64)
        _powers[base] = have
    return have[:n]


def raw_bytes(text: str | None, lower: bool = False) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return _LOWER[raw] if lower else raw


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[raw]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of 64-bit values, from prefix sums of a polynomial in their positions."""
    if not len(starts):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * _power(_BASE, len(values)), dtype=U64)])
        own = (sums[ends] - sums[starts]) * _power(_INVERSE, len(values))[starts]
        return mix(own + (ends - starts).astype(U64))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return range_hashes(_BYTE[raw], starts, ends)


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    raw = raw_bytes(text, lower)
    return span_hashes(raw, *spans(raw))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k lower-cased words; all words as one run if there
    are fewer than k, nothing if there are none."""
    words = word_hashes(text, lower=True)
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, U64)
        for j in range(width):
            out = mix(out * U64(0x9E3779B97F4A7C15) + words[j : n - width + 1 + j])
    return np.unique(out)
