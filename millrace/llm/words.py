"""Words of whole Arrow columns of texts at once.

A word is a longest run of ASCII letters and digits, whatever its case, or, with a wide alphabet, of these, underscores and all
characters outside ASCII. It is known by a 64-bit polynomial hash over random values of its bytes: with prefix sums over all bytes of a column, every word's hash is one subtraction and
one multiplication with the inverse of its place's power (the base is odd, so it has an inverse).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20)
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_VALUE = np.zeros(256, np.uint64)
_VALUE[list(b"0123456789" + _LETTERS)] = _RNG.integers(1, 2**63, 36, dtype=np.uint64)
_VALUE[list(_LETTERS.upper())] = _VALUE[list(_LETTERS)]
#: The values of the wide alphabet: ASCII letters and digits, the underscore, and every byte of a character outside ASCII.
_WIDE = _VALUE.copy()
_WIDE[[0x5F, *range(0x80, 0x100)]] = _RNG.integers(1, 2**63, 129, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20


class _Powers:
    """Powers of the base and of its inverse, as many as the longest block needs."""

    up = np.ones(0, np.uint64)
    down = np.ones(0, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


class Words(NamedTuple):
    """hashes of all words in order, the text each stands in, and how many words each text has.

    raw: the bytes of all texts, one after another; starts and ends: where words lie in it; bounds: where texts do.
    """

    hashes: np.ndarray
    text: np.ndarray
    counts: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    up, down = _Powers.to(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def words_of(column: pa.Array, wide: bool = False) -> Words:
    """The words of a column of binary texts without nulls."""
    value = _WIDE if wide else _VALUE
    texts = column.cast(pa.large_binary())
    n = len(texts)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None or bounds[0] == bounds[-1]:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, np.zeros(n, np.int64), np.zeros(0, np.uint8), none, none, np.zeros(n + 1, np.int64))
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = value[raw] > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # a block holds whole words
        at = starts[done]
        upto = max(int(np.searchsorted(ends, at + _BLOCK, "right")), done + 1)
        hashes[done:upto] = _block(raw[at : ends[upto - 1]], starts[done:upto] - at, ends[done:upto] - at, value)
        done = upto
    text = np.searchsorted(bounds, starts, "right") - 1
    return Words(mixed(hashes), text, np.bincount(text, minlength=n), raw, starts, ends, bounds)
