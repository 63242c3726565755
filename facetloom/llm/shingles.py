"""Hashes of word shingles and byte windows of whole texts, with numpy."""

from __future__ import annotations

import numpy as np

# An odd 64-bit multiplier and the multipliers of a 64-bit finalizer.
_BASE = 0x9E3779B97F4A7C15
_FIRST = np.uint64(0xBF58476D1CE4E5B9)
_SECOND = np.uint64(0x94D049BB133111EB)

_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """The first powers of ``base``, kept in the worker and grown to the longest text."""
    known = _tables.get(name)
    if known is None or len(known) < n:
        size = max(4096, 2 * n)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        known = _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of the bytes follows in one step."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(
        (data.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(data)),
        dtype=np.uint64,
        out=sums[1:],
    )
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``[start, end)``; equal bytes give equal hashes."""
    down = _powers("down", _INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` bytes, from the prefix sums."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    return mix((sums[width:] - sums[:-width]) * _powers("down", _INVERSE, n))


def words_of(text: str | None) -> list[str]:
    """Runs of characters other than white space, in lower case."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[str], width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order.

    Fewer words than that make one shingle of all of them; no word makes none.
    """
    if not words:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(data)]))
    width = min(width, len(words))
    return span_hashes(prefix_sums(data), starts[: len(starts) - width + 1], ends[width - 1 :])


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingle_hashes(words_of(text), width))
