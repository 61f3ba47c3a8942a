"""64-bit hashes of all words of a text at once."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(13).integers(1, 2**64 - 1, 256, dtype=np.uint64)
#: An odd number, and its inverse modulo 2 to the 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0, 1, ... modulo 2 to the 64, at least n of them."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, PIECE), base, np.uint64)], dtype=np.uint64)
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its 64-bit hash.

    Running sums of the bytes' values times powers give every word's
    polynomial as a difference, so all words are hashed at once.
    """
    array = np.frombuffer(data, np.uint8)
    inside = np.r_[False, ~_SPACE[array], False]
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + PIECE)))
        n = int(ends[last - 1] - low)
        sums = np.r_[np.uint64(0), np.cumsum(_BYTES[array[low : low + n]] * powers(_BASE, n)[:n], dtype=np.uint64)]
        at, to = starts[first:last] - low, ends[first:last] - low
        hashes[first:last] = mixed((sums[to] - sums[at]) * powers(_INVERSE, n)[at] + (to - at).astype(np.uint64))
        first = last
    return starts, hashes


def hashes_by_text(texts: list[bytes]) -> list[np.ndarray]:
    """The words' hashes of each text; words are runs of anything but space and the controls 9 to 13."""
    starts, hashes = word_hashes(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(hashes, np.searchsorted(starts, ends[:-1])) if texts else []
