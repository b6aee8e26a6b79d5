"""Word hashes of a text, without a Python step per word."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(7)
_CODE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
KEPT = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64; grown by doubling and kept up to ``KEPT`` of them."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.ones(1, np.uint64)
        while len(p) < max(n, 1 << 14):
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        _powers[base] = p[:KEPT].copy() if len(p) > KEPT else p
    return p[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the starts and ends of words, the runs without ASCII white space."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[data]
    turn = np.flatnonzero(space[1:] != space[:-1])
    return turn[::2], turn[1::2]


def hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of each word: a polynomial in random byte codes, from prefix sums."""
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * _power(_BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * _power(_INVERSE, len(data))[start]
    return mix64(h + (end - start).astype(np.uint64)), start, end


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased."""
    return hashed(np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8))[0]
