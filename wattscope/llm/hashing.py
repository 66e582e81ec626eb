"""Prefix polynomial hashes: the hash of any span of a sequence in constant time, for all spans at once.

The sum of x[i] * B^i modulo 2^64 over a span, divided by B^start, does not depend on where the span lies.
B is odd, so it has an inverse. A finishing mix spreads the weak low bits.
"""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n, at least."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        b = BASES[base]
        known = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (b, pow(b, -1, 1 << 64)))
        _POWERS[base] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(x: np.ndarray, base: int = 0) -> np.ndarray:
    """Running sums of (x[i] + 1) * B^i, zero first."""
    p, _ = powers(len(x) + 1, base)
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * p[:len(x)], out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Mixed hashes of the spans [start, end) of the sequence whose prefix sums are ``p``."""
    _, inverse = powers(len(p), base)
    return mix((p[end] - p[start]) * inverse[start])
