"""Rolling hashes of windows over number sequences, from prefix sums modulo 2**64."""

from __future__ import annotations

import numpy as np

#: An odd multiplier has an inverse modulo 2**64, so prefix sums give every window's hash.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of codes[i:i+length] for each i; codes are 64-bit."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(BASE, n), out=sums[1:])
    mixed = (sums[length:] - sums[: n - length + 1]) * powers(BASE_INVERSE, n - length + 1)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))
