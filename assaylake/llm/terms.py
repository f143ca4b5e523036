"""Words of many texts at once: places and 64-bit hashes, as arrays over the joined bytes."""

from __future__ import annotations

import numpy as np

from assaylake.llm.common import KEPT

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = KEPT.setdefault("terms", {})


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n + n // 4, 1 << 18)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.cumprod(have)
        _POWERS[name] = have
    return have[:n]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row of every run of bytes that are ``inside``; rows end where ``at`` says and no run crosses."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``start`` to ``end``, the same wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers("base", BASE, n), out=total[1:])
    return mixed((total[end] - total[start]) * _powers("inverse", INVERSE, n + 1)[start] ^ (end - start).astype(U))
