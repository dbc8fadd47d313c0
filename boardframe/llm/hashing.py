"""64-bit hashes of substrings, words and word runs, in numpy.

Bytes stand for random numbers; a substring's hash is the polynomial of its bytes modulo 2**64, which follows from prefix sums,
and is then mixed.
"""

from __future__ import annotations

import numpy as np

ODD = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
BACK = pow(BASE, -1, 1 << 64)
#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were needed."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(BACK, k, 1 << 64))])
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums along the last axis, from which any substring's hash follows."""
    up, _ = POWERS.get(raw.shape[-1])
    out = np.zeros((*raw.shape[:-1], raw.shape[-1] + 1), np.uint64)
    np.cumsum(BYTES[raw] * up, axis=-1, out=out[..., 1:])
    return out


def between(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``a`` to ``b``."""
    _, down = POWERS.get(len(total))
    return mix((total[b] - total[a]) * down[a])


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, with ASCII white space between them."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """Of each word of a text, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    return between(sums(raw), *bounds(raw))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` neighbours; order and number count. Empty if there are fewer."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    total = np.full(count, n, np.uint64)
    for i in range(n):
        total = total * np.uint64(ODD) + hashes[i : i + count]
    return mix(total)
