"""64-bit hashes of words and, by prefix sums, of all their runs of one length."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words end at a space and at the characters from tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd bases of the polynomials, fixed so that every task hashes alike.
BASE_A, BASE_B, BASE_C = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MASK = (1 << 64) - 1


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() splits at just the characters that end words."""
    return text.encode().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, for exponents below n at least."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        steps = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        known = _powers[base] = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return known


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Runs:
    """Hashes of runs of words: equal runs hash alike wherever they stand."""

    def __init__(self, hashes: np.ndarray, base: int):
        up, self.down = _power(base, len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))
