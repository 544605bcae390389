"""Vectorised 64-bit hashes of words and windows inside tasks (numpy)."""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np

U = np.uint64

#: Odd multipliers and seeds of the finaliser and the polynomials (any odd numbers serve).
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * MIX1
        x = (x ^ (x >> U(27))) * MIX2
        return x ^ (x >> U(31))


#: A random-looking number for each byte value; the second folds A-Z onto a-z.
BYTES = mix(np.arange(1, 257, dtype=U) * U(BASES[0]))
BYTES_FOLDED = BYTES.copy()
BYTES_FOLDED[65:91] = BYTES[97:123]


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * U(pow(self.base, m, 2**64))])
                self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, m, 2**64))])


POWERS = tuple(Powers(b) for b in BASES)


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hash`` takes differences of them."""
    powers = POWERS[which]
    powers.grow(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers.up[: len(values)], dtype=U, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each span [start, stop) by content and length alone."""
    with np.errstate(over="ignore"):
        return mix((sums[stop] - sums[start]) * POWERS[which].down[start] + (stop - start).astype(U) * MIX2)


SEGMENT = 1 << 21


def words_of(data: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of bytes, with each word's start and stop. Words are runs without the six white-space bytes.

    These hashes are for features: two long words may be made to share one.
    ``named_words`` tells words apart.
    """

    def name(part: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return span_hash(prefix_sums((BYTES_FOLDED if fold else BYTES)[part]), start, stop)

    return _words(data, name)


def named_words(data: np.ndarray, key: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words_of``, with names by which words may be taken for equal.

    A word of up to seven bytes is its own name (its bytes and length under a
    bijection). Up to 32 bytes a multilinear hash names it: two sums of its
    four-byte pieces times secret 64-bit numbers, of which the upper halves are
    taken; whatever two different words are, they share it with probability
    2^-64. Longer words have a keyed BLAKE2b of 64 bits. ``key`` is drawn anew
    for each run (``new_key``), so that no text can be made for it.
    """
    secrets = _secrets(key)

    def name(part: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        part = FOLD[part] if fold else part
        size = stop - start
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(part) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        piece = eight[start] & LOW_BYTES[np.minimum(size, 8)]
        names = mix((piece | (size.astype(U) << U(56))) ^ secrets[0])
        middle = np.flatnonzero(size > OWN_NAME)
        if not len(middle):
            return names
        n, at, piece = size[middle], start[middle], piece[middle]
        with np.errstate(over="ignore"):
            one, two = (secrets[16 + 2 * k] + n.astype(U) * secrets[17 + 2 * k] for k in (0, 1))
            for i in range(MIDDLE // 8):
                if i:
                    if not (n > 8 * i).any():
                        break
                    piece = eight[np.minimum(at + 8 * i, len(part))] & LOW_BYTES[np.clip(n - 8 * i, 0, 8)]
                low, high = piece & U(0xFFFFFFFF), piece >> U(32)
                one += low * secrets[2 * i] + high * secrets[2 * i + 1]
                two += low * secrets[8 + 2 * i] + high * secrets[9 + 2 * i]
        names[middle] = (one & U(0xFFFFFFFF00000000)) | (two >> U(32))
        if n.max() <= MIDDLE:
            return names
        text = part.tobytes()
        for i in np.flatnonzero(size > MIDDLE).tolist():
            names[i] = int.from_bytes(hashlib.blake2b(text[start[i] : stop[i]], digest_size=8, key=key).digest(), "little")
        return names

    return _words(data, name)


#: Bytes up to which a word is its own name, and up to which the multilinear hash names it.
OWN_NAME, MIDDLE = 7, 32
LOW_BYTES = np.array([2 ** (8 * n) - 1 for n in range(9)], U)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] = FOLD[97:123]

@lru_cache(4)
def _secrets(key: bytes) -> np.ndarray:
    """Twenty 64-bit numbers drawn from the key."""
    return np.frombuffer(b"".join(hashlib.blake2b(b"%d" % i, digest_size=8, key=key).digest() for i in range(20)), "<u8")


def new_key() -> bytes:
    """A secret for one run of an operator; its tasks get it with their code."""
    return os.urandom(16)


def _words(data: np.ndarray, name) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and stops. Long texts are taken in segments that end at white space, so that
    the working arrays stay small; a word longer than a segment stays whole."""
    parts: list[tuple] = []
    at = 0
    while at < len(data):
        stop = min(len(data), at + SEGMENT)
        while stop < len(data):
            gap = np.flatnonzero(SPACE[data[at:stop]])
            if len(gap):
                stop = at + int(gap[-1]) + 1
                break
            stop = min(len(data), stop + SEGMENT)
        part = data[at:stop]
        solid = np.concatenate([[False], ~SPACE[part], [False]])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        first, last = edge[0::2], edge[1::2]
        parts.append((name(part, first, last), first + at, last + at))
        at = stop
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))  # type: ignore[return-value]


def windows(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` items (empty if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    start = np.arange(n)
    return span_hash(prefix_sums(hashes, which), start, start + width, which)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs; fewer words than ``width`` make one run; no words, none."""
    if not len(words):
        return np.zeros(0, U)
    return np.unique(windows(words, min(width, len(words))))


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` neighbours: by the upper 40 bits, the leftmost if equal.

    Which of a run's items is chosen depends on the run's content alone.
    Takes up to 2^24 items at once.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U((1 << 24) - 1)
    least = (keys & ~low) | np.arange(len(keys), dtype=U)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:n], least[width - have : width - have + n])
    return (least[:n] & low).astype(np.int64)
