"""Vectorised hashes of the words of many texts."""

from __future__ import annotations

import numpy as np

_BASE = 0x100000001B3
_BASES = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte tables: what does not belong to a word becomes a space.
WORDS = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
CHUNKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 to the 64th."""
    if n > len(_powers[0]):
        size = 1 << n.bit_length()
        for k, base in enumerate(_BASES):
            _powers[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base))))
    return _powers[0][:n], _powers[1][:n]


#: (prime below 2^31, base, inverse of the base) of further polynomial hashes.
PRIMES = tuple((p, b, pow(b, -1, p)) for p, b in ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_013)))
_modular: dict[int, np.ndarray] = {}


def _residues(base: int, prime: int, n: int) -> np.ndarray:
    """The first n powers of the base modulo the prime, by doubling."""
    out = _modular.get(base)
    if out is None or len(out) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate((out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)))
        _modular[base] = out
    return out[:n]


def modular(a: np.ndarray, start: np.ndarray, end: np.ndarray, of: tuple[int, int, int]) -> np.ndarray:
    """The hash modulo a prime of a[start:end] for each pair; strings of up to 2^20 bytes. Sums may run over, as the
    difference of two is below 2^64."""
    prime, base, inverse = of
    sums = np.concatenate(([np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _residues(base, prime, len(a)))))
    p = np.uint64(prime)
    return (sums[end] - sums[start]) % p * _residues(inverse, prime, len(a))[start] % p


def forget() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    _modular.clear()


def words(texts: list[bytes], table: bytes = CHUNKS) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word and the number of its text. Words are what ``table`` leaves between spaces."""
    clean = [t.translate(table) + b" " for t in texts]
    a = np.frombuffer(b" " + b"".join(clean), np.uint8)
    up, down = powers(len(a))
    word = a != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    sums = np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up)
    h = mix((sums[end - 1] - sums[start - 1]) * down[start] + (end - start).astype(np.uint64))
    first = np.concatenate(([1], 1 + np.cumsum([len(c) for c in clean])))
    return h, np.searchsorted(first, start, "right") - 1


def grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each run of n words and the number of its text, in order. A text of fewer words has one
    run, of all its words; a text without words has none."""
    h, doc = words(texts)
    if not len(h):
        return h, doc
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    h, owner = np.concatenate((h, np.zeros(n, np.uint64))), np.concatenate((doc, np.full(n, -1)))
    size = len(doc)
    whole = owner[n - 1 : n - 1 + size] == doc
    short = first[(count > 0) & (count < n)]
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(31) + np.where(owner[k : k + size] == doc, h[k : k + size], np.uint64(0)))
    whole[short] = True
    return out[whole], doc[whole]
