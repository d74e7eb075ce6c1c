"""Words and their 64-bit hashes, for whole batches of texts at once (numpy over the bytes).

A word is a maximal run of bytes that a table marks as word bytes; A-Z is lower-cased first. Words never
cross a document's end. The hash of a word is a polynomial in an odd base over random values of its bytes,
finished by a mixing function; equal words have equal hashes wherever they stand. Two different words share a
hash with probability about 2^-64.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: word bytes of ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: lower-cases A-Z and turns every byte outside ALNUM words into a space, for ``bytes.translate``
ALNUM_TABLE = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 32 for b in range(256))

_BASE, _SEED = 0x9E3779B97F4A7C15, 20240229
_BYTE = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b % 2**64, np.uint64)]), dtype=np.uint64)
                      for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, off: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of the batch, and the n + 1 offsets of the documents' words."""
    inside = word_bytes[LOWER[data]]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.concatenate([[False], inside[:-1]])[: len(data)]
    after = np.concatenate([inside[1:], [False]])[: len(data)]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """The hash of each span of bytes, lower-cased if ``fold``."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data] if fold else data] * power[: len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, off: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the n + 1 offsets of the documents' words."""
    starts, ends, words = spans(data, off, word_bytes)
    return hash_spans(data, starts, ends), words


def grams(hashes: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie within one document, and the documents' n + 1 offsets into them."""
    counts = np.maximum(np.diff(off) - (n - 1), 0)
    new = np.concatenate([[0], np.cumsum(counts)])
    if new[-1] == 0:
        return np.zeros(0, np.uint64), new
    at = np.repeat(off[:-1] - new[:-1], counts) + np.arange(new[-1])
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_BASE) + hashes[at + k])
    return out, new
