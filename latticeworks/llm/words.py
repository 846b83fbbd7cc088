"""Words, their hashes and shingles of a batch of texts, as whole-array operations on UTF-8 bytes."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from ._common import mix

#: An odd base for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: Documents with fewer words than a shingle has are one shingle.
SHINGLE = 5


def _letters() -> np.ndarray:
    """Bytes of words: ASCII letters, digits and underscore, and all bytes of other characters."""
    out = np.zeros(256, bool)
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z"), ("_", "_")):
        out[ord(a) : ord(b) + 1] = True
    out[128:] = True
    return out


LETTERS = _letters()
#: A 64-bit code for each byte of a word, the same for both cases of an ASCII letter.
CODES = mix(np.array([ord(chr(c).lower()) if c < 128 else c for c in range(256)], np.uint64) + np.uint64(1)) | np.uint64(1)


@functools.lru_cache(maxsize=4)
def _powers(base: int, log2: int) -> np.ndarray:
    out = np.ones(1 << log2, np.uint64)
    step = base
    for k in range(log2):
        out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(step)
        step = step * step & (1 << 64) - 1
    return out


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(16, int(n).bit_length()))


@dataclass
class Words:
    """The words of a batch, in order: hash, first byte, end byte and document; and where each document's words begin (n + 1)."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    inside = LETTERS[data]
    edge = np.empty(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[[0, n]] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    keep = inside[begin] if n else np.zeros(0, bool)
    begin, end = begin[keep], end[keep]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[data] * powers(BASE, n)[:n], out=total[1:])
    hashes = mix((total[end] - total[begin]) * powers(UNBASE, n)[begin])
    doc = np.searchsorted(offsets, begin, side="right") - 1
    return Words(hashes, begin, end, doc, np.searchsorted(begin, offsets))


def shingles(w: Words, data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words, and where each document's begin (n + 1). A document with fewer words has one, of all of
    them; one without words has one of its bytes; an empty one has none."""
    n, counts = len(offsets) - 1, np.diff(w.first)
    if len(w.hashes) >= size:
        runs = w.hashes[: len(w.hashes) - size + 1] * np.uint64(BASE)
        for k in range(1, size):
            runs = mix(runs + w.hashes[k : len(w.hashes) - size + 1 + k]) * np.uint64(BASE)
        runs = runs[w.doc[: len(runs)] == w.doc[size - 1 :]]
    else:
        runs = np.empty(0, np.uint64)
    own = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((own == 0) & (np.diff(offsets) > 0))
    out = np.empty(len(runs) + len(short), np.uint64)
    first = np.zeros(n + 1, np.int64)
    lengths = own.copy()
    lengths[short] = 1
    np.cumsum(lengths, out=first[1:])
    single = np.zeros(len(out), bool)
    single[first[short]] = True
    out[~single] = runs
    for d in short:
        h = hash_bytes(w.hashes[w.first[d] : w.first[d + 1]].tobytes() or data[offsets[d] : offsets[d + 1]].tobytes())
        out[first[d]] = h
    return out, first


def hash_bytes(x: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x)
