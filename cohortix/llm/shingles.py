"""Sets of hashed word shingles, for whole batches at a time.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z.  A text's set
holds its distinct shingles of ``size`` words; a shorter text is one shingle; a
text without words has none.  Shingles are 64-bit hashes: two different
shingles of a pair of texts meet with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .segments import as_large, factorize

_POWER = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a permutation)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial in its bytes, mixed."""
    strings = strings.cast(pa.large_string())
    if not len(strings):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    lengths = np.diff(offsets)
    longest = int(lengths.max(initial=0))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _POWER)]))
    starts = offsets[:-1] - offsets[0]
    at = np.arange(len(data)) - np.repeat(starts, lengths)
    terms = mix(data.astype(np.uint64) + np.uint64(1)) * powers[at]
    sums = np.zeros(len(strings), np.uint64)
    some = lengths > 0
    if some.any():
        sums[some] = np.add.reduceat(terms, starts[some])
    return mix(sums + lengths.astype(np.uint64))


def shingle_sets(texts, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): row k's sorted distinct hashes lie between
    ``offsets[k]`` and ``offsets[k + 1]``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(as_large(texts)))
    distinct, codes, offsets = factorize(lists)
    # leading and trailing white space gives empty strings
    empty = np.asarray(pc.equal(pc.binary_length(distinct), 0))
    if empty.any():
        real = ~empty[codes]
        upto = np.concatenate([[0], np.cumsum(real)])
        codes, offsets = codes[real], upto[offsets]
    words = _string_hashes(distinct)[codes]
    n = np.diff(offsets)
    mult = _MULT[:size]
    out, counts = np.zeros(len(words), np.uint64), np.where(n >= size, n - size + 1, np.minimum(n, 1))
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            rolled += words[j:len(words) - size + 1 + j] * mult[j]
        out[:len(rolled)] = mix(rolled)
    for k in np.flatnonzero((n > 0) & (n < size)):
        w = words[offsets[k]:offsets[k + 1]]
        out[offsets[k]] = mix((w * mult[:len(w)]).sum(keepdims=True) + np.full(1, len(w), np.uint64) * _POWER)[0]
    # the shingles of a row are the first counts[k] of its words' places
    first = offsets[:-1]
    hashes = np.empty(int(counts.sum()), np.uint64)
    upto = np.concatenate([[0], np.cumsum(counts)])
    for k in range(len(n)):
        part = hashes[upto[k]:upto[k + 1]]
        part[:] = out[first[k]:first[k] + counts[k]]
        part.sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[upto[:-1][counts > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return total[upto], hashes[keep]


def set_keys(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key per set; equal sets have equal keys."""
    n = np.diff(offsets)
    key = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        key[some] = np.add.reduceat(mix(hashes + _POWER), offsets[:-1][some])
    return mix(key + n.astype(np.uint64)).view(np.int64)
