"""Texts as runs of repeated segments.

A text is cut at places where no token can span, the distinct segments of a
batch are encoded once by the tokenizer library, and the results are put
together again by position.  All of it is column work (Arrow, numpy); only
segments that are new to the worker reach the library.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BREAK = "\x00"


def as_large(texts) -> pa.Array:
    """A batch column as large strings, null as empty."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if arr.offset:      # a slice: some kernels look at the whole buffers
        arr = arr.take(pa.array(np.arange(len(arr))))
    return pc.fill_null(arr.cast(pa.large_string()), "")


def row_slices(texts, target: int = 8 << 20):
    """(first row, rows) of runs of about ``target`` bytes of text, one row at
    least: what is done with a run bounds the memory, not the batch."""
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    ends = np.cumsum(np.asarray(sizes).astype(np.int64) + 16)
    row, n = 0, len(ends)
    while row < n:
        before = ends[row - 1] if row else 0
        end = min(max(int(np.searchsorted(ends, before + target, side="right")), row + 1), n)
        yield row, end - row
        row = end


def factorize(lists: pa.Array):
    """(distinct strings, code of every string, offsets of the lists)."""
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = lists.values
    enc = values.dictionary_encode()
    codes = np.asarray(enc.indices).astype(np.int32, copy=False)
    return enc.dictionary, codes, offsets


def gather(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[starts[c]:starts[c]+lengths[c]]`` for every code."""
    n = lengths[codes]
    total = int(n.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(n)
    idx = np.repeat(starts[codes] - (ends - n), n)
    idx += np.arange(total, dtype=idx.dtype)
    return flat[idx]


class RaggedCache:
    """Segment -> ids, kept between batches of one worker.

    ``encode`` maps an Arrow array of distinct new strings to (lengths, flat
    ids).  The cache starts anew when it would exceed ``limit`` segments, so
    its memory is bounded whatever the corpus holds.
    """

    def __init__(self, encode, limit: int = 1_000_000, dtype=np.uint16):
        self.encode, self.limit, self.dtype = encode, limit, dtype
        self.clear()

    def clear(self):
        self.keys = pa.array([], pa.large_string())
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def lookup(self, distinct: pa.Array):
        """(starts, lengths, flat) with one entry per distinct string."""
        distinct = distinct.cast(pa.large_string())
        pos = pc.index_in(distinct, value_set=self.keys)
        missing = pc.is_null(pos)
        fresh = distinct.filter(missing)
        if len(fresh):
            if len(self.keys) and len(self.keys) + len(fresh) > self.limit:
                self.clear()
                return self.lookup(distinct)
            lengths, flat = self.encode(fresh)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            first = len(self.keys)
            self.keys = pa.concat_arrays([self.keys, fresh])
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
            at = np.asarray(pc.fill_null(pos, 0)).astype(np.int64)
            at[np.asarray(missing)] = first + np.arange(len(fresh))
        else:
            at = np.asarray(pos).astype(np.int64)
        return self.starts[at], self.lengths[at], self.flat


def spans(offsets: np.ndarray, target: int = 1_000_000):
    """Cut rows into runs of about ``target`` elements, to bound memory."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + target, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end
