"""Token ids in directly addressable codes (operator 2).

Each id is cut into chunks of ``CHUNK_BITS`` bits, lowest first.  Level k holds
the k-th chunk of every id that has one; a bitmap per level marks the ids that
continue at level k+1, and a rank directory (set bits before each block of 512)
gives their place there.  So id i is read with one chunk and one rank per
level; nothing else is decoded.

A file: magic, version, number of levels, documents, tokens; doc_ids (int64)
with a byte each that is 0 for null; token offsets of the documents (uint64);
then per level its length, chunks, packed bitmap and rank directory (uint32).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, VERSION, CHUNK_BITS, RANK_BLOCK = b"DACT", 1, 8, 512
_HEAD = "<4sHHQQ"


def encode(doc_ids: list, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file; ``offsets`` has one entry more than documents."""
    ids = ids.astype(np.uint32, copy=False)
    levels, rest = [], ids
    while True:
        more = (rest >> CHUNK_BITS) != 0
        bits = np.packbits(more, bitorder="little")
        pad = -len(bits) % (RANK_BLOCK // 8)
        per_block = np.bitwise_count(np.concatenate([bits, np.zeros(pad, np.uint8)]).reshape(-1, RANK_BLOCK // 8)).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)
        levels.append((len(rest), (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, ranks))
        if not more.any():
            break
        rest = rest[more] >> CHUNK_BITS
    out = [struct.pack(_HEAD, MAGIC, VERSION, len(levels), len(doc_ids), len(ids)),
           np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
           np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
           np.asarray(offsets, "<u8").tobytes()]
    for n, chunks, bits, ranks in levels:
        out += [struct.pack("<Q", n), chunks.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(out)


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        magic, version, n_levels, n_docs, self.n_tokens = struct.unpack_from(_HEAD, data, 0)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)

        def take(dtype, n):
            nonlocal at
            a = np.frombuffer(data, dtype, n, at)
            at += a.nbytes
            return a
        ids, valid = take("<i8", n_docs), take(np.uint8, n_docs)
        self.doc_ids = [int(d) if v else None for d, v in zip(ids, valid)]
        self.offsets = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n, = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = take(np.uint8, n)
            bits = take(np.uint8, (n + 7) // 8)
            ranks = take("<u4", -(-len(bits) // (RANK_BLOCK // 8)) + 1)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """Id number i, without decoding any other."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                return value
            block = byte // (RANK_BLOCK // 8)
            before = bits[block * (RANK_BLOCK // 8):byte]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[byte] & ((1 << bit) - 1)).bit_count()
        raise ValueError("damaged file")

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        value = np.zeros(0, np.uint32)
        for k in range(len(self.levels) - 1, -1, -1):
            chunks, bits, _ = self.levels[k]
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            here[more] |= value << CHUNK_BITS
            value = here
        return value

    def document(self, k: int) -> np.ndarray:
        return np.array([self.token(i) for i in range(self.offsets[k], self.offsets[k + 1])], np.uint32)
