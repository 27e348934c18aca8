"""Token ids of a word-end BPE vocabulary (tokenizers library), by word.

Exact, because of what the vocabulary file says: the normaliser (NFC, white
space to one blank, lower case) and the pre-tokeniser never join characters
across ASCII white space, and white space itself yields no token.  So the ids
of a text are the ids of its words in order, and each distinct word is
encoded once.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._util import worker_cache
from .segments import RaggedCache, as_large, factorize, gather, row_slices, spans

SEPARATOR = "<|endoftext|>"
SPECIALS = ("<|startoftext|>", "<|endoftext|>")

SLICE_BYTES = 2 << 20       # text that is encoded at once


class WordEncoder:
    """Encodes arrays of distinct words with the library.

    Words travel joined by a special token, which the library cuts out before
    it normalises; its id then marks where each word ends.  ASCII words are
    already normalised once lower-cased and use the same vocabulary without
    the normaliser.  Words that hold a special string go alone.
    """

    def __init__(self, path: str, chunk: int = 64):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        spec["normalizer"] = None
        self.plain = Tokenizer.from_str(json.dumps(spec))
        self.sep, self.chunk = self.full.token_to_id(SEPARATOR), chunk

    def _joined(self, tok, words: pa.Array):
        """(lengths, flat ids) of words that hold no special string."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.arange(0, n + self.chunk, self.chunk).clip(max=n)
        cuts = np.unique(cuts)
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words)
        texts = pc.binary_join(lists, pa.scalar(SEPARATOR, words.type)).to_pylist()
        ids = np.concatenate([np.array(e.ids + [self.sep], dtype=np.int64) for k in range(0, len(texts), 256)
                              for e in tok.encode_batch_fast(texts[k:k + 256], add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.sep)
        if len(ends) != n:
            raise ValueError("the separator did not mark every word")
        lengths = np.diff(np.concatenate([[-1], ends])) - 1
        return lengths, ids[ids != self.sep]

    def __call__(self, words: pa.Array):
        special = np.zeros(len(words), bool)
        lowered = pc.ascii_lower(words)     # in either case: lower-casing must not make one
        for s in SPECIALS:
            special |= np.asarray(pc.match_substring(lowered, s))
        ascii_ = np.asarray(pc.string_is_ascii(words)) & ~special
        # the normaliser lower-cases; without it the word must come lower-cased
        parts = []
        for mask, tok, prep in ((ascii_, self.plain, pc.ascii_lower), (~ascii_ & ~special, self.full, None)):
            where = np.flatnonzero(mask)
            sub = words.take(pa.array(where))
            parts.append((where, *self._joined(tok, prep(sub) if prep else sub)))
        where = np.flatnonzero(special)
        alone = [np.array(self.full.encode(w, add_special_tokens=False).ids, dtype=np.int64)
                 for w in words.take(pa.array(where)).to_pylist()]
        parts.append((where, np.array([len(a) for a in alone], dtype=np.int64),
                      np.concatenate(alone) if alone else np.zeros(0, np.int64)))
        # back into the order of the words
        lengths = np.zeros(len(words), np.int64)
        starts = np.zeros(len(words), np.int64)
        base = 0
        for where, ln, flat in parts:
            lengths[where] = ln
            starts[where] = base + np.cumsum(ln) - ln
            base += len(flat)
        flat = np.concatenate([p[2] for p in parts])
        return lengths, gather(np.arange(len(words)), starts, lengths, flat)


def encoder(path: str) -> RaggedCache:
    """The worker's cache for the vocabulary at ``path``."""
    cache = worker_cache()
    key = ("words", path)
    if key not in cache:
        cache[key] = RaggedCache(WordEncoder(path))
    return cache[key]


def batch_ids(texts, path: str):
    """Yield (first row, last row + 1, token offsets of those rows, ids) of a
    batch of texts in runs of bounded size; null texts are empty."""
    cache = encoder(path)
    for row, count in row_slices(texts, SLICE_BYTES):
        for a, b, upto, ids in _slice_ids(texts.slice(row, count), cache):
            yield row + a, row + b, upto, ids


def _slice_ids(texts, cache: RaggedCache):
    texts = as_large(texts)
    lowered = pc.ascii_lower(texts)
    if not any(pc.any(pc.match_substring(lowered, s)).as_py() for s in SPECIALS):
        texts = lowered         # fewer distinct words; a special string must keep its case
    distinct, codes, offsets = factorize(pc.ascii_split_whitespace(texts))
    starts, lengths, flat = cache.lookup(distinct)
    for a, b in spans(offsets):
        part = codes[offsets[a]:offsets[b]]
        ids = gather(part, starts, lengths, flat)
        upto = np.concatenate([[0], np.cumsum(lengths[part])])
        yield a, b, upto[offsets[a:b + 1] - offsets[a]], ids
