"""Reading a SentencePiece model file, and cutting texts where no piece spans.

A piece that holds the space marker holds it only in front (checked on the
vocabulary), so no merge joins a character to a marker behind it; and no piece
holds a line feed.  A text cut before its markers and around its line feeds
therefore has the tokens of its segments, in order.  Where a model does not
have these properties, texts stay whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

from .segments import BREAK, as_large

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def parse(path: str):
    """The model file as a protobuf message."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    return m


class Cutter:
    """Cuts prefixed, marked texts into segments joined by ``BREAK``."""

    def __init__(self, proto):
        norm = proto.normalizer_spec
        texts = [p.piece for p in proto.pieces if p.type in (NORMAL, USER_DEFINED, UNUSED)]
        identity = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.prefix = norm.add_dummy_prefix
        self.safe = (identity and proto.trainer_spec.model_type == BPE
                     and not any(MARK in t.lstrip(MARK) for t in texts)
                     and not any("\n" in t or BREAK in t for t in texts)
                     and not any(p.type == USER_DEFINED for p in proto.pieces))

    def __call__(self, texts) -> tuple[pa.Array, pa.Array]:
        """(segmented texts, mask of texts to be taken whole)."""
        texts = as_large(texts)
        if not self.safe:
            return texts, pa.array([True] * len(texts))
        whole = pc.match_substring(texts, BREAK)
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts,
                            pc.binary_join_element_wise(
            pa.scalar(MARK if self.prefix else "", texts.type), texts, pa.scalar("", texts.type)))
        cut = pc.replace_substring(pc.replace_substring(marked, " ", BREAK + MARK), "\n", f"{BREAK}\n{BREAK}")
        # runs of markers stay together with what follows
        runs = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.starts_with(texts, " "))
        if pc.any(runs).as_py():
            pattern = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
            fixed = [BREAK.join(pattern.findall(t.replace(" ", MARK))) for t in marked.filter(runs).to_pylist()]
            cut = pc.replace_with_mask(cut, runs, pa.array(fixed, cut.type))
        return pc.if_else(whole, pa.scalar("", cut.type), cut), whole
