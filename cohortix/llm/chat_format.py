"""Chat formatting with typed content parts (operator 13).

A turn holds plain ``text`` or ``parts``, an ordered list of text, image, audio and
document parts.  A visitor flattens it: texts are escaped, every other part becomes
one placeholder in its place, and the visitor records the attachment (turn,
position, kind, reference) with the number of tokens its placeholder expands to:
patches of an image, frames of an audio clip, pages of a document.

Template: ``<|im_start|>role``, a line end, the content, ``<|im_end|>``, a line end.
Every control string begins with ``<|``.  In texts and roles, one backslash is put
before the bar of each ``<``, any backslashes, ``|``; taking one away restores the
text, and no control string can come from it.  Texts that meet in a turn are joined
before they are escaped.  In roles, backslashes and line ends are escaped as well.

Output: one row per segment of a conversation, its formatted text, the loss mask
(spans of code points: the texts of the trained roles without markers and
placeholders) and the attachments.  A segment holds the turns of one stretch of
``segment_turns`` turn numbers and ends early at ``segment_chars``, so a
conversation that holds a third of all rows spreads over tasks by its turn numbers,
and a task holds one segment at a time.  Turns are shuffled once.

``read_segments`` reads the files back and ``parse`` takes roles, parts and loss
texts out of the formatted text alone.  ``digests`` needs a second shuffle only for
conversations of several segments; their texts stream through SHA-256, which is
sequential by definition, in constant memory.

Edge cases: a null text or part text is empty, a null role is the empty role, rows
without conv_id form one conversation (null), rows without turn come first; rows that
repeat a turn are turns of their own, in the order of role, text and parts; a null part
is skipped, a part of unknown type becomes a general attachment; unknown, negative or
non-finite sizes expand to 0 tokens; an empty table gives an empty result; other
columns, and a ``parts`` column that holds no typed structs, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import with_columns_of, written

BROADCAST_ROWS = 1 << 17        # ids of 8 bytes
PART_FIELDS = {"type": "string", "text": "string", "ref": "string", "width": "int", "height": "int",
               "seconds": "double", "pages": "int"}
SEGMENTS = ("conv_id bigint, block bigint, part int, n_turns bigint, text string, n_chars bigint, expanded_tokens bigint, "
            "loss array<struct<start: bigint, length: bigint>>, "
            "attachments array<struct<turn: int, at: bigint, kind: string, ref: string, tokens: bigint>>")
TURNS = ("conv_id bigint, block bigint, part int, place int, role string, text string, loss_text string, "
         "parts array<struct<type: string, text: string, ref: string, tokens: bigint>>")
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass(frozen=True)
class Template:
    """Markers, trained roles, and what attachments expand to."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    placeholders: dict = field(default_factory=lambda: {
        "image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "other": "<|attachment|>"})
    trained: tuple = ("assistant",)
    patch: int = 14                     # pixels a side of an image token
    audio_rate: float = 25.0            # tokens a second
    page_tokens: int = 1024             # tokens a page

    def __post_init__(self):
        marks = [self.start, self.end, *self.placeholders.values()]
        if len(set(marks)) < len(marks) or not all(m.startswith("<|") for m in marks):
            raise ValueError("control strings must differ and begin with <|")


class Flattener:
    """Visits the parts of one turn: ``pieces`` are (kind, content) in order."""

    def __init__(self, template: Template):
        self.template = template
        self.pieces: list[tuple[str, str]] = []
        self.attachments: list[tuple[int, str, str | None, int]] = []   # place among the pieces, kind, reference, tokens

    def visit(self, part: dict | None) -> None:
        if part is not None:
            kind = part.get("type") or ("text" if part.get("text") is not None else "other")
            getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        if self.pieces and self.pieces[-1][0] == "text":
            text = self.pieces.pop()[1] + text
        self.pieces.append(("text", text))

    def visit_image(self, part: dict) -> None:
        sides = [part.get("width") or 0, part.get("height") or 0]
        self._attach("image", part, math.prod(-(-max(s, 0) // self.template.patch) for s in sides))

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        self._attach("audio", part, math.ceil(max(seconds, 0.0) * self.template.audio_rate) if math.isfinite(seconds) else 0)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(part.get("pages") or 0, 0) * self.template.page_tokens)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((len(self.pieces), kind, part.get("ref"), tokens))
        self.pieces.append((kind, self.template.placeholders[kind]))


def format_turn(template: Template, role: str, parts: list) -> tuple[str, list, list]:
    """Formatted text, loss spans and attachments (at, kind, ref, tokens) of a turn."""
    flat = Flattener(template)
    for p in parts:
        flat.visit(p)
    out, spans, starts = [f"{template.start}{escape_role(role)}\n"], [], []
    at = len(out[0])
    for kind, content in flat.pieces:
        content = escape(content) if kind == "text" else content
        starts.append(at)
        if kind == "text" and content and role in template.trained:
            spans.append((at, len(content)))
        out.append(content)
        at += len(content)
    out.append(f"{template.end}\n")
    return "".join(out), spans, [(starts[k], kind, ref, tokens) for k, kind, ref, tokens in flat.attachments]


def parse(template: Template, text: str, loss: list, attachments: list) -> list[tuple[str, list, str]]:
    """(role, parts, loss text) of each turn of a formatted segment."""
    turn = re.compile(rf"{re.escape(template.start)}([^\n]*)\n(.*?){re.escape(template.end)}\n", re.S)
    marks = {v: k for k, v in template.placeholders.items()}
    split = re.compile("(" + "|".join(map(re.escape, marks)) + ")")
    out, at, given, spans, s = [], 0, iter(attachments), loss, 0
    for m in turn.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at, parts = m.end(), []
        for piece in split.split(m[2]):
            if piece in marks:
                a = next(given)
                parts.append({"type": marks[piece], "text": None, "ref": a["ref"], "tokens": a["tokens"]})
            elif piece:
                parts.append({"type": "text", "text": unescape(piece), "ref": None, "tokens": None})
        masked = []
        while s < len(spans) and spans[s]["start"] < at:
            masked.append(unescape(text[spans[s]["start"]:spans[s]["start"] + spans[s]["length"]]))
            s += 1
        out.append((unescape_role(m[1]), parts, "".join(masked)))
    if at != len(text):
        raise ValueError(f"no turn at {at}")
    return out


def _parts_of(df: DataFrame):
    """The typed parts as structs of PART_FIELDS; null where there are none."""
    kind = dict((f.name, f.dataType) for f in df.schema.fields).get("parts")
    wanted = f"array<struct<{', '.join(f'{n}: {t}' for n, t in PART_FIELDS.items())}>>"
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "type" in kind.elementType.names):
        return F.lit(None).cast(wanted)
    have = set(kind.elementType.names)

    def typed(p):
        return F.when(p.isNotNull(), F.struct(*[(p[n] if n in have else F.lit(None)).cast(t).alias(n) for n, t in PART_FIELDS.items()]))
    return F.transform("parts", typed)


def format_chat(conversations: DataFrame, template: Template | None = None, segment_turns: int = 256,
                segment_chars: int = 1 << 20) -> DataFrame:
    """SEGMENTS rows of the conversations (conv_id, turn, role, text or parts)."""
    template = template or Template()
    rows = with_columns_of(conversations, ["conv_id", "turn", "role", "text"])
    if "parts" in conversations.columns:
        rows = conversations.select(*[F.col(c) if c in conversations.columns else F.lit(None).alias(c) for c in rows.columns],
                                    _parts_of(conversations).alias("parts"))
    else:
        rows = rows.withColumn("parts", _parts_of(conversations))
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("text").cast("string").alias("text"), "parts")
    block = F.expr(f"(turn - pmod(turn, {int(segment_turns)})) div {int(segment_turns)}")
    rows = rows.withColumn("block", block).repartition("conv_id", "block").sortWithinPartitions(
        "conv_id", "block", "turn", "role", "text", "parts").select("conv_id", "block", "role", "text", "parts")
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(T.StructType.fromDDL(SEGMENTS))

    def run(batches):
        done, held = [], 0
        key, part, seg = None, 0, None

        def closed():
            (conv, block), (texts, chars, loss, found) = key, seg
            return {"conv_id": conv, "block": block, "part": part, "n_turns": len(texts), "text": "".join(texts), "n_chars": chars,
                    "expanded_tokens": sum(a["tokens"] for a in found), "loss": loss, "attachments": found}

        for b in batches:
            for r in b.to_pylist():
                parts = r["parts"] if r["parts"] is not None else [{"type": "text", "text": r["text"]}]
                text, spans, found = format_turn(template, r["role"], parts)
                same = seg is not None and key == (r["conv_id"], r["block"])
                full = same and (len(seg[0]) >= segment_turns or seg[1] + len(text) > segment_chars)
                if seg is not None and (full or not same):
                    done.append(closed())
                    held += seg[1]
                if full:
                    part, seg = part + 1, ([], 0, [], [])
                elif not same:
                    key, part, seg = (r["conv_id"], r["block"]), 0, ([], 0, [], [])
                texts, at, loss, all_found = seg
                loss += [{"start": at + s, "length": n} for s, n in spans]
                all_found += [{"turn": len(texts), "at": at + p, "kind": k, "ref": ref, "tokens": n} for p, k, ref, n in found]
                texts.append(text)
                seg = (texts, at + len(text), loss, all_found)
                if len(done) >= 512 or held >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done, held = [], 0
        if seg is not None:
            done.append(closed())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return rows.mapInArrow(run, SEGMENTS)


def write_segments(segments: DataFrame, folder: str) -> None:
    segments.write.option("compression", "zstd").parquet(folder)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(folder)


def read_turns(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """TURNS rows parsed out of formatted segments."""
    template = template or Template()
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(T.StructType.fromDDL(TURNS))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                turns = parse(template, r["text"], r["loss"], r["attachments"])
                yield pa.RecordBatch.from_pylist([
                    {"conv_id": r["conv_id"], "block": r["block"], "part": r["part"], "place": k, "role": role, "loss_text": masked,
                     "text": "".join(p["text"] for p in parts if p["type"] == "text"), "parts": parts}
                    for k, (role, parts, masked) in enumerate(turns)], schema=schema)

    return segments.select("conv_id", "block", "part", "text", "loss", "attachments").mapInArrow(run, TURNS)


class Digest:
    """SHA-256 and counts of a conversation, fed with its segments in order."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def feed(self, template: Template, r: dict) -> None:
        for role, parts, masked in parse(template, r["text"], r["loss"], r["attachments"]):
            text = "".join(p["text"] for p in parts if p["type"] == "text")
            self.turns.update(f"{role}\n{text}\n".encode())
            self.loss.update(masked.encode())
            self.n_turns, self.loss_chars = self.n_turns + 1, self.loss_chars + len(masked)
        self.formatted_chars += len(r["text"])

    def row(self, conv_id) -> dict:
        return {"conv_id": conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars}


def _digest_runs(segments: DataFrame, template: Template, whole: bool) -> DataFrame:
    """A DIGESTS row per run of one conversation's segments (``whole``), or per segment."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(T.StructType.fromDDL(DIGESTS))

    def run(batches):
        key, digest = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if digest is not None and not (whole and key == r["conv_id"]):
                    out.append(digest.row(key))
                    digest = None
                if digest is None:
                    key, digest = r["conv_id"], Digest()
                digest.feed(template, r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([digest.row(key)], schema=schema)

    return segments.select("conv_id", "text", "loss", "attachments").mapInArrow(run, DIGESTS)


def digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One DIGESTS row per conversation.  A conversation of one segment is done
    where it lies; the segments of the others meet, sorted, in a second pass."""
    template = template or Template()
    each = written(_digest_runs(segments, template, whole=False), "chat-digests")
    per = each.groupBy("conv_id").agg(F.count("*").alias("segments"), *[F.first(c).alias(c) for c in each.columns[1:]])
    single = per.filter("segments = 1").select(each.columns)
    several = per.filter("segments > 1").select(F.col("conv_id").alias("several"))
    if several.count() <= BROADCAST_ROWS:       # else the segments are shuffled to meet their ids
        several = F.broadcast(several)
    rest = segments.join(several, F.col("conv_id").eqNullSafe(F.col("several")), "left_semi")
    rest = rest.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return single.unionByName(_digest_runs(rest, template, whole=True))
