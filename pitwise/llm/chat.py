"""Chat formatting of conversations whose turns hold typed content parts.

A visitor flattens the parts of a turn in order: text is escaped, an image,
audio clip or document leaves a placeholder and is recorded with its reference,
place and expanded token count. Every turn reads ``<|turn|>role<|body|>text<|end|>``.
Control strings inside texts are broken up by an escape that is taken back
when the output is read, so no text can forge a turn; neighbouring text parts are
escaped as one, so none can form across their border either. The loss mask covers
the texts of assistant turns, not their placeholders.

A conversation is a stream: its turns are sorted in one partition, formatted
into chunks of bounded size and never gathered whole, so a conversation may be
of any length. Turns go by ``turn`` (nulls first), then role and text; repeated
rows stay repeated turns. A null text or role is empty, a null conv_id is a
conversation of its own, and an empty table gives none. A null part is an empty
text, a part of an unknown type counts as its text, null lists have no parts, and
sizes that are null, negative or not finite count as none (an attachment has one
token at least). Only the four named columns (and ``parts``, if asked for) are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Our own marks and those of common chat templates.
CONTROL = (TURN, BODY, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
CHUNK = 1 << 18
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
_OUT = "conv_id bigint, chunk bigint, body string, loss array<struct<start: bigint, end: bigint>>, attachments array<struct<turn: bigint, kind: string, ref: string, start: bigint, tokens: bigint>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("turn", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]))
_marks = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROL)) + r")[<\[]")
_places = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))


def escaped(text: str) -> str:
    return _marks.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\.", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else "", text, flags=re.S) if "\\" in text else text


def _sound(amount: float | None) -> float:
    return amount if amount is not None and math.isfinite(amount) and amount > 0 else 0


class Visitor:
    """Flattens content parts; token counts follow tiles of an image, frames of a clip and pages of a document."""

    def __init__(self, tile: int = 28, per_second: int = 25, per_page: int = 1024):
        self.tile, self.per_second, self.per_page = tile, per_second, per_page

    def visit(self, part: dict | None) -> tuple[str, dict | None]:
        part = part or {"type": "text", "text": ""}
        return getattr(self, "visit_" + (part["type"] or "text"), self.visit_text)(part)

    def visit_text(self, part: dict):
        return part["text"] or "", None

    def visit_image(self, part: dict):
        tiles = math.ceil(_sound(part["width"]) / self.tile) * math.ceil(_sound(part["height"]) / self.tile)
        return PLACEHOLDERS["image"], {"kind": "image", "ref": part["ref"], "tokens": max(1, tiles)}

    def visit_audio(self, part: dict):
        return PLACEHOLDERS["audio"], {"kind": "audio", "ref": part["ref"], "tokens": max(1, math.ceil(_sound(part["seconds"]) * self.per_second))}

    def visit_document(self, part: dict):
        return PLACEHOLDERS["document"], {"kind": "document", "ref": part["ref"], "tokens": max(1, _sound(part["pages"])) * self.per_page}

    def turn(self, role: str, parts: list[dict | None]) -> tuple[str, list[tuple[int, int]], list[dict]]:
        """The formatted turn, the spans of its texts, and its attachments by place."""
        out, spans, attached = [TURN + escaped(role) + BODY], [], []
        size = len(out[0])
        for is_text, visited in groupby(map(self.visit, parts), key=lambda v: v[1] is None):
            visited = list(visited)
            # neighbouring texts are escaped as one: no control string may form across their border
            pieces = [escaped("".join(p for p, _ in visited))] if is_text else [p for p, _ in visited]
            if is_text and pieces[0]:
                spans.append((size, size + len(pieces[0])))
            for piece, (_, found) in zip(pieces, visited):
                if not is_text:
                    attached.append(found | {"start": size})
                out.append(piece)
                size += len(piece)
        return "".join(out) + END, spans, attached


def format_conversations(rows: DataFrame, parts: str | None = None) -> DataFrame:
    """Chunks of formatted text with loss spans (texts of assistants) and attachments, in code points of the chunk.

    ``parts`` names a column of typed parts; without it a turn's text is its one part.
    """
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages")])).cast(f"array<{PART}>")
    turns = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text", (F.col(parts).cast(f"array<{PART}>") if parts else text).alias("parts"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor, out = Visitor(), []
        at = body = loss = attached = None
        begun, size = False, 0

        def chunk():
            return at[0], at[1], "".join(body), loss, attached

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), _LOSS, _ATTACHED)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "chunk", "body", "loss", "attachments"])

        for batch in batches:
            for conv_id, turn, role, parts in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or at[0] != conv_id or size >= CHUNK:
                    if begun:
                        out.append(chunk())
                    at = (conv_id, at[1] + 1 if begun and at[0] == conv_id else 0)
                    begun, body, loss, attached, size = True, [], [], [], 0
                piece, spans, found = visitor.turn(role or "", parts or [])
                if role == "assistant":
                    loss += [{"start": size + start, "end": size + end} for start, end in spans]
                attached += [x | {"turn": turn, "start": size + x["start"]} for x in found]
                body.append(piece)
                size += len(piece)
            if out:
                yield batch_of(out)
                out = []
        if begun:
            yield batch_of([chunk()])

    return turns.mapInArrow(run, _OUT)


def bodies_of(body: str) -> Iterator[tuple[str, int, int]]:
    """Role (unescaped), and where the body starts and ends, of every turn of a formatted chunk."""
    at = 0
    while at < len(body):
        if not body.startswith(TURN, at):
            raise ValueError("not a formatted turn")
        middle = body.index(BODY, at)
        end = body.index(END, middle)
        yield unescaped(body[at + len(TURN) : middle]), middle + len(BODY), end
        at = end + len(END)


def turns_of(body: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted chunk, unescaped."""
    for role, start, end in bodies_of(body):
        yield role, unescaped(body[start:end])


def parts_of(body: str, start: int, end: int, attachments: dict[int, dict]) -> list[dict]:
    """The parts of one turn in order: its texts, unescaped, and its attachments (by their places) with reference and tokens."""
    out, at = [], start
    for place in [*_places.finditer(body, start, end), None]:
        stop = place.start() if place else end
        if stop > at:
            out.append({"type": "text", "text": unescaped(body[at:stop]), "ref": None, "start": at, "tokens": None})
        if place:
            found = attachments[stop]
            if PLACEHOLDERS[found["kind"]] != place[0]:
                raise ValueError("an attachment of another kind")
            out.append({"type": found["kind"], "text": None, "ref": found["ref"], "start": stop, "tokens": found["tokens"]})
            at = place.end()
    return out


def read_parts(chunks: DataFrame) -> DataFrame:
    """conv_id, nth (of its turns), role and parts, parsed from the formatted chunks; ``start`` is a code point of the chunk. Neighbouring texts are one part."""
    schema = "conv_id bigint, nth bigint, role string, parts array<struct<type: string, text: string, ref: string, start: bigint, tokens: bigint>>"
    ordered = chunks.select("conv_id", "chunk", "body", "attachments").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth = (), 0
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())])))
        for batch in batches:
            for conv_id, _, body, attachments in zip(*batch.columns):
                conv_id, body = conv_id.as_py(), body.as_py()
                by_place = {a["start"]: a for a in attachments.as_py()}
                nth = nth if last == (conv_id,) else 0
                last, rows = (conv_id,), []
                for role, start, end in bodies_of(body):
                    rows.append((conv_id, nth, role, parts_of(body, start, end, by_place)))
                    nth += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "nth", "role", "parts"])

    return ordered.mapInArrow(run, schema)


def read_conversations(chunks: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted chunks in order."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    ordered = chunks.select("conv_id", "chunk", "body", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def done(state):
            conv_id, n, turns, chars, loss, size = state
            return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for conv_id, _, body, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        out.append(done(now))
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(body):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescaped(body[span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(body)
            if out:
                yield batch_of(out)
                out = []
        if now is not None:
            yield batch_of([done(now)])

    return ordered.mapInArrow(run, schema)
