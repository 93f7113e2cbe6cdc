"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by the model's own rules (the longest prefix found in its
compiled character map, a dummy prefix, escaped spaces) while every normalised
byte keeps the offset of the byte it came from; piece boundaries in the
normalised text then project each piece to its span of original bytes.

Where no piece of the model reaches across a space or a line end, the text is
encoded in such runs, each distinct run once for a worker's cache; the library
sees the same merges either way. Models with a character map or with such
pieces are given whole texts. Byte fallback is needed, so that every piece has
a known length.

A null text is empty and gives just the end id. Null and repeated doc_ids keep
their rows, an empty table gives none, and texts of any length are encoded
whole. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs whose ids a Python worker keeps at most; beyond it the cache starts anew.
CACHE = 150_000
SPACE = "▁"
_runs = re.compile(r" +[^ \n]*|\n[^ \n]*")


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 and the strings it leads to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at`` and its replacement."""
        if not self.units:
            return None
        best, node = None, self._offset(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[i]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if not model.trainer_spec.byte_fallback:
            raise ValueError("the model has no byte fallback, so unknown pieces have no length")
        self.rules, self.map = model.normalizer_spec, CharacterMap(model.normalizer_spec.precompiled_charsmap)
        pieces = [p.piece for p in model.pieces]
        byte = model.SentencePiece.Type.BYTE
        self.length = np.array([1 if p.type == byte else len(p.piece.encode()) if p.type == model.SentencePiece.Type.NORMAL else 0 for p in model.pieces], np.int64)
        plain = self.rules.add_dummy_prefix and self.rules.escape_whitespaces and not self.rules.remove_extra_whitespaces
        self.by_run = plain and not self.map.units and not any(re.search(f"[^{SPACE}]{SPACE}|\n|.\n", p) for p in pieces)
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and their end) the offset in the text's bytes."""
        raw, mark, rules = text.encode(), SPACE.encode(), self.rules
        if not raw:
            return b"", np.zeros(1, np.int64)
        mark = mark if rules.escape_whitespaces else b" "
        if not self.map.units and not rules.remove_extra_whitespaces:
            wide = np.where(np.frombuffer(raw, np.uint8) == 32, len(mark), 1)
            align = np.repeat(np.arange(len(raw)), wide)
            out = raw.replace(b" ", mark)
        else:
            parts, align, at, after_space = [], [], 0, rules.remove_extra_whitespaces
            while at < len(raw):
                size = 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
                size, piece = self.map.longest(raw, at) or (size, raw[at : at + size])
                if rules.remove_extra_whitespaces:
                    if after_space:
                        piece = piece.lstrip(b" ")
                    after_space = piece.endswith(b" ") if piece else after_space
                piece = piece.replace(b" ", mark)
                parts.append(piece)
                align += [at] * len(piece)
                at += size
            out, align = b"".join(parts), np.array(align, np.int64)
            while rules.remove_extra_whitespaces and out.endswith(mark):
                out, align = out[: -len(mark)], align[: -len(mark)]
        if rules.add_dummy_prefix and out:
            out, align = mark + out, np.concatenate([np.zeros(len(mark), np.int64), align])
        return out, np.append(align, len(raw))

    def _fresh(self, run: str) -> tuple[int, ...]:
        if run == " ":
            return (self.lib.piece_to_id(SPACE),)
        if run[0] == " ":
            return tuple(self.lib.encode(run[1:]))
        return tuple(self.lib.encode(run))[1:]

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids without an end id, and the same as decimal numbers that end in a space each."""
        if not self.by_run:
            ids = self.lib.encode(text)
            return ids, "".join(f"{i} " for i in ids)
        if not text:
            return [], ""
        known, found = self.known, []
        for run in _runs.findall(" " + text.replace(SPACE, " ")):
            got = known.get(run)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = self._fresh(run)
                got = known[run] = (ids, "".join(f"{i} " for i in ids))
            found.append(got)
        return list(chain.from_iterable(f[0] for f in found)), "".join(f[1] for f in found)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """Start and end of each piece in the text's UTF-8 bytes."""
        whole, align = self.normalised(text)
        ends = np.cumsum(self.length[ids]) if ids else np.zeros(0, np.int64)
        if len(ends) and ends[-1] != len(whole):
            raise ValueError("pieces do not cover the normalised text")
        at = align[np.concatenate([[0], ends])]
        return np.stack([at[:-1], at[1:]], axis=1)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str | None) -> PieceEncoder:
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id), starts and ends of each piece in original bytes (the end id's span is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model)
        end = pieces.lib.eos_id()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                ids, starts, ends = [], [], []
                for text in rows.column(1).to_pylist():
                    text = text or ""
                    got = pieces.encode(text)[0]
                    spans, size = pieces.spans(text, got), len(text.encode())
                    ids.append(got + [end])
                    starts.append(np.append(spans[:, 0], size))
                    ends.append(np.append(spans[:, 1], size))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document the number of ids, digests of ids and of the decoded text, and a checksum of the byte spans."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model)
        end = pieces.lib.eos_id()
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids, shown = pieces.encode(text)
                spans = zlib.crc32(pieces.spans(text, ids).astype("<i4").tobytes())
                ids.append(end)
                decoded = pieces.lib.decode(ids)
                out.append((len(ids), hashlib.sha256(f"{shown}{end}".encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), spans))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
