"""Token ids in binary segments of patched frame-of-reference blocks.

Texts are tokenized, an end id closes each document, and the id stream, in
ascending doc_id order, is cut into segments. A segment is one binary image:

    header   magic "PWID", version u16, block length u16, ids u64, documents u32, blocks u32
    table    doc_id i64, known u8, ids u32 of each document
    index    byte offset u32 of each block's start, then of the end
    blocks   minimum u32, width u8, exceptions u8, packed offsets, exception places u8, exception high parts u32

A block subtracts its minimum and packs the offsets at the width that holds
``percentile`` of them; what is wider keeps its low bits in place and its high
part in the exception list. Segments are rows of a Parquet table, so writing
commits as a whole, survives lost executors and works on any store Spark
reaches; the index makes each block readable by itself.

Rows of one doc_id go by their text, null ids come first, null texts are
empty (just the end id), repeated rows are kept and an empty table gives an
empty file. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.common import stored

BLOCK, SEGMENT = 128, 1 << 18
#: Words whose ids a Python worker keeps at most; beyond it the cache starts anew.
CACHE = 500_000
_token_id = attrgetter("id")
_HEAD = struct.Struct("<4sHHQII")
_BLOCK = struct.Struct("<IBB")


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of a text word by word: this tokenizer's rules never reach across ASCII white space, so words can be kept.

    A word of lower-case Latin letters, with or without closing punctuation, is
    just what the tokenizer hands its model, so the model is asked directly;
    any other word goes through the whole tokenizer.
    """

    _plain = re.compile(rb"([a-z\x80-\xff]*)([.,;:!?]*)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def _model_ids(self, part: bytes) -> bytes:
        text = part.decode() if part.isascii() else "".join([self.letters[b] for b in part])
        return array("I", map(_token_id, self.model.tokenize(text))).tobytes()

    def _direct(self, word: bytes) -> bytes | None:
        """Ids of a plain word, None for any other."""
        m = self._plain.fullmatch(word)
        if not m:
            return None
        stem, rest = m.groups()
        if not stem.isascii():
            text = stem.decode()
            if not (text.isalpha() and max(text) < "\u0250" and text == text.lower()):
                return None
        if not stem or not rest:
            return self._model_ids(word)
        known, end = self.known, self.known.get(rest)
        if end is None:
            end = known[rest] = self._model_ids(rest)
        begin = known.get(stem)
        if begin is None:
            begin = known[stem] = self.older.get(stem) or self._model_ids(stem)
        return begin + end

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. When the cache is full the generation before last is dropped."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older, odd = self.known, self.older, []
        known[b""] = b""
        out = list(map(known.get, words))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            ids = known.get(w) or older.get(w) or self._direct(w)  # stems become known on the way
            if ids is None:
                odd.append(i)
            else:
                out[i] = known[w] = ids
        for i, e in zip(odd, self.tokenizer.encode_batch([words[i].decode() for i in odd], add_special_tokens=False)):
            out[i] = known[words[i]] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        # letters may be lowered first unless a combining mark or a special token's brackets could tell
        low = [t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        split = pc.ascii_split_whitespace(pa.array(low, pa.binary()).cast(pa.string()))
        coded = split.values.dictionary_encode()
        code = coded.indices.to_numpy()
        ids = self._ids(coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(length) - length
        size = length[code]
        end = np.concatenate([[0], np.cumsum(size)])
        every = np.frombuffer(b"".join(ids), "<u4")[np.arange(end[-1]) + np.repeat(start[code] - end[:-1], size)]
        return np.split(every, end[split.offsets.to_numpy()[1:-1]]) if texts else []


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """Patched frame-of-reference images of consecutive blocks of ids; the last is filled up with its first id."""
    n = -(-len(ids) // BLOCK)
    grid = np.empty(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[(n - 1) * BLOCK] if n else 0
    grid = grid.reshape(n, BLOCK)
    least = grid.min(axis=1)
    apart = grid - least[:, None]
    wanted = np.partition(apart, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))]
    width = np.where(wanted > 0, np.floor(np.log2(np.maximum(wanted, 1))).astype(np.int64) + 1, 0)
    out: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        part = apart[rows]
        kind, room = ("<u2", 16) if w <= 16 else ("<u4", 32)
        bits = np.unpackbits(part.astype(kind).view(np.uint8), bitorder="little").reshape(len(rows), BLOCK, room)[:, :, :w]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").tobytes()
        high = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
        row, place = np.nonzero(high)
        odd = np.bincount(row, minlength=len(rows))
        to = np.cumsum(odd)
        places, highs, size = place.astype(np.uint8).tobytes(), high[row, place].astype("<u4").tobytes(), BLOCK * w // 8
        for i, (at, low, k, b) in enumerate(zip(rows.tolist(), least[rows].tolist(), odd.tolist(), to.tolist())):
            out[at] = _BLOCK.pack(low, w, k) + packed[i * size : (i + 1) * size] + places[b - k : b] + highs[4 * (b - k) : 4 * b]
    return out


def unpack_blocks(image: bytes, offsets: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``offsets[:-1]`` and end at ``offsets[-1]``, fillers included."""
    n, offsets = len(offsets) - 1, offsets.astype(np.int64)
    grid = np.zeros((n, BLOCK), np.uint32)
    if not n:
        return grid.reshape(-1)
    raw, starts = np.frombuffer(image, np.uint8), offsets[:-1]
    least = np.ascontiguousarray(raw[starts[:, None] + np.arange(4)]).view("<u4").ravel()
    width, odd = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        if w:
            packed = raw[starts[rows, None] + (_BLOCK.size + np.arange(size))]
            kind, room = ("<u2", 16) if w <= 16 else ("<u4", 32)
            bits = np.zeros((len(rows), BLOCK, room), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed.reshape(-1), bitorder="little").reshape(len(rows), BLOCK, w)
            grid[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view(kind)
    # exceptions of all blocks: their places, then their high parts
    row = np.repeat(np.arange(n), odd)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(odd) - odd, odd)
    first = (starts + _BLOCK.size + BLOCK * width // 8)[row]
    high = np.ascontiguousarray(raw[(first + odd[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    grid[row, raw[first + nth]] |= high << width[row].astype(np.uint32)
    grid += least[:, None]
    return grid.reshape(-1)


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    blocks = pack_blocks(ids)
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is not None for d in doc_ids) + np.array(lengths, "<u4").tobytes()
    start = _HEAD.size + len(table) + 4 * (len(blocks) + 1)
    index = start + np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)
    return _HEAD.pack(b"PWID", 1, BLOCK, len(ids), len(doc_ids), len(blocks)) + table + index.astype("<u4").tobytes() + b"".join(blocks)


def read_segment(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and the whole id stream of a segment."""
    magic, version, block, n_ids, n_docs, n_blocks = _HEAD.unpack_from(image)
    if (magic, version, block) != (b"PWID", 1, BLOCK):
        raise ValueError("not a segment of this format")
    at = _HEAD.size
    ids = np.frombuffer(image, "<i8", n_docs, at).tolist()
    known = image[at + 8 * n_docs : at + 9 * n_docs]
    lengths = np.frombuffer(image, "<u4", n_docs, at + 9 * n_docs)
    offsets = np.frombuffer(image, "<u4", n_blocks + 1, at + 13 * n_docs)
    return [d if k else None for d, k in zip(ids, known)], lengths, unpack_blocks(image, offsets)[:n_ids]


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """The written table of segments: part and segment in stream order, ids and documents in it, and its image."""
    schema = "part int, segment int, n_ids bigint, n_docs bigint, image binary"
    ordered = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = encoder(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids, pieces, size = [], [], 0

        def flush():
            image = write_segment(doc_ids, [len(p) for p in pieces], np.concatenate(pieces))
            row = [[part], [segment], [size], [len(doc_ids)], [image]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                for doc_id, ids in zip(rows.column(0).to_pylist(), words.encode(rows.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    pieces.append(np.append(ids, np.uint32(end_id)))
                    size += len(ids) + 1
                    if size >= SEGMENT:
                        yield flush()
                        doc_ids, pieces, size, segment = [], [], 0, segment + 1
        if doc_ids:
            yield flush()

    return stored(ordered.mapInArrow(run, schema))


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from written segments."""
    schema = "part int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, image in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, lengths, ids = read_segment(image)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw, starts = memoryview(ids.astype("<u4").tobytes()), ends - lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(doc_ids)
                columns = [pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    found = segments.select("part", "segment", "image").mapInArrow(run, schema)
    # a running sum over parts (as many as there were partitions), then over the segments of each part
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("segment")
    bases = segments.select("part", "segment", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("inner_start"))
    bases = bases.join(before, "part").select("part", "segment", (F.col("part_start") + F.col("inner_start")).alias("base"))
    return found.join(bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
