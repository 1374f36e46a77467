"""SentencePiece encoding and decoding that keeps the way back to the original bytes.

A text is normalised by the longest prefixes that the model's compiled character map knows, and each
normalised byte remembers the original byte it came from. Pieces are laid over the normalised bytes, and
their ends are projected back. Merging is the library's own; texts are cut before blanks first where the
vocabulary proves that no piece reaches over such a place, so a word that was seen before is not merged
again.
"""

from __future__ import annotations

import struct
from array import array
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm._shared import table, text_slices

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL = "piece_bpe_32k.model"
CACHED_WORDS = 300_000

KINDS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "begins": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "spans_sha256": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}



def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """The compiled map of a model: a double-array trie over byte strings, and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``data[at:]``."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = step(self.units[0]), None
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[n]:
                break
            unit = self.units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = n + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


@dataclass
class Model:
    """A loaded model with what is needed to lay pieces over normalised bytes."""

    processor: object
    charmap: CharacterMap
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    lengths: np.ndarray  # bytes of each piece in normalised text; 0 for control pieces, -1 if it varies
    by_word: bool
    blank: bytes  # ids of a single blank

    @staticmethod
    def read(data: bytes) -> Model:
        import sentencepiece

        pieces, norm, trainer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        length = {CONTROL: lambda p: 0, BYTE: lambda p: 1, UNKNOWN: lambda p: -1}
        kinds = {kind for _, kind in pieces}
        charmap, squeeze = CharacterMap(norm.get(2, b"")), bool(norm.get(4, 1))
        dummy, escape = bool(norm.get(3, 1)), bool(norm.get(5, 1))
        by_word = (
            trainer.get(3) == 2
            and not charmap.units
            and dummy
            and escape
            and not squeeze
            and not trainer.get(24)
            and BYTE in kinds
            and not kinds & {USER, UNUSED}
            and not any(BLANK in p.lstrip(BLANK) for p, kind in pieces if kind == NORMAL)
        )
        return Model(
            sentencepiece.SentencePieceProcessor(model_proto=data),
            charmap,
            dummy,
            squeeze,
            escape,
            np.array([length.get(kind, lambda p: len(p.encode()))(p) for p, kind in pieces], np.int64),
            by_word,
            array("i", [i for i, (p, _) in enumerate(pieces) if p == BLANK]).tobytes(),
        )

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for the end the original byte."""
        data, blank = text.encode(), BLANK.encode() if self.escape else b" "
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.charmap.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 32, len(blank), 1)
            way = np.append(np.repeat(np.arange(len(raw)), width), len(raw))
            out = data.replace(b" ", blank)
            if self.dummy_prefix:
                out, way = blank + out, np.append(np.zeros(len(blank), way.dtype), way)
            return out, way
        out, way, at, after_blank = bytearray(), [], 0, self.squeeze
        while at < len(data):
            hit = self.charmap.longest(data, at)
            if hit is None:
                n = 1 if data[at] < 0xC0 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = n, data[at : at + n]
            n, put = hit
            if self.squeeze:
                put = put.lstrip(b" ") if after_blank else put
                while b"  " in put:
                    put = put.replace(b"  ", b" ")
            if put and not out and self.dummy_prefix:
                out += blank
                way += [at] * len(blank)
            for b in put:
                one = blank if b == 32 else bytes([b])
                out += one
                way += [at] * len(one)
            if put:
                after_blank = self.squeeze and put.endswith(b" ")
            at += n
        end = len(data)
        while self.squeeze and out.endswith(blank):
            end = way[-len(blank)]
            del out[-len(blank) :], way[-len(blank) :]
        return bytes(out), np.array([*way, end], np.int64)

    def words(self, text: str) -> list[str]:
        """A text cut before its blanks; the blanks of a run but the first belong to the word after it."""
        parts = text.replace(" ", BLANK).split(BLANK)
        if "" not in parts:
            return parts
        joined, blanks = [], 0
        for p in parts[:-1]:
            if p:
                joined.append(BLANK * blanks + p)
                blanks = 0
            else:
                blanks += 1
        return [*joined, BLANK * blanks + parts[-1]]

    def ids(self, texts: list[str], known: dict[str, bytes]) -> list[np.ndarray]:
        """The library's ids of each text, without begin and end. ``known`` keeps words from call to call."""
        if not self.by_word:
            return [np.array(x, np.int32) for x in self.processor.encode(texts, num_threads=1)]
        cut = [self.words(x) if x else [] for x in texts]
        if len(known) > CACHED_WORDS:
            known.clear()
        new = list(set().union(*cut).difference(known))
        known.update((w, array("i", x).tobytes()) for w, x in zip(new, self.processor.encode(new, num_threads=1), strict=True))
        known[""] = self.blank
        return [np.frombuffer(b"".join(map(known.__getitem__, x)), np.int32) for x in cut]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original bytes of each piece: begins and ends."""
        normal, way = self.normalised(text)
        size = self.lengths[ids]
        if (size < 0).any():
            surface = self.processor.encode(text, out_type=str)
            size = np.where(size < 0, [len(p.encode()) for p in surface], size)
        ends = np.cumsum(size)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return way[ends - size], way[ends]


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> Model:
    return Model.read(data)


def _nested(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(
    docs: DataFrame,
    model: bytes,
    outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of each whole text, with begin and end ids, their original byte spans, and the text decoded again.

    Columns: ``doc_id`` and those of ``outputs``: ``n_tokens, ids, begins, ends, decoded``, and the short forms
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers), ``decoded_sha256`` and
    ``spans_sha256`` (of begin and end of each piece in turn, as such integers). A null text is taken as empty: it has the
    begin and end ids only, with empty spans. Begin and end ids span nothing at either end. Repeated rows and null
    ids are given as they come; other columns are not read.

    ``model`` is a model file of some hundred kilobytes; Spark ships it with the task.
    """

    def run(batches):
        own, words = _loaded(model), {}
        first, last = own.processor.bos_id(), own.processor.eos_id()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                ids, begins, ends = [], [], []
                for text, got in zip(texts, own.ids(texts, words), strict=True):
                    b, e = own.spans(text, got)
                    size = len(text.encode())
                    ids.append(np.concatenate(([first], got, [last])).astype("<i4"))
                    begins.append(np.concatenate(([0], b, [size])))
                    ends.append(np.concatenate(([0], e, [size])))
                decoded = [own.processor.decode(x.tolist()) for x in ids]
                make = {
                    "n_tokens": lambda: pa.array(map(len, ids), pa.int64()),  # noqa: B023
                    "ids": lambda: _nested(ids),  # noqa: B023
                    "begins": lambda: _nested(begins),  # noqa: B023
                    "ends": lambda: _nested(ends),  # noqa: B023
                    "decoded": lambda: pa.array(decoded, pa.string()),  # noqa: B023
                    "spans_sha256": lambda: pa.array([sha256(np.stack(x, axis=1).astype("<u4").tobytes()).hexdigest() for x in zip(begins, ends, strict=True)]),  # noqa: B023
                    "ids_sha256": lambda: pa.array([sha256(x.tobytes()).hexdigest() for x in ids]),  # noqa: B023
                    "decoded_sha256": lambda: pa.array([sha256(x.encode()).hexdigest() for x in decoded]),  # noqa: B023
                }
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(make[x]() for x in outputs)], ["doc_id", *outputs]
                )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, ", ".join(["doc_id long", *(f"{x} {KINDS[x]}" for x in outputs)]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, of its decoded text, and of the original bytes that each of its pieces spans."""
    return encode_pieces(
        table(spark, sf_dir, "documents"), model_bytes(), ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    )
