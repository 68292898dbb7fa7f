"""SentencePiece encoding and decoding with source offsets.

The text is normalised here, by the longest prefix that the model's compiled character map knows at each place, and each
normalised byte remembers the source byte that it came from. The sentencepiece library turns the text as it is, which it
normalises in the same way, into ids; the lengths of the pieces then project every piece onto the normalised text, and
through the alignment onto the bytes of the original.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb

from .common import map_texts

_SPACE = "▁"


class CharacterMap:
    """A compiled character map: a double-array trie from byte sequences to places in a pool of replacements.

    The layout is that of the model file: the trie's length in bytes as a little-endian 32-bit integer, its 32-bit units,
    then the pool, in which every replacement ends with a zero byte.
    """

    def __init__(self, blob: bytes) -> None:
        n = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
        self.pool = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known sequence that starts there, and what replaces it."""
        units, found = self.units, None
        node = self._child_base(0, units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node = self._child_base(node, unit)
            if unit >> 8 & 1:  # a value hangs below
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if not found:
            return None
        return found[0], self.pool[found[1] : self.pool.index(0, found[1])]

    @staticmethod
    def _child_base(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class Encoder:
    """Encodes and decodes texts under one model file."""

    def __init__(self, path: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = model_pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.squeeze, self.prefix = rules.remove_extra_whitespaces, rules.add_dummy_prefix
        if not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that leave white space as it is, or that put it after words, aren't supported")
        self.byte = np.array([p.type == model_pb.ModelProto.SentencePiece.BYTE for p in spec.pieces])
        self.unknown = self.sp.unk_id()
        # Normalised length in bytes of each piece; control pieces have none, and byte pieces stand for one byte.
        hidden = {model_pb.ModelProto.SentencePiece.CONTROL, model_pb.ModelProto.SentencePiece.UNKNOWN}
        self.length = np.array([1 if p.type == model_pb.ModelProto.SentencePiece.BYTE else 0 if p.type in hidden else len(p.piece.encode()) for p in spec.pieces], np.int64)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, with the space mark, and for each the source byte where what it stands for begins; one more
        entry says where the source ends. Replaced sequences point at their first byte."""
        source = text.encode()
        if self.map is None and not self.squeeze:
            b = np.frombuffer(source, np.uint8)
            space = b == 32
            if space.any():
                width = np.where(space, 3, 1)
                align = np.repeat(np.arange(len(b)), width)
                out = source.replace(b" ", _SPACE.encode())
            else:
                align, out = np.arange(len(b)), source
            align = np.append(align, len(b))
        else:
            pieces: list[tuple[bytes, int]] = []
            at = 0
            while at < len(source):
                if self.map and (hit := self.map.longest(source, at)):
                    size, new = hit
                else:
                    size = 1 + (source[at] >= 0xC0) + (source[at] >= 0xE0) + (source[at] >= 0xF0)
                    new = source[at : at + size]
                if new:
                    pieces.append((new, at))
                at += size
            if self.squeeze:
                pieces = _squeezed(pieces)
            out = b"".join(p for p, _ in pieces).replace(b" ", _SPACE.encode())
            align = np.array([a for p, a in pieces for _ in range(len(p.replace(b" ", _SPACE.encode())))] + [len(source)], np.int64)
        if self.prefix and out:
            out = _SPACE.encode() + out
            align = np.concatenate([np.full(3, align[0]), align])
        return out, align

    def encode(self, text: str | None, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): for each piece the bytes [begin, end) of the original that it covers, and last, if asked
        for, the end id with an empty span at the end."""
        text = text or ""
        ids = np.array(self.sp.encode(text), np.int32)
        out, align = self.normalise(text)
        lengths = self.length[ids]
        unknown = ids == self.unknown
        if unknown.any():
            lengths = self._unknown_lengths(text)
        edge = np.concatenate([[0], np.cumsum(lengths)])
        # Where the pieces don't add up to the text as it is normalised here, the library's own places are taken.
        begins, ends = (align[edge[:-1]], align[edge[1:]]) if edge[-1] == len(out) else self._library_places(text)
        if end:
            size = len(text.encode())
            ids, begins, ends = np.append(ids, np.int32(self.sp.eos_id())), np.append(begins, size), np.append(ends, size)
        return ids, begins.astype(np.int32), ends.astype(np.int32)

    def _unknown_lengths(self, text: str) -> np.ndarray:
        return np.array([len(p.encode()) for p in self.sp.encode(text, out_type=str)], np.int64)

    def _library_places(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that each piece covers as the library tells them."""
        pieces = self.sp.encode(text, return_type="proto").pieces
        return np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


def _squeezed(pieces: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Without white space at either end, and with runs of spaces made one."""
    out: list[tuple[bytes, int]] = []
    for new, at in pieces:
        for i in range(len(new)):
            c = new[i : i + 1]
            if c != b" " or (out and out[-1][0] != b" "):
                out.append((c, at))
    while out and out[-1][0] == b" ":
        out.pop()
    return out


#: What emit() makes of a text's ids, begins and ends: one value for each field.
Emit = Callable[[Encoder, str, np.ndarray, np.ndarray, np.ndarray], tuple]


def encode_texts(docs: DataFrame, keys: list[str], model: str, text_col: str = "text", emit: Emit | None = None, fields: list[tuple[str, pa.DataType]] | None = None, schema: str | None = None) -> DataFrame:
    """The key columns and, of each text, ids, begins and ends (arrays of int): pieces and the original bytes they cover.

    model is the path of the model file, the same on every executor. emit, fields and schema derive other columns from
    them in the same task. A null text counts as empty and has the end id only. Rows are independent: repeated rows, ties
    and null keys change nothing; columns other than keys and text aren't read. An empty table gives none.
    """
    if emit is None:
        kinds = pa.list_(pa.int32())
        emit, fields, schema = (lambda _, __, *x: x), [("ids", kinds), ("begins", kinds), ("ends", kinds)], "ids array<int>, begins array<int>, ends array<int>"

    def make():
        encoder = Encoder(model)

        def work(texts: list) -> list:
            rows = [emit(encoder, t or "", *encoder.encode(t)) for t in texts]
            return list(zip(*rows, strict=True)) if rows else [[] for _ in fields]

        return work

    return map_texts(docs, make, keys, text_col, fields, schema, step=500)


def decode_ids(encoded: DataFrame, keys: list[str], model: str, ids_col: str = "ids") -> DataFrame:
    """The key columns and text, what each row's ids stand for: null for null ids, empty for none. Rows are independent, so
    repeated rows come out each; keys may have any names but text; an empty table gives none."""
    kept = {k: encoded.schema[k].dataType.simpleString() for k in keys}

    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            ids = b.column(len(keys)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([None if x is None else sp.decode(x) for x in ids], pa.string())], names=[*keys, "text"])

    return encoded.select(*[f"`{k}`" for k in keys], f"`{ids_col}`").mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in kept.items()), "text string"]))
