"""Alignment of two tokenizers' tokens over a corpus whose texts are told apart whole.

Texts are shuffled whole, so that each distinct one is encoded and aligned once, with the number of documents that have it.
Both tokenizers cover the same bytes (a space and the text); the offsets where tokens of both end cut them into groups, and
tokens of one group are linked. A chunk of texts brings, once for each pair of ids that it links, how many of its documents
hold it; the pairs are parted by their A id, added up, and answered in the order in which the chunk asked. The measures that
need the whole corpus are then sums over a text's pairs, and documents get the measures of their text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from .bpe import WordKeeper, bpe_encoder
from .common import give_back, materialize, sliced, text_volume
from .keyed import pack, unpack

#: Characters of text in a chunk, of texts that are aligned together, and of text for each part of the pairs.
CHUNK_CHARS, TOGETHER, PART_CHARS = 4_000_000, 1_000_000, 9_000_000
#: Links of a group from which they are counted by distinct ids.
WIDE = 1024
#: Where words may be parted: no piece of a model that passes the check in PieceWords reaches over such a place.
#: The mark that models write for a space counts as one in texts too.
_FINE, _COARSE = regex.compile(r"[ ▁]*\p{L}+|[ ▁]*[^ ▁\p{L}]+|[ ▁]+"), regex.compile(r"[ ▁]*[^ ▁]+|[ ▁]+")
#: Stands after the ids of a word whose pieces aren't its bytes.
_INEXACT = np.uint32(0xFFFFFFFF)
#: Times this odd number, 16-bit ids that are near each other lie far apart, and no two fall together.
_SPREAD = np.uint64(0x9E37)


class PieceWords(WordKeeper):
    """Ids of texts under a piece model that puts a space before them, word by word."""

    def __init__(self, path: str) -> None:
        super().__init__()
        spec = model_pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        if not rules.add_dummy_prefix or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that put a space before texts are supported")
        kind = model_pb.ModelProto.SentencePiece
        self.bytes = [bytes([int(p.piece[3:-1], 16)]) if p.type == kind.BYTE else p.piece.replace("▁", " ").encode() for p in spec.pieces]
        real = [p.piece.replace("▁", " ") for p in spec.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED)]
        # Words are only right where nothing but merges within them decides: byte pair models that don't change texts.
        plain = spec.trainer_spec.model_type == model_pb.TrainerSpec.BPE and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
        self.parted = next((x for x in (_FINE, _COARSE) if plain and all(len(x.findall(p)) == 1 for p in real)), None)
        if self.parted:
            rules.add_dummy_prefix = False  # the space is put before the text here
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    def words(self, text: str) -> list[str]:
        return self.parted.findall(" " + text) if self.parted else [" " + text]

    def encode_words(self, words: list[str]) -> list[bytes]:
        found = self.model.encode(words if self.parted else [w[1:] for w in words], num_threads=1)
        spelt = self.bytes
        out = []
        for word, ids in zip(words, found, strict=True):
            if b"".join([spelt[i] for i in ids]) != word.encode():
                ids = [*ids, int(_INEXACT)]
            out.append(np.array(ids, "<u4").tobytes())
        return out


class Aligner:
    """Groups and links of texts under a byte-level BPE file (A) and a piece model (B)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = bpe_encoder(a_path, False), PieceWords(b_path)
        size = max(max(self.a.bytes) + 1, len(self.b.bytes))
        if size > 1 << 16:
            raise ValueError("more than 65536 ids")
        self.a_length = np.zeros(size, np.int64)
        for i, x in self.a.bytes.items():
            self.a_length[i] = len(x)
        self.b_length = np.array([len(x) for x in self.b.bytes], np.int64)
        words = [str(i).encode() for i in range(size)]
        #: The digits of ids, with room for what comes after them, and how many there are.
        self.digits = np.array([w.ljust(6, b"\0") for w in words], "S6").view(np.uint8).reshape(-1, 6)
        self.n_digits = np.array([len(w) for w in words], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B; none of either for empty texts and those whose tokens' bytes aren't a space and the text."""
        ids_a = [np.frombuffer(x, "<u4") for x in self.a.packed([" " + t for t in texts])]
        ids_b = []
        nothing = np.empty(0, np.uint32)
        for i, (text, x) in enumerate(zip(texts, self.b.packed(texts), strict=True)):
            b = np.frombuffer(x, "<u4")
            if not text:
                ids_a[i], b = nothing, nothing
            elif len(b) and b.max() == _INEXACT:
                b = b[b != _INEXACT]
                if b"".join([self.b.bytes[j] for j in b]) != (" " + text).encode():
                    ids_a[i], b = nothing, nothing
            ids_b.append(b)
        return ids_a, ids_b

    def align(self, texts: list[str]) -> Aligned:
        return Aligned(self, *self.encode(texts))


class Aligned:
    """Some texts' groups and links: n_a, n_b, n_groups and n_links of each text, and its digest of groups; pairs: for each
    text and distinct pair that it links, ascending, the text's number (pair_text), the pair's key (pair_key) and how many links
    have it (pair_uses)."""

    def __init__(self, aligner: Aligner, ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> None:
        n = len(ids_a)
        count = lambda x: np.array([len(i) for i in x], np.int64)
        self.n_a, self.n_b = count(ids_a), count(ids_b)
        a, b = np.concatenate([np.empty(0, np.uint32), *ids_a]).astype(np.int64), np.concatenate([np.empty(0, np.uint32), *ids_b]).astype(np.int64)
        end_a, end_b = np.cumsum(aligner.a_length[a]), np.cumsum(aligner.b_length[b])
        size = int(end_a[-1]) if len(a) else 0
        if size != (int(end_b[-1]) if len(b) else 0):
            raise ValueError("tokens of one text cover different bytes")
        # Texts follow each other, so a text's last byte is an end of both.
        ends = np.zeros(size + 1, bool)
        ends[end_a] = True
        both = np.zeros(size + 1, bool)
        both[end_b] = True
        both &= ends
        both[0] = False
        number = np.cumsum(both, dtype=np.int32)
        group_a, group_b = number[end_a] - both[end_a], number[end_b] - both[end_b]
        n_groups = int(number[-1])
        per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        text_a, text_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        first_a = np.cumsum(per_a) - per_a
        text_of = text_a[first_a] if n_groups else np.empty(0, np.int64)
        self.n_groups = np.bincount(text_of, minlength=n)
        links = per_a * per_b
        self.n_links = np.bincount(text_of, weights=links, minlength=n).astype(np.int64)
        self._pairs(a, b, per_a, per_b, text_of, group_a)
        self.digests = self._digests(aligner, a, b, per_a, per_b, group_a, group_b, text_of, n)

    def _pairs(self, a: np.ndarray, b: np.ndarray, per_a: np.ndarray, per_b: np.ndarray, text_of: np.ndarray, group_a: np.ndarray) -> None:
        spread_a = (a.astype(np.uint64) * _SPREAD & np.uint64(0xFFFF)) << np.uint64(16)
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        wide = per_a * per_b >= WIDE
        # A row for each link of the groups with few: every token of A with those of B in its group.
        each = np.where(wide[group_a], 0, per_b[group_a]) if len(a) else np.empty(0, np.int64)
        begin = np.cumsum(each) - each
        of_a = np.repeat(np.arange(len(a)), each)
        of_b = np.arange(len(of_a)) - np.repeat(begin, each) + np.repeat(first_b[group_a] if len(a) else each, each)
        text = text_of[group_a[of_a]].astype(np.uint64) if len(of_a) else np.empty(0, np.uint64)
        keys = text << np.uint64(32) | spread_a[of_a] | b[of_b].astype(np.uint64)
        keys.sort()
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        uses = np.diff(edge, append=len(keys))
        keys = keys[edge]
        if wide.any():
            more, counts = [keys], [uses]
            for g in np.flatnonzero(wide):
                x, n_x = np.unique(spread_a[first_a[g] : first_a[g] + per_a[g]], return_counts=True)
                y, n_y = np.unique(b[first_b[g] : first_b[g] + per_b[g]], return_counts=True)
                more.append((np.uint64(text_of[g]) << np.uint64(32) | x[:, None] | y.astype(np.uint64)[None, :]).ravel())
                counts.append((n_x[:, None] * n_y[None, :]).ravel())
            keys, at = np.unique(np.concatenate(more), return_inverse=True)
            uses = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        self.pair_text, self.pair_key, self.pair_uses = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF), uses

    @staticmethod
    def _digests(aligner: Aligner, a: np.ndarray, b: np.ndarray, per_a: np.ndarray, per_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, text_of: np.ndarray, n: int) -> list[str]:
        """SHA-256 of each text's groups, written a1,a2|b1;a3|b2,b3; nothing for texts without tokens."""
        sum_a, sum_b = np.cumsum(per_a), np.cumsum(per_b)
        tokens = np.empty(len(a) + len(b), np.int64)
        after = np.full(len(tokens), ord(","), np.uint8)
        tokens[np.arange(len(a)) + (sum_b - per_b)[group_a]] = a
        tokens[np.arange(len(b)) + sum_a[group_b]] = b
        after[sum_a + sum_b - per_b - 1] = ord("|")
        after[sum_a + sum_b - 1] = ord(";")
        chars = aligner.digits[tokens]
        width = aligner.n_digits[tokens]
        chars[np.arange(len(tokens)), width] = after
        flat = chars.ravel()
        flat = flat[flat != 0].tobytes()
        per_text = np.bincount(text_of, weights=per_a + per_b, minlength=n).astype(np.int64)
        byte = np.concatenate([[0], np.cumsum(width + 1)])
        edge = byte[np.concatenate([[0], np.cumsum(per_text)])]
        return [hashlib.sha256(flat[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for all tasks of a worker."""
    return Aligner(a_path, b_path)


_TEXT = [("chunk", pa.int64()), ("sha", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("at", pa.binary()), ("uses", pa.binary()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
_TEXT_DDL = "chunk long, sha binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, uses binary, part int, keys binary, counts binary"


def part_edges(parts: int) -> np.ndarray:
    """The least key of each part; all pairs of an A id are in one part."""
    return np.array([((i << 16) // parts) << 16 for i in range(parts)], np.uint64)


def _chunk_rows(number: int, shas: list[bytes], times: np.ndarray, found: list[Aligned], edges: np.ndarray) -> pa.RecordBatch:
    """A chunk's rows: one for each text, with the places of its pairs among the chunk's, and one for each part that it asks."""
    offset = np.cumsum([0, *(len(x.n_a) for x in found)])
    text = np.concatenate([x.pair_text + o for x, o in zip(found, offset, strict=False)])
    key, uses = np.concatenate([x.pair_key for x in found]), np.concatenate([x.pair_uses for x in found])
    keys, at = np.unique(key, return_inverse=True)
    counts = np.bincount(at, weights=times[text], minlength=len(keys)).astype(np.int64)
    cut = np.searchsorted(text, np.arange(len(shas) + 1)).tolist()
    places = [pack(np.diff(at[a:b], prepend=0)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    used = [pack(uses[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    edge = np.append(np.searchsorted(keys, edges), len(keys))
    held = np.flatnonzero(edge[1:] > edge[:-1])
    spans = [(int(edge[i]), int(edge[i + 1])) for i in held]
    asked = [pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans]
    brought = [pack(counts[a:b]) for a, b in spans]
    n, m = len(shas), len(held)
    whole = lambda name: np.concatenate([getattr(x, name) for x in found]).tolist() + [None] * m
    digests = [d for x in found for d in x.digests]
    columns = [[number] * (n + m), shas + [None] * m, *(whole(c) for c in ("n_a", "n_b", "n_groups", "n_links")), digests + [None] * m, places + [None] * m, used + [None] * m, [None] * n + held.tolist(), [None] * n + asked, [None] * n + brought]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _TEXT, strict=True)], names=[name for name, _ in _TEXT])


def _answers(rows: pa.Table) -> pa.Table:
    """Of each key that a chunk asked one part for, its total times 2, and 1 more where no pair of its A id has a higher one."""
    give_back()
    keys, counts = [np.cumsum(unpack(x)) for x in rows["keys"]], [unpack(x) for x in rows["counts"]]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(known)).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], known[1:] >> np.uint64(16) != known[:-1] >> np.uint64(16)]))
    highest = np.repeat(np.maximum.reduceat(total, first), np.diff(first, append=len(known)))
    answer = total << np.uint64(1) | (total == highest)
    edge = np.cumsum([0, *map(len, keys)])
    told = [pack(answer[at[a:b]]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.table([rows["chunk"], rows["part"], pa.array(told, pa.binary())], names=["chunk", "part", "answer"])


def _measured(texts: pa.Table, told: pa.Table) -> pa.Table:
    """The measures of a chunk's texts."""
    give_back()
    answer = np.concatenate([np.empty(0, np.uint64), *(unpack(x) for x in told.sort_by("part")["answer"])])
    total, best = (answer >> np.uint64(1)).astype(np.int64), (answer & np.uint64(1)).astype(np.int64)
    n_best, count_sum = [], []
    for at, uses in zip(texts["at"], texts["uses"], strict=True):
        place, n = np.cumsum(unpack(at)).astype(np.int64), unpack(uses).astype(np.int64)
        n_best.append(int(n @ best[place]))
        count_sum.append(int(n @ total[place]))
    return pa.table([*(texts[c] for c in _KEPT), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*_KEPT, "n_best", "count_sum"])


_KEPT = ["sha", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def align_distinct(texts: DataFrame, a_path: str, b_path: str, parts: int) -> DataFrame:
    """sha (SHA-256), n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each distinct text, from (text, times).

    The first step is written, as its chunks are what tasks happened to see together: each is computed once and read twice."""
    edges = part_edges(parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, number, seq = aligner(a_path, b_path), TaskContext.get().partitionId() << 24, 0
        shas: list[bytes] = []
        times: list[int] = []
        found: list[Aligned] = []
        chars = 0
        for batch in sliced(batches, 250):
            some, held, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(some):
                to, size = at, 0
                while to < len(some) and (to == at or size + len(some[to]) <= TOGETHER):
                    size += len(some[to])
                    to += 1
                found.append(work.align(some[at:to]))
                shas += [hashlib.sha256(t.encode()).digest() for t in some[at:to]]
                times += held[at:to]
                chars += size
                at = to
                if chars >= CHUNK_CHARS:
                    yield _chunk_rows(number + seq, shas, np.array(times), found, edges)
                    shas, times, found, chars, seq = [], [], [], 0, seq + 1
        if shas:
            yield _chunk_rows(number + seq, shas, np.array(times), found, edges)

    chunks = materialize(texts.select("text", "times").mapInArrow(run, _TEXT_DDL), "align-chunks")
    asked = chunks.where(F.col("part").isNotNull()).select("chunk", "part", "keys", "counts")
    told = asked.groupBy("part").applyInArrow(_answers, "chunk long, part int, answer binary")
    kept = chunks.where(F.col("part").isNull()).select("chunk", *_KEPT, "at", "uses")
    schema = "sha binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return kept.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_measured, schema)


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    a_path is a byte-level BPE file, b_path a piece model that puts a space before texts, both the same on every executor. A's
    tokens are those of a space and the text, with the strings of special tokens as plain text. n_links: pairs of an A and a B
    token of one group; n_best: links whose pair no other pair of its A id has more documents than; count_sum: the links'
    pairs' documents, added up. Texts that are null or empty, or whose tokens' bytes aren't a space and the text, have no
    tokens: zeros, and an empty digest.

    Repeated rows count as documents each and come out each; null ids pass through; ties share the highest count; other
    columns aren't read; an empty table gives none. Every distinct text is encoded once, however many documents have it: equal
    texts are counted before they are shuffled. A part of the pairs gets a row from each chunk that holds one of them.
    """
    # What the text is joined back by is its SHA-256; rows of one text that very many documents share are dealt out by Spark.
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = min(1 << 12, max(1, -(-text_volume(rows) // PART_CHARS)))
    texts = rows.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("times"))
    measured = materialize(align_distinct(texts, a_path, b_path, parts), "align-texts")
    named = rows.select("id", F.when(F.length("text") > 0, F.unhex(F.sha2("text", 256))).alias("own_sha"))
    out = named.join(measured, F.col("own_sha") == F.col("sha"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select(F.col("id").alias(id_col), *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
