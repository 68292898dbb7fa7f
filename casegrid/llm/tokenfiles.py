"""Token-id files: Re-Pair grammar compression by shard.

A shard holds the ids of consecutive documents. Frequent pairs of neighbouring symbols are replaced by new symbols, round
by round, until no pair occurs often enough to pay for its rule; the file keeps the rules, the expansion length of each,
the remaining sequence, and how much of it each document has, so one document, or one range of its ids, can be expanded
without the others. Symbols take as many bits as the last of them needs.
"""

from __future__ import annotations

import functools
import operator
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path

#: Ids after which a shard is closed.
SHARD_IDS = 1_000_000
#: Uses from which a pair is replaced (a rule costs two symbols), and the least share of the most frequent pair's uses that
#: a pair replaced in the same round has.
LEAST_USES, ROUND_SHARE = 3, 0.02
MAGIC = b"RPG2"

#: White space of Python's str.split that isn't white space to the tokenizer, and what is to both.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words of these characters alone are parted here. Others aren't: apostrophes join letters, a capital I with a dot has two
#: letters in lower case, and the digits that aren't decimal are parted like decimal ones.
_SIMPLE = re.compile("[!-&(-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]+")
_UNITS = re.compile(r"[^\W\d_]+|\d|(?:[^\w]|_)+")


_ID = operator.attrgetter("id")


@functools.cache
def _packer(n: int):
    """A function that packs so many ids."""
    return struct.Struct(f"<{n}I").pack


class WordIds(dict):
    """Packed ids of words, found by one encoder where they are missing. Long words aren't kept, so a bound on the number of
    words is one on their bytes."""

    #: Characters of the longest word that is kept.
    LONGEST = 32

    def __init__(self, encoder: WordEncoder, kept: dict[str, bytes]) -> None:
        super().__init__(kept)
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        x = self.encoder.word(word)
        if len(word) <= self.LONGEST:
            self[word] = x
        return x


class WordEncoder:
    """Ids of texts under a word-level tokenizer file; words that come again are kept, up to a bound.

    Only for tokenizers that lower-case, drop white space and part letters, single digits and other characters, which is
    checked; others get whole texts. No token then reaches over white space, so a text's ids are those of its words. A new
    word of letters without marks goes to the library's model, unit by unit; any other through the library's whole pipeline.
    """

    #: Words kept at most, each of some 200 bytes and never more than 400. When there are more, long ones go, which are rarer,
    #: and all if that isn't enough.
    KEPT, SHORT = 800_000, 8

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kept = WordIds(self, {})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = "Ab c,d 1é\n\t x 42"
        parts = [self._library(p) for p in ("Ab", "c", ",", "d", "1", "é", "x", "4", "2")]
        self.parted = self._library(probe) == b"".join(parts)
        # Letters reach the library's model as the byte-level alphabet spells their bytes: printable characters stand for
        # themselves, and the other bytes for the characters from 256 on.
        plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
        self.alphabet = {b: b if b in plain else 256 + b - sum(p < b for p in plain) for b in range(256)}
        #: Marks that most often end a word, and none.
        self.tails = {c: self._library(c) for c in ["", *".,;:!?)"]}
        self.direct = all(self._model(w) == self._library(w) for w in ["straße", "école", "año"])

    def _model(self, unit: str) -> bytes:
        """Ids of a unit of lower-case letters, from the library's model without the steps that change nothing in it."""
        spelt = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.alphabet)
        found = self.model.tokenize(spelt)
        return _packer(len(found))(*map(_ID, found))

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def word(self, word: str) -> bytes:
        """Packed ids of a text without white space."""
        if self.direct:
            letters, tail = (word, "") if word.isalpha() else (word[:-1], word[-1])
            if tail in self.tails and letters.isalpha() and (letters.isascii() or _SIMPLE.fullmatch(letters)):
                unit = letters.lower()
                return self._model(unit) if unit == word else self.kept[unit] + self.tails[tail]
            if _SIMPLE.fullmatch(word) and not any(s in word for s in self.special):
                units = _UNITS.findall(word.lower())
                if len(units) > 1:
                    return b"".join([self.kept[u] for u in units])
        return self._library(word)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.parted:
            return [np.frombuffer(self._library(t), np.uint32) for t in texts]
        words = [_WORDS.findall(t) if any(c in t for c in _SEPARATORS) else t.split() for t in texts]
        if len(self.kept) > self.KEPT:
            short = {w: x for w, x in self.kept.items() if len(w) <= self.SHORT}
            self.kept = WordIds(self, short if len(short) <= self.KEPT // 2 else {})
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, w)), np.uint32) for w in words]


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


def bits_of(most: int) -> int:
    return max(1, int(most).bit_length())


def pack_bits(x: np.ndarray, width: int) -> bytes:
    """Integers in so many bits each, highest bit first, one after the other."""
    bits = np.unpackbits(x.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def unpack_bits(data: memoryview, width: int, start: int, stop: int) -> np.ndarray:
    """Integers start to stop of what pack_bits gave; only their bytes are read."""
    first, end = start * width, stop * width
    bits = np.unpackbits(np.frombuffer(data[first // 8 : -(-end // 8)], np.uint8))[first % 8 :][: end - first].reshape(-1, width)
    whole = np.zeros((len(bits), 32), np.uint8)
    whole[:, 32 - width :] = bits
    return np.packbits(whole).view(">u4").astype(np.uint32)


def frequent_pairs(keys: np.ndarray) -> tuple[np.ndarray, bool]:
    """Ascending keys that a round replaces, and whether these are all that occur often enough; negative ones are no pairs."""
    keys = np.sort(keys)
    keys = keys[np.searchsorted(keys, 0) :]
    edge = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.empty(0, np.int64)
    uses = np.diff(edge, append=len(keys))
    share = uses.max(initial=0) * ROUND_SHARE
    return keys[edge[uses >= max(LEAST_USES, share)]], share <= LEAST_USES


def compress(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> bytes:
    """A shard's file from the ids of its documents, one after the other, and how many each has.

    A round replaces the pairs that occur at least ROUND_SHARE as often as the most frequent one; rounds end when no pair
    within a document occurs LEAST_USES times. Every round shortens the sequence, so they do end.
    """
    sequence = ids.astype(np.int64)
    last = np.cumsum(counts)[counts > 0] - 1  # places where documents end
    rules, levels, top = [np.empty((0, 2), np.int64)], [], vocabulary
    look = None  # places of the pairs that may occur often enough; None: all
    while True:
        if look is None:
            keys = sequence[:-1] << 32
            keys |= sequence[1:]
            keys[last[:-1]] = -1
        else:
            look = look[last[np.searchsorted(last, look)] != look]
            keys = sequence[look] << 32 | sequence[look + 1]
        pairs, every = frequent_pairs(keys)
        if not len(pairs):
            break
        chosen = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)
        if look is None:
            # Places whose two symbols are in some chosen pair each, and of those the ones with a chosen pair.
            begins, follows = np.zeros(top, bool), np.zeros(top, bool)
            begins[chosen[:, 0]] = follows[chosen[:, 1]] = True
            look = np.flatnonzero(begins[sequence[:-1]] & follows[sequence[1:]])
            keys = keys[look]
        number = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        hit = pairs[number] == keys
        at, number = look[hit], number[hit]
        # Of hits in a row every other one is taken, from the left.
        order = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, order, 0))
        taken = (order - begin) % 2 == 0
        at, number = at[taken], number[taken]
        used = np.bincount(number, minlength=len(pairs)) > 0
        rules.append(chosen[used])
        levels.append(int(used.sum()))
        sequence[at] = (top - 1 + np.cumsum(used))[number]
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        last = last - np.searchsorted(at, last)
        look = None
        if every:  # then only pairs with a new symbol can have become frequent
            near = sequence >= top
            near[:-1] |= near[1:]
            look = np.flatnonzero(near)
        top += levels[-1]
    rule = np.concatenate(rules)
    lengths = _lengths(rule, levels, vocabulary)
    held = np.zeros(len(counts), np.int64)
    held[counts > 0] = np.diff(last, prepend=-1)
    widths = [bits_of(top - 1), bits_of(lengths.max(initial=1)), bits_of(held.max(initial=0))]
    head = struct.pack("<4s8I", MAGIC, vocabulary, len(rule), len(counts), len(sequence), len(levels), *widths)
    body = [(rule.ravel(), widths[0]), (lengths, widths[1]), (held, widths[2]), (sequence, widths[0])]
    return b"".join([head, np.array(levels, "<u4").tobytes(), *(pack_bits(x, w) for x, w in body)])


def _lengths(rule: np.ndarray, levels: list[int], vocabulary: int) -> np.ndarray:
    """Ids that each rule's symbol expands to."""
    lengths = np.ones(vocabulary + len(rule), np.int64)
    done = 0
    for n in levels:
        part = rule[done : done + n]
        lengths[vocabulary + done : vocabulary + done + n] = lengths[part[:, 0]] + lengths[part[:, 1]]
        done += n
    return lengths[vocabulary:]


def _spell(symbols: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """What flat has for each of the symbols, one after the other."""
    length = (start[1:] - start[:-1])[symbols]
    end = np.cumsum(length)
    return flat[np.repeat(start[symbols] - end + length, length) + np.arange(end[-1] if len(end) else 0)]


class Shard:
    """A shard's file, opened. Symbols are read and expanded only where they are asked for."""

    def __init__(self, data: bytes) -> None:
        magic, self.vocabulary, rules, self.documents, self.symbols, levels, *widths = struct.unpack_from("<4s8I", data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.levels = np.frombuffer(data, "<u4", levels, 36).tolist()
        view, at, parts = memoryview(data), 36 + 4 * levels, []
        for n, w in ((2 * rules, widths[0]), (rules, widths[1]), (self.documents, widths[2]), (self.symbols, widths[0])):
            parts.append(view[at : at + -(-n * w // 8)])
            at += -(-n * w // 8)
        if at != len(data):
            raise ValueError("a shard file of another length than it says")
        self.rules = unpack_bits(parts[0], widths[0], 0, 2 * rules).reshape(-1, 2)
        self.lengths = unpack_bits(parts[1], widths[1], 0, rules)
        self.starts = np.concatenate([[0], np.cumsum(unpack_bits(parts[2], widths[2], 0, self.documents).astype(np.int64))])
        self._packed, self._width = parts[3], widths[0]

    def sequence(self, start: int, stop: int) -> np.ndarray:
        return unpack_bits(self._packed, self._width, int(start), int(stop))

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.vocabulary
        out[rule] = self.lengths[symbols[rule] - self.vocabulary]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols, undoing the rounds from the last to the first."""
        top = self.vocabulary + len(self.rules)
        for n in reversed(self.levels):
            top -= n
            rule = symbols >= top
            if not rule.any():
                continue
            width = 1 + rule
            out = np.repeat(symbols, width)
            first = (np.cumsum(width) - width)[rule]
            pair = self.rules[symbols[rule] - self.vocabulary]
            out[first], out[first + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols

    @functools.cached_property
    def _spelt(self) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of every symbol, one symbol after the other; where each begins, with the total last). A rule's pair
        occurs apart from the others of its level, so a level holds no more ids than the shard."""
        flat, start = np.arange(self.vocabulary, dtype=np.uint32), np.arange(self.vocabulary + 1)
        done = 0
        for n in self.levels:
            pair = self.rules[done : done + n].ravel()
            flat = np.concatenate([flat, _spell(pair, flat, start)])
            start = np.concatenate([start, start[-1] + np.cumsum(self.lengths[done : done + n], dtype=np.int64)])
            done += n
        return flat, start

    def expand_many(self, symbols: np.ndarray) -> np.ndarray:
        """expand() for many symbols: the rules are spelt once, and the symbols are looked up."""
        return _spell(symbols, *self._spelt)

    def counts(self) -> np.ndarray:
        """Ids of each document."""
        total = np.concatenate([[0], np.cumsum(self.symbol_lengths(self.sequence(0, self.symbols)))])
        return np.diff(total[self.starts])

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.sequence(self.starts[k], self.starts[k + 1]))

    def slice(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k; only symbols that reach into the range are expanded."""
        symbols = self.sequence(self.starts[k], self.starts[k + 1])
        end = np.cumsum(self.symbol_lengths(symbols))
        a, b = np.searchsorted(end, start, "right"), np.searchsorted(end, max(start, stop - 1), "right") + 1
        before = int(end[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before : max(start, stop) - before]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode the texts, append end_id to each, write shards in ascending order of id below path, and give the path.

    Null ids come first; rows that repeat an id follow each other in the order of a hash of their texts. A null or empty
    text has the end id only. Other columns aren't read. An empty table gives a path without shards. The table at path has
    a row for each shard: part and seq (its place), n_docs, n_ids, ids (its documents' ids) and data (the file).
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        vocabulary = max(end_id + 1, encoder.tokenizer.get_vocab_size(with_added_tokens=True))
        end = np.array([end_id], np.uint32)
        names, found, held = [], [], 0

        def close() -> pa.RecordBatch:
            counts = np.array([len(x) for x in found], np.int64)
            data = compress(np.concatenate(found), counts, vocabulary)
            ids = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([held], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "ids", "data"])

        for batch in batches:
            from_ = 0
            texts = batch.column(1)
            coded = (x for at in range(0, len(texts), 100) for x in encoder.ids(texts.slice(at, 100).to_pylist()))
            for i, ids in enumerate(coded):
                found.append(np.concatenate([ids, end]))
                held += len(found[-1])
                if held >= SHARD_IDS:
                    names.append(batch.column(0).slice(from_, i + 1 - from_))
                    yield close()
                    from_, names, found, held, seq = i + 1, [], [], 0, seq + 1
            if from_ < batch.num_rows:
                names.append(batch.column(0).slice(from_))
        if found:
            yield close()

    path = path or scratch_path(docs.sparkSession, "token-shards")
    rows.mapInArrow(run, f"part int, seq int, n_docs long, n_ids long, ids array<{id_type}>, data binary").write.parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the shards below path; start counts the ids of all before it.

    Parts are added up first, and then shards within a part, so no task sees a row for every shard.
    """
    shards = spark.read.parquet(path)
    id_type = shards.schema["ids"].dataType.elementType.simpleString()
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", (F.sum("part_ids").over(W.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    offsets = shards.select("part", "seq", within.alias("seq_start")).join(parts, "part").select(F.col("part").alias("o_part"), F.col("seq").alias("o_seq"), (F.col("part_start") + F.col("seq_start")).alias("offset"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column(3)[i].as_buffer().to_pybytes())
                names, counts = batch.column(2)[i].values, shard.counts()
                # The documents, a bounded number of symbols at a time.
                crc, k = [], 0
                while k < shard.documents:
                    to = max(k + 1, int(np.searchsorted(shard.starts, shard.starts[k] + (1 << 20), "right")) - 1)
                    ids = shard.expand_many(shard.sequence(shard.starts[k], shard.starts[to])).astype("<u4")
                    edge = np.concatenate([[0], np.cumsum(counts[k:to])])
                    crc += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                    k = to
                n = len(counts)
                yield pa.RecordBatch.from_arrays([names, pa.array([batch.column(0)[i].as_py()] * n, pa.int32()), pa.array([batch.column(1)[i].as_py()] * n, pa.int32()), pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["id", "part", "seq", "before", "n_tokens", "ids_crc32"])

    read = shards.select("part", "seq", "ids", "data").mapInArrow(run, f"id {id_type}, part int, seq int, before long, n_tokens long, ids_crc32 long")
    joined = read.join(offsets, (F.col("part") == F.col("o_part")) & (F.col("seq") == F.col("o_seq")))
    return joined.select(F.col("id").alias(id_col), (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
