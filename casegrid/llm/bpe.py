"""Byte-level BPE encoding and decoding by a pair occurrence index.

Texts are cut into words as the tokenizer file's kind does, and the new words of a slice of a partition are merged together:
an index maps every pair of neighbouring symbols that has a rank to all its places, the active ranks are applied in ascending
order, each at all its places from left to right, and the places of the pairs that a merge makes are added to the index. Places
that a merge has changed are passed over when their turn comes. Words that come again are kept, up to a bound of bytes.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from .common import give_back, map_texts

#: Fixed: how texts are cut into words (the public pattern of this kind of tokenizer).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes of words that one index is built for, unless one word is longer, and of texts that are cut into words together.
INDEX_BYTES, SLICE_CHARS = 1 << 21, 1 << 22
#: Places from which a rank is applied to all of them at once.
MANY = 24
#: Bytes of words and ids that are kept in each of two generations, and characters of the longest word that is.
KEPT_BYTES, KEPT_WORD = 96 << 20, 48
#: What a kept word costs beside its characters and ids.
_ENTRY = 190
_NONE = (np.empty(0, np.int32), np.empty(0, np.int32))


def byte_alphabet() -> dict[int, str]:
    """How byte-level tokenizer files spell bytes: printable characters stand for themselves, and the other bytes, in order,
    for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    return {b: chr(b if b in plain else 256 + b - sum(p < b for p in plain)) for b in range(256)}


class PairIndex:
    """The merges of a tokenizer: ranks of pairs of ids, applied to many words at once."""

    def __init__(self, first: np.ndarray, merges: list[tuple[int, int]], made: list[int]) -> None:
        """first: the id of each byte; merges: pairs of ids in ascending rank; made: the id that each gives."""
        self.first, self.merges, self.made = first, merges, made
        self.rank = {pair: i for i, pair in enumerate(merges)}
        # A pair must not come before the merges that make its parts, else ascending ranks would not be the library's order.
        source = {}
        for i, new in enumerate(made):
            source.setdefault(new, i)
        if len(source) != len(made) or any(source.get(part, -1) >= i for i, pair in enumerate(merges) for part in pair):
            raise ValueError("merges that come before what they are made of aren't supported")
        self.byte_rank = np.full((256, 256), -1, np.int64)
        byte_of = {int(t): b for b, t in enumerate(first)}
        for (a, b), i in self.rank.items():
            if a in byte_of and b in byte_of:
                self.byte_rank[byte_of[a], byte_of[b]] = i
        # For each symbol that a merge makes: what may stand before it and after it, ascending, and the pairs' ranks.
        self.before_it, self.after_it = self._partners(1), self._partners(0)

    def _partners(self, own: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        found: dict[int, list[tuple[int, int]]] = {}
        for i, pair in enumerate(self.merges):
            found.setdefault(pair[own], []).append((pair[1 - own], i))
        return {k: tuple(np.array(sorted(x), np.int32).T) for k, x in found.items()}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed in 32 bits each. Words aren't empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(lengths + 1) - lengths  # a place without a symbol stands before each word and after the last
        size = int(lengths.sum()) + len(words) + 1
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.ones(size, bool)
        at[begin - 1], at[-1] = False, False
        symbols = np.full(size, -1, np.int32)
        symbols[at] = self.first[data]
        # Places of the pairs of bytes, by rank.
        place = np.flatnonzero(at)
        rank = self.byte_rank[data[:-1], data[1:]]
        rank[np.diff(place) != 1] = -1
        place = place[:-1][rank >= 0]
        rank = rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(rank)) + 1, [len(rank)]]) if len(rank) else np.zeros(1, np.int64)
        places = {int(rank[a]): place[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)}
        symbol = array("i", symbols.tobytes())
        after = array("i", np.arange(1, size + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, size - 1, dtype=np.int32).tobytes())
        self._merge(symbol, after, before, places)
        symbols = np.frombuffer(symbol, np.int32)
        left = np.flatnonzero(symbols >= 0)
        edge = 4 * np.searchsorted(left, np.append(begin, size))
        packed = symbols[left].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def _merge(self, symbol: array, after: array, before: array, places: dict[int, list[int]]) -> None:
        """Apply the active ranks in ascending order; a merged place keeps the new symbol, and the one after it gets -2. Ranks
        with many places are applied to all of them at once, on the same memory."""
        ranked, active = self.rank.get, list(places)
        views = [np.frombuffer(x, np.int32) for x in (symbol, after, before)]
        heapq.heapify(active)

        def add(later: int, where: list[int]) -> None:
            if later in places:
                places[later] += where
            else:
                places[later] = where
                heapq.heappush(active, later)

        while active:
            rank = heapq.heappop(active)
            (a, b), new = self.merges[rank], self.made[rank]
            found = places.pop(rank)
            if len(found) >= MANY:
                for later, where in self._merge_many(a, b, new, np.unique(np.array(found, np.int32)), *views):
                    add(later, where)
                continue
            found.sort()
            for at in found:
                if symbol[at] != a:
                    continue
                gone = after[at]
                if symbol[gone] != b:
                    continue
                symbol[at], symbol[gone] = new, -2
                follows = after[gone]
                after[at], before[follows] = follows, at
                left = before[at]
                if (later := ranked((symbol[left], new))) is not None:
                    add(later, [left])
                if (later := ranked((new, symbol[follows]))) is not None:
                    add(later, [at])

    def _merge_many(self, a: int, b: int, new: int, at: np.ndarray, symbol: np.ndarray, after: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Merge a and b at all of the ascending places where they still are; gives (rank, places) of the pairs made."""
        at = at[symbol[at] == a]
        gone = after[at]
        held = symbol[gone] == b
        at, gone = at[held], gone[held]
        if a == b and len(at):
            # Of places in a row every other one is taken, from the left.
            order = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], gone[:-1] != at[1:]]), order, 0))
            taken = (order - begin) % 2 == 0
            at, gone = at[taken], gone[taken]
        symbol[at], symbol[gone] = new, -2
        follows = after[gone]
        after[at], before[follows] = follows, at
        left = before[at]
        for where, other, (known, ranks) in ((left, symbol[left], self.before_it.get(new, _NONE)), (at, symbol[follows], self.after_it.get(new, _NONE))):
            if not len(known) or not len(where):
                continue
            number = np.searchsorted(known, other)
            number[number == len(known)] = 0
            hit = np.flatnonzero(known[number] == other)
            if not len(hit):
                continue
            rank, place = ranks[number[hit]], where[hit]
            order = np.argsort(rank, kind="stable")
            rank, place = rank[order], place[order]
            cut = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(rank)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                yield int(rank[i]), place[i:j].tolist()


class WordKeeper:
    """Encodes texts word by word, the new words of some texts together; words that come again are kept.

    Kept words are bounded by bytes, in two generations: when the newer one is full the older one goes, and words that are met
    again move to the newer one. Long words aren't kept.
    """

    def __init__(self) -> None:
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        """The words of a text, whose ids in a row are the text's."""
        raise NotImplementedError

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed in 32 bits each."""
        raise NotImplementedError

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, packed in 32 bits each."""
        at = 0
        while at < len(texts):
            # Some texts at a time, so that their words are few enough to be held.
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= SLICE_CHARS):
                chars += len(texts[to])
                to += 1
            words = [self.words(t) for t in texts[at:to]]
            own = self._learn({w for x in words for w in x}.difference(self.kept))
            for x in words:
                yield b"".join(map(own.__getitem__, x) if own is self.kept else [own[w] if w in own else self.kept[w] for w in x])
            if self.held > KEPT_BYTES:
                self.kept, self.older, self.held = {}, self.kept, 0
            at = to

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """A table that has the new words: the kept one, unless some of them are too long to be kept. Words that were kept
        before the last change of generations are taken from there."""
        todo = list(new.difference(self.older))
        found: dict[str, bytes] = {w: self.older[w] for w in new if w in self.older} if len(todo) < len(new) else {}
        batch, size = [], 0
        for i, w in enumerate(todo):
            batch.append(w)
            size += len(w)
            if size >= INDEX_BYTES or i == len(todo) - 1:
                found.update(zip(batch, self.encode_words(batch), strict=True))
                batch, size = [], 0
        short = {w: x for w, x in found.items() if len(w) <= KEPT_WORD} if max(map(len, new), default=0) > KEPT_WORD else found
        self.held += sum(map(len, short)) + sum(map(len, short.values())) + _ENTRY * len(short)
        self.kept |= short
        return self.kept if short is found else found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.packed(texts)]


class BpeEncoder(WordKeeper):
    """Encodes and decodes texts under one byte-level tokenizer file.

    specials: whether the strings of added tokens inside texts stand for those tokens, as the library has it by default, or
    are plain text.
    """

    def __init__(self, path: str, specials: bool = True) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE files that neither normalise texts nor put a space before them are supported")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.spelt = {c: b for b, c in byte_alphabet().items()}
        vocab: dict[str, int] = model["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(map(self.spelt.__getitem__, t)) for t, i in vocab.items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        first = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int32)
        self.index = PairIndex(first, [(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        self.special: dict[str, bytes] = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that take more than their own string aren't supported")
            self.bytes[t["id"]] = t["content"].encode()
            if specials:
                self.special[t["content"]] = int(t["id"]).to_bytes(4, "little")
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.agreed, self.differ = set(map(chr, range(128))), set()

    def _library_words(self, text: str) -> list[str]:
        """The words as the library cuts them."""
        return [bytes(map(self.spelt.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _plain(self, text: str) -> bool:
        """Whether the pattern's classes and the library's, which may know another Unicode version, agree on all characters."""
        if text.isascii():
            return True
        found = set(text)
        for c in found - self.agreed - self.differ:
            probe = f"a{c}1{c}.{c} {c}{c}b"
            (self.agreed if self._library_words(probe) == WORDS.findall(probe) else self.differ).add(c)
        return found.isdisjoint(self.differ) if self.differ else True

    def words(self, text: str) -> list[str]:
        """The words of a text; together they are the text. Strings of added tokens are words of their own."""
        if self.cut and self.cut.search(text):
            parts, at = [], 0
            for m in self.cut.finditer(text):
                parts += [*self.words(text[at : m.start()]), m[0]] if m.start() > at else [m[0]]
                at = m.end()
            return parts + (self.words(text[at:]) if at < len(text) else [])
        return WORDS.findall(text) if self._plain(text) else self._library_words(text)

    def encode_words(self, words: list[str]) -> list[bytes]:
        if not self.special:
            return self.index.encode([w.encode() for w in words])
        plain = iter(self.index.encode([w.encode() for w in words if w not in self.special]))
        return [self.special[w] if w in self.special else next(plain) for w in words]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def bpe_encoder(path: str, specials: bool = True) -> BpeEncoder:
    """One encoder for all tasks of a worker."""
    return BpeEncoder(path, specials)


#: What emit() makes of a text's ids: one value for each field.
Emit = Callable[[BpeEncoder, np.ndarray], tuple]


def encode_texts(docs: DataFrame, keys: list[str], tokenizer: str, text_col: str = "text", emit: Emit | None = None, fields: list[tuple[str, pa.DataType]] | None = None, schema: str | None = None) -> DataFrame:
    """The key columns and ids (array of int) of each text.

    tokenizer is the path of the file, the same on every executor. emit, fields and schema derive other columns from the ids
    in the same task. A null text counts as empty and has no ids. Rows are independent: repeated rows, ties and null keys
    change nothing; columns other than keys and text aren't read. An empty table gives none. Nothing is shuffled.
    """
    if emit is None:
        emit, fields, schema = (lambda _, x: (x.astype(np.int32),)), [("ids", pa.list_(pa.int32()))], "ids array<int>"

    def make():
        encoder = bpe_encoder(tokenizer)

        def work(texts: list) -> list:
            rows = [emit(encoder, np.frombuffer(x, "<u4")) for x in encoder.packed([t or "" for t in texts])]
            give_back()
            return list(zip(*rows, strict=True)) if rows else [[] for _ in fields]

        return work

    return map_texts(docs, make, keys, text_col, fields, schema, step=2000)


def decode_ids(encoded: DataFrame, keys: list[str], tokenizer: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """The key columns and, under name, what each row's ids stand for: null for null ids, empty for none. Rows are independent;
    a null or unknown id is an error, and so is a key of that name; an empty table gives none."""
    if name.lower() in (k.lower() for k in keys):
        raise ValueError(f"a key is named {name}, as the text is")
    kept = [encoded.schema[k].dataType.simpleString() for k in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe_encoder(tokenizer)
        for b in batches:
            ids = b.column(len(keys)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([None if x is None else encoder.decode(x) for x in ids], pa.string())], names=b.schema.names[:-1] + ["text_"])

    chosen = encoded.select(*[encoded[f"`{k}`"].alias(f"k{i}") for i, k in enumerate(keys)], encoded[f"`{ids_col}`"].alias("ids_"))
    out = chosen.mapInArrow(run, ", ".join([*(f"k{i} {t}" for i, t in enumerate(kept)), "text_ string"]))
    return out.withColumnsRenamed({**{f"k{i}": k for i, k in enumerate(keys)}, "text_": name})
