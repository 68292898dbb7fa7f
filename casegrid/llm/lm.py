"""Language-model scoring: a weighted backoff automaton over words.

Training texts give counts of words, of word pairs and of word triples. The states are the contexts seen in training: no
word, one word, or two. An n-gram seen in training is an arc of its context's state; each state has a failure arc to the
state of the context without its first word, and the state without context has an arc for every word, seen or not. One
pass from left to right over a text carries the state, follows the state's arc for the next word or else its failure arc,
and adds their log10 weights.

Smoothing: P(w | h) = (c(h w) + mu P(w | h')) / (c(h) + mu), where h' is h without its first word and mu belongs to the
length of h; P(w) = (c(w) + 1) / (N + V + 1). So an arc weighs P(w | h), a failure arc mu / (c(h) + mu), and over all words,
one of them standing for all unseen ones, each state sums to 1. mu is what makes the n-grams that occur once as frequent
as the model expects of n-grams that it hasn't seen when one token at a time is left out of training.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, sliced
from .keyed import BINS, chunk_answers, count_keys, in_chunks, sizes, spread_tallies, tallies, totals_of, use_counts

#: The token at the end of a text, which is also the context in which texts begin.
END = np.uint64(0x5851F42D4C957F2D)
#: Bits of the keys of words, and of those of pairs and triples: of 10^10 different ones, one in 10^8 shares its key.
WORD_BITS, PAIR_BITS = 64, 60
WORD, PAIR, TRIPLE = 0, 1, 2


def _packed(rows: DataFrame) -> DataFrame:
    """rows with each text compressed, as they are shuffled whole."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in sliced(batches):
            texts = pa.array([small(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    schema = ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(pack, schema)


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words and ends, where each text begins with the total last)."""
    found, counts, unpack = [], [], zstandard.ZstdDecompressor().decompress
    for at in range(0, len(texts), 250):
        words, edge = hash_words(pa.array([unpack(x) for x in texts.slice(at, 250).to_pylist()], pa.large_binary()))
        found.append(np.insert(words, edge[1:], END))
        counts.append(np.diff(edge) + 1)
    return np.concatenate([np.empty(0, np.uint64), *found]), np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *counts]))])


class Places:
    """The n-grams that end at each token of some texts, as keys: words of WORD_BITS, pairs and triples of PAIR_BITS."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        tokens, self.edge = _tokens(texts)
        self.first = np.zeros(len(tokens), bool)
        self.first[self.edge[:-1]] = True
        before = np.roll(tokens, 1)
        before[self.first] = END
        self.word = mix(tokens)
        pair = mix(mix(before) * np.uint64(3) + self.word)
        triple = mix(np.roll(pair, 1) * np.uint64(5) + self.word)  # a text's first token ends none
        self.pair, self.triple = pair >> np.uint64(64 - PAIR_BITS), triple >> np.uint64(64 - PAIR_BITS)
        self.end = mix(np.array([END]))[0]

    def training(self, held_out: pa.ChunkedArray) -> np.ndarray:
        return np.repeat(~np.array(held_out.to_pylist(), bool), np.diff(self.edge))

    def short_keys(self, training: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(for words and for pairs, the distinct keys and their training counts here; the numbers of each token's word and
        then pair, pairs numbered on from the words)."""
        out, numbers, before = [], [], 0
        for keys in (self.word, self.pair):
            keys, at = np.unique(keys, return_inverse=True)
            out.append((keys, np.bincount(at, weights=training, minlength=len(keys)).astype(np.int64)))
            numbers.append(at + before)
            before += len(keys)
        return out, np.concatenate(numbers)

    def long_keys(self, training: np.ndarray, shared: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys of triples, their training counts here, the number of each token's triple, which of them other
        chunks may hold: those both of whose pairs they do)."""
        elsewhere = shared[at[len(self.word) :]]
        open_ = elsewhere & np.roll(elsewhere, 1)
        keys, first, number = np.unique(self.triple, return_index=True, return_inverse=True)
        counts = np.bincount(number, weights=training & ~self.first, minlength=len(keys)).astype(np.int64)
        asked = np.zeros(len(keys), bool)
        asked[number[open_ & ~self.first]] = True
        return keys, counts, number, asked


class Automaton:
    """The part of the automaton that some texts can reach, by the token that each arc is for.

    counts: of the word, pair and triple that end at each token; contexts: of the contexts that those have, the empty one
    first; kinds: distinct words of the training texts.
    """

    def __init__(self, counts: list[np.ndarray], contexts: list[np.ndarray], kinds: int, mu: list[float]) -> None:
        self.counts, self.contexts = counts, contexts
        p = (counts[WORD] + 1.0) / (contexts[0] + kinds + 1.0)
        self.arc, self.fail = [np.log10(p)], [np.zeros(len(p))]
        for c, h, m in zip(counts[1:], contexts[1:], mu, strict=True):
            p = (c + m * p) / (h + m)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(m / (h + m)))

    def traverse(self, edge: np.ndarray) -> np.ndarray:
        """Log10 probability of each text. The state carried to a token is the longest context that training has seen; as
        that depends on the n-grams that end before it only, all texts go through their tokens together."""
        state = np.zeros(len(self.arc[0]), np.int64)
        for order in range(1, len(self.arc)):
            state[self.contexts[order] > 0] = order
        weight = np.zeros(len(state))
        for order in range(len(self.arc) - 1, -1, -1):
            here = state == order
            known = here & ((self.counts[order] > 0) if order else True)
            weight[known] += self.arc[order][known]
            failing = here & ~known
            weight[failing] += self.fail[order][failing]
            state[failing] -= 1
        return np.add.reduceat(weight, edge[:-1]) if len(weight) else np.empty(0)


def fitted_mu(context: np.ndarray, n_gram: np.ndarray) -> float:
    """The weight of the shorter context's distribution, from two tallies: of the contexts' counts and of the n-grams'.

    With a token left out, its n-gram is new to the model where it occurs once; the model expects that of a token after a
    context of count c with probability mu / (c - 1 + mu). mu makes both agree over all tokens, by bisection."""
    keys, tokens = np.array(context, float).reshape(2, BINS)
    once = float(n_gram[1])
    held = keys > 0
    c, t = tokens[held] / keys[held], tokens[held]
    low, high = -10.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (t * 2**mid / (c - 1 + 2**mid)).sum() < once else (low, mid)
    return 2 ** ((low + high) / 2)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, mu: list[float] | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    held_out: a boolean Column over docs; rows where it isn't true are learnt from. By default those whose crc32 of the id
    as text leaves 2 by 7 are held out; null ids are learnt from. Words are parted by ASCII white space, A-Z lower-cased;
    every text ends with one end token, so a null or empty text has one token. Repeated rows are learnt from and scored
    each. Other columns aren't read. An empty table gives none. mu: weights for contexts of one word and of two; by default
    they come from the training counts.

    Every chunk of documents asks for the counts of its own words and pairs, and then of those triples that other chunks
    can have, so no task or driver holds the whole model. Words and n-grams are told apart by hashes of WORD_BITS and
    PAIR_BITS, whatever the volume of text.
    """
    held = (F.crc32(F.col(f"`{id_col}`").cast("string")) % 7 == 2) if held_out is None else held_out
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chunks, parts, _ = sizes(rows)
    chunked = _packed(in_chunks(rows, chunks, "id", "text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def ask_short(rows: pa.Table) -> tuple:
        places = Places(rows["text"])
        return (places.short_keys(places.training(rows["held_out"]))[0],)

    def ask_long(rows: pa.Table, answers: pa.Table) -> tuple:
        places = Places(rows["text"])
        training = places.training(rows["held_out"])
        _, at = places.short_keys(training)
        keys, counts, _, asked = places.long_keys(training, totals_of(answers)[1], at)
        return [(keys[asked], counts[asked])], tallies({0: counts[~asked]}, 1)

    short = count_keys(chunked, [-(-parts // 4), parts], [WORD_BITS, PAIR_BITS], ask_short, tallied=True)
    known = chunk_answers(short)
    long = count_keys(chunked, [parts], [PAIR_BITS], ask_long, tallied=True, known=known)

    def told(answers: pa.Table, step: int) -> pa.Table:
        return answers.filter(pc.equal(answers["step"], step))

    def level(answers: pa.Table, kind: int) -> np.ndarray:
        """A tally of the whole training set."""
        step, at = (4, 0) if kind == TRIPLE else (3, kind)
        sums = told(answers, step)["tally"][0].as_py() or [0] * 4 * BINS
        return np.array(sums[2 * BINS * at :][: 2 * BINS])

    def use(rows: pa.Table, answers: pa.Table) -> pa.Table:
        places = Places(rows["text"])
        training = places.training(rows["held_out"])
        ((keys, _), _), at = places.short_keys(training)
        totals, shared = totals_of(told(answers, 1))
        totals = totals.astype(np.int64)
        _, triples, number, asked = places.long_keys(training, shared, at)
        triples[asked] = totals_of(told(answers, 2))[0].astype(np.int64)
        word, pair = totals[at].reshape(2, -1)
        triple = np.where(places.first, 0, triples[number])
        # Contexts: none, the word before (an end before a text's first), and the pair before.
        before = np.roll(word, 1)
        ends = np.searchsorted(keys, places.end)
        before[places.first] = totals[ends]
        words, pairs = level(answers, WORD), level(answers, PAIR)
        n, kinds = int(words[BINS:].sum()), int(words[1:BINS].sum())
        weights = mu or [fitted_mu(words, pairs), fitted_mu(pairs, level(answers, TRIPLE))]
        automaton = Automaton([word, pair, triple], [np.full(len(word), n), before, np.where(places.first, 0, np.roll(pair, 1))], kinds, weights)
        known = np.add.reduceat((word > 0).astype(np.int64), places.edge[:-1])
        base = np.add.reduceat(automaton.arc[0], places.edge[:-1])
        columns = [rows["id"], rows["held_out"], np.diff(places.edge), known, np.full(len(known), n), base, automaton.traverse(places.edge)]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    none = F.lit(None)
    answers = [known.select("chunk", "part", "answer", F.lit(1).alias("step"), none.cast("array<long>").alias("tally")), chunk_answers(long).select("chunk", "part", "answer", F.lit(2).alias("step"), none.cast("array<long>").alias("tally"))]
    sums = [spread_tallies(x, chunks).select("chunk", none.cast("int").alias("part"), none.cast("binary").alias("answer"), F.lit(step).alias("step"), "tally") for x, step in ((short, 3), (long, 4))]
    everything = answers[0].unionByName(answers[1]).unionByName(sums[0]).unionByName(sums[1])
    return use_counts(chunked, everything, use, schema).withColumnRenamed("id", id_col)
