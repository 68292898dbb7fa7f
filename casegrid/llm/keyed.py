"""Corpus-wide counts of keys (words, n-grams, shingles) for chunks of documents.

Chunks ask for the keys that they hold, each key once, and bring their own counts; the keys are parted by range and each
part adds up what the chunks brought and answers every chunk in the order in which it asked. Keys travel as packed
arrays of gaps, so a key that all documents share crosses once for each chunk, and no part gathers more than its range of keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import give_back, text_volume

#: Characters of text for each chunk, and for each part of the keys: what a Python worker of some 400 MB holds. A chunk has
#: a row for each part that it has keys in, so there are never more rows than keys; with larger executors raise both, as
#: then a row holds more keys (64 and 200 million suit workers of 8 GB).
CHUNK_CHARS, PART_CHARS = 3_000_000, 9_000_000
_ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tally", pa.list_(pa.int64()))])
_ANSWER = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("answer", pa.binary()), ("tally", pa.list_(pa.int64()))])
#: Bins of a tally: counts by the number of their bits.
BINS = 48


def pack(x: np.ndarray) -> bytes:
    """64-bit integers as planes of bytes, lowest first, compressed: planes of high bytes are mostly zero."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: pa.BinaryScalar | bytes) -> np.ndarray:
    raw = memoryview(data.as_buffer() if isinstance(data, pa.Scalar) else data)
    n = int.from_bytes(raw[:8], "little")
    planes = pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def sizes(texts: DataFrame, column: str = "text") -> tuple[int, int, int]:
    """(chunks, parts, bits of the volume) for the texts."""
    volume = text_volume(texts, column)
    return max(1, -(-volume // CHUNK_CHARS)), max(1, -(-volume // PART_CHARS)), volume.bit_length()


def tally(counts: np.ndarray) -> np.ndarray:
    """How many of the counts have so many bits each, and their sums: 2 * BINS numbers."""
    bits = np.minimum(np.frexp(counts.astype(np.float64))[1], BINS - 1)
    return np.concatenate([np.bincount(bits, minlength=BINS), np.bincount(bits, weights=counts, minlength=BINS)]).astype(np.int64)


def count_keys(chunked: DataFrame, parts: list[int], widths: list[int], ask: Callable, tallied: bool = False, known: DataFrame | None = None) -> DataFrame:
    """(chunk, part, answer, tally): what the chunks asked for, to be given to use_counts().

    chunked has an int column chunk. ask(rows) gives, for each kind of keys, the chunk's distinct keys (uint64 of the kind's
    width in bits, ascending) and what it counts of each (unsigned); with known, earlier answers, it is ask(rows, answers), and
    where tallied it may give, as a second value, the tallies of counts that it knows without asking. Each kind has so many
    parts of its own, numbered on from those of the kind before. Rows with a tally have no chunk: spread_tallies() sums them up.
    Nothing runs yet: in one plan the chunks' rows, and answers that several steps use, are shuffled once.
    """
    edges = [np.array([(i << width) // n for i in range(n)], np.uint64) for n, width in zip(parts, widths, strict=True)]
    first = np.cumsum([0, *parts]).tolist()

    def asked(rows: pa.Table, answers: pa.Table | None) -> pa.Table:
        give_back()
        if not rows.num_rows:
            raise ValueError("an answer without its chunk")
        by_kind, *own = ask(rows) if answers is None else ask(rows, answers)
        number, held, keys_of, counts_of = rows["chunk"][0].as_py(), [], [], []
        for kind, (keys, counts) in enumerate(by_kind):
            edge = np.append(np.searchsorted(keys, edges[kind]), len(keys))
            full = np.flatnonzero(edge[1:] > edge[:-1])
            cut = [(int(edge[i]), int(edge[i + 1])) for i in full]
            held += (full + first[kind]).tolist()
            keys_of += [pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cut]
            counts_of += [pack(counts[a:b]) for a, b in cut]
        extra = [x for x in own if len(x)]
        columns = [held + [0] * len(extra), [number] * len(held) + [None] * len(extra), keys_of + [None] * len(extra), counts_of + [None] * len(extra), [None] * len(held) + extra]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ASK, strict=True)], schema=_ASK)

    def answering(rows: pa.Table) -> pa.Table:
        give_back()
        told = [x for x in rows["tally"].to_pylist() if x is not None]
        rows = rows.filter(pc.is_valid(rows["chunk"]))
        keys = [np.cumsum(unpack(x)) for x in rows["keys"]]
        counts = [unpack(x) for x in rows["counts"]]
        answers: list[bytes] = []
        if keys:
            all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(counts), minlength=len(all_keys)).astype(np.uint64)
            edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            # With each total goes whether other chunks asked for the key.
            answer = total << np.uint64(1) | (np.bincount(at) > 1)
            answers = [pack(answer[at[edge[i] : edge[i + 1]]]) for i in range(len(keys))]
            kind = int(np.searchsorted(first, rows["part"][0].as_py(), "right")) - 1
            told.append(tallies({kind: total}, len(parts)))
        told = [np.sum(told, axis=0).tolist()] if tallied and told else []
        columns = [rows["chunk"].to_pylist() + [None] * len(told), rows["part"].to_pylist() + [None] * len(told), answers + [None] * len(told), [None] * len(answers) + told]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ANSWER, strict=True)], schema=_ANSWER)

    schema = "part int, chunk int, keys binary, counts binary, tally array<long>"
    if known is None:
        asks = chunked.groupBy("chunk").applyInArrow(lambda rows: asked(rows, None), schema)
    else:
        asks = chunked.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(asked, schema)
    return asks.groupBy("part").applyInArrow(answering, "chunk int, part int, answer binary, tally array<long>")


def tallies(counts: dict[int, np.ndarray], kinds: int) -> list[int]:
    """The tallies of the counts of each kind of keys, one after the other; those of kinds without any are zeros."""
    none = np.empty(0, np.uint64)
    return np.concatenate([tally(counts.get(k, none)) for k in range(kinds)]).tolist()


def spread_tallies(answers: DataFrame, chunks: int) -> DataFrame:
    """(chunk, tally): the sums of the tallies, a fixed number of them, for every chunk."""
    each = answers.where(F.col("tally").isNotNull()).select(F.posexplode("tally")).groupBy("pos").agg(F.sum("col").alias("n"))
    whole = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias("tally"))
    return whole.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "tally")


def chunk_answers(answers: DataFrame) -> DataFrame:
    return answers.where(F.col("chunk").isNotNull()).select("chunk", "part", "answer")


def totals_of(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(totals, whether other chunks hold the key too) of the keys that a chunk asked for, in their order."""
    got = np.concatenate([np.empty(0, np.uint64), *(unpack(x) for x in answers.sort_by("part")["answer"])])
    return got >> np.uint64(1), (got & np.uint64(1)).astype(bool)


def use_counts(chunked: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """use(chunk's rows, what is told to it) of every chunk that has rows."""
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def using(rows: pa.Table, told: pa.Table) -> pa.Table:
        give_back()
        if rows.num_rows:
            return use(rows, told)
        if told["answer"].null_count < told.num_rows:
            raise ValueError("an answer without its chunk")
        return nothing

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(using, schema)


def in_chunks(rows: DataFrame, chunks: int, *by: str) -> DataFrame:
    """rows with their chunk, from a hash of the named columns."""
    return rows.withColumn("chunk", F.pmod(F.xxhash64(*by), F.lit(chunks)).cast("int"))
