"""What the operators of this subpackage share: scratch tables, Arrow helpers, word hashing."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.storage import materialize, scratch_path  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def free_prefix(columns: Iterable[str], base: str) -> str:
    """base, made longer until no column begins with it, so that names after it can't clash."""
    while any(c.lower().startswith(base.lower()) for c in columns):
        base += "_"
    return base


def text_volume(texts: DataFrame, column: str = "text") -> int:
    """Characters in the column, from one aggregation; it only sizes partitions."""
    return int(texts.agg(F.sum(F.length(column)).alias("v")).first()["v"] or 0)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few rows at a time are turned into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], tuple]],
    keys: list[str],
    text: str,
    fields: list[tuple[str, pa.DataType]],
    schema: str,
    as_bytes: bool = False,
    step: int = 1000,
) -> DataFrame:
    """Run a per-task function over the texts, Arrow batch by Arrow batch.

    make() is called once in each task; what it returns gets a list of texts (str, or bytes if as_bytes; None where
    the column is null) and gives one list for each of fields. The key columns are passed through.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches, step):
            column = batch.column(len(keys))
            texts = (column.cast(pa.large_binary()) if as_bytes else column).to_pylist()
            out = work(texts)
            arrays = [batch.column(i) for i in range(len(keys))]
            arrays += [a if isinstance(a, pa.Array) else pa.array(a, kind) for a, (_, kind) in zip(out, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"k{i}" for i in range(len(keys))), *(n for n, _ in fields)])

    return _mapped(df, run, keys, text, schema)


def map_arrays(df: DataFrame, work: Callable[[pa.Array], tuple], keys: list[str], text: str, fields: list[tuple[str, pa.DataType]], schema: str, step: int = 250) -> DataFrame:
    """As map_texts, for functions that take the texts as an Arrow array and make no Python object of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, step):
            out = work(batch.column(len(keys)))
            arrays = [batch.column(i) for i in range(len(keys))]
            arrays += [a if isinstance(a, pa.Array) else pa.array(a, kind) for a, (_, kind) in zip(out, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"k{i}" for i in range(len(keys))), *(n for n, _ in fields)])

    return _mapped(df, run, keys, text, schema)


def _mapped(df: DataFrame, run: Callable, keys: list[str], text: str, schema: str) -> DataFrame:
    chosen = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").cast("string").alias("text_"))
    types = ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    out = chosen.mapInArrow(run, f"{types}, {schema}" if types else schema)
    return out.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased. Words are parted by ASCII white space only, as bytes.split does."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a text that are hashed in one go, and bytes from which a word is hashed by the library instead.
_PIECE, _LONG = 1 << 18, 256
#: The byte classes: white space parts words. The hash of a word is mixed from the sum of a 64-bit value for each byte,
#: times the power of an odd base for its place.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for the places in a piece."""
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(_PIECE + 1, _BASE, np.uint64))
        down = np.multiply.accumulate(np.full(_PIECE + 1, pow(_BASE, -1, 1 << 64), np.uint64))
    return up, down


_VALUES = {flag: _byte_values(flag) for flag in (False, True)}


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the words data[start:end], in the order of their places; A-Z count as a-z if lower."""
    out = np.empty(len(start), np.uint64)
    up, down = _powers()
    at = 0
    while at < len(start):
        # As many whole words as fit in a piece.
        begin = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, begin + _PIECE, "right")))
        if end[at] - begin <= _PIECE:
            values = _VALUES[lower][data[begin : end[to - 1]]]
            values *= up[: len(values)]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
            a, b = start[at:to] - begin, end[at:to] - begin
            out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    for i in np.flatnonzero(end - start >= _LONG):
        word = data[start[i] : end[i]].tobytes()
        out[i] = xxhash.xxh64_intdigest(word.lower() if lower else word)
    return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, where each begins with the total last); null texts are empty."""
    column = texts.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    first = int(edge[0]) if len(edge) else 0
    return whole[first : int(edge[-1])] if len(edge) else whole, edge - first


def word_places(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, where each text's words begin with the total last) of the words of all texts. Words are parted by
    ASCII white space only, as bytes.split does."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(edge), np.int64)
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    # A text's first byte begins a word and its last one ends one, whatever its neighbours hold.
    full = edge[1:] > edge[:-1]
    firsts, lasts = edge[:-1][full], edge[1:][full] - 1
    begins[firsts], stops[lasts] = inside[firsts], inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(start, edge)


def hash_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, where each text's begin with the total last), without a Python object for
    each word. The same word has the same hash in every task."""
    data, edge = text_buffer(texts)
    start, end, at = word_places(data, edge)
    return _word_hashes(data, start, end, lower), at
