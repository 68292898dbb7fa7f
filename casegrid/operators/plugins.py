"""Where users bring their own functions: batched embedding and reranking."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lookup import exact_key_lookup
from .rank import vector_topk


def hashing_embedder(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words: deterministic, for tests and as a default."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in t.split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def embed_batches(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]] = hashing_embedder, batch: int = 32) -> DataFrame:
    """rows with embedding, from a function that takes a batch of texts; the text that is stored is the one embedded.

    Each batch goes on as soon as it is embedded: a worker holds Python objects of one batch, not of all that came with it."""
    at = rows.columns.index(text)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(0, frame.num_rows, batch):
                part = frame.slice(i, batch)
                vectors = embed([x or "" for x in part.column(at).to_pylist()])
                found = pa.array([None if v is None else np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*frame.schema.names, "embedding"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, embedding array<float>")


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(0.0)


def rerank_with(candidates: DataFrame, by: str, rank: Callable[[pd.DataFrame], list] | None = None) -> DataFrame:
    """(by, id, ext): an external order of candidates (by, id, pos, query, text). rank takes one query's rows and gives ids
    in its order; without it lexical overlap decides, in plain columns."""
    if rank is None:
        scored = candidates.withColumn("s", lexical_overlap(F.col("query"), F.col("text")))
        return scored.select(by, "id", F.row_number().over(W.partitionBy(by).orderBy(F.desc("s"), "pos")).alias("ext"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        ids = rank(x)
        return pd.DataFrame({by: x[by].iloc[0], "id": ids, "ext": range(1, len(ids) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, id {kinds['id']}, ext int")


class Provider(Protocol):
    """What a retrieval back end offers, as functions of tables: any object with these methods can stand in."""

    def similar(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) for queries (query_id, query_vec)."""

    def articles(self, requests: DataFrame) -> DataFrame:
        """(by, pos, key, text, found) for requests (by, keys)."""


class TableProvider:
    """A provider over plain tables: chunks (id, vec) and articles (key, text)."""

    def __init__(self, chunks: DataFrame, articles: DataFrame) -> None:
        self._chunks, self._articles = chunks, articles

    def similar(self, queries: DataFrame, k: int) -> DataFrame:
        return vector_topk(queries, self._chunks, k)

    def articles(self, requests: DataFrame) -> DataFrame:
        return exact_key_lookup(requests, "by", "keys", self._articles, "key", "text")
