"""Similarities of a stated query set to all vectors of a corpus, in tiles of both."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import cells, met, shape

#: Queries and vectors that are scored together.
QUERIES, BLOCK = 256, 4096


def _side(rows: DataFrame, key: str, vec: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, v, dim, x0, x1, ...) with extra integer columns (null: -1), without null keys and null or empty vectors."""
    chosen = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(f"x{i}") for i, c in enumerate(extra)])
    return chosen.where(F.col("id").isNotNull() & (F.size("v") > 0)).withColumn("dim", F.size("v"))


def _tiled(queries: DataFrame, corpus: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """work(part of the corpus, part of the queries) for every tile of both, vectors of one length together."""
    held, asked = _side(corpus, "id", "vec", extra), _side(queries, "query_id", "query_vec")
    grid = shape(cells(held, F.size("v")), cells(asked, F.size("v")), corpus.sparkSession.sparkContext.defaultParallelism)
    return met(held, asked, grid, (["id", "v"], ["id", "v"]), ["dim"], work, schema)


def _unit(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids ascending, vectors scaled to length 1, extra columns); vectors of length zero or with null parts are left out."""
    m = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    ids, norm = rows["id"].to_numpy(), np.sqrt((m * m).sum(axis=1))
    order = np.argsort(ids, kind="stable")
    order = order[norm[order] > 0]
    extra = [rows[c].to_numpy()[order] for c in rows.column_names if c.startswith("x")]
    return ids[order], m[order] / norm[order, None], extra


def _scored(corpus: pa.Table, queries: pa.Table) -> Iterator[tuple]:
    """(numbers of some queries, their ids, where some of the corpus begins, its ids, scores, extra columns), ids ascending; a
    query's own id scores minus infinity, and the others the cosine rounded to 6 places."""
    ids, m, extra = _unit(corpus)
    q_ids, q_m, _ = _unit(queries)
    for at in range(0, len(q_ids), QUERIES):
        own = q_ids[at : at + QUERIES]
        for begin in range(0, len(ids), BLOCK):
            some = ids[begin : begin + BLOCK]
            scores = np.round(q_m[at : at + QUERIES] @ m[begin : begin + BLOCK].T, 6)
            scores[own[:, None] == some[None, :]] = -np.inf
            yield at, own, some, scores, [x[begin : begin + BLOCK] for x in extra]


def _first(groups: list[np.ndarray], k: int) -> np.ndarray:
    """Which of sorted rows are among the first k of their group."""
    n = len(groups[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for g in groups:
        new[1:] |= np.diff(g) != 0
    begins = np.flatnonzero(new)
    return np.arange(n) - np.repeat(begins, np.diff(begins, append=n)) < k


def _joined(parts: list[list[np.ndarray]], kinds: list) -> list[np.ndarray]:
    return [np.concatenate([np.empty(0, kind), *x]) for x, kind in zip(parts, kinds, strict=True)]


def block_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each tile the k vectors of the corpus most similar to each query, other than itself, by the
    cosine rounded to 6 places and then the smaller id. What the k best of all tiles have in common is a superset of the
    answer. No task gets more than a tile of either side; a tile's blocks are merged in it."""

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for at, own, ids, scores, _ in _scored(held, asked):
            if scores.shape[1] > 4 * k:
                least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                q, c = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            else:
                q, c = np.nonzero(np.isfinite(scores))
            # Ties at the k-th place go by id, so they are cut here already.
            best = np.lexsort((ids[c], -scores[q, c], q))
            q, c = q[best], c[best]
            q, c = (x[_first([q], k)] for x in (q, c)) if len(q) else (q, c)
            for part, x in zip(parts, (q + at, own[q], ids[c], scores[q, c]), strict=True):
                part.append(x)
        number, own, ids, scores = _joined(parts, [np.int64, np.int64, np.int64, np.float64])
        best = np.lexsort((ids, -scores, number))
        if len(best):
            best = best[_first([number[best]], k)]
        return pa.table([pa.array(x[best]) for x in (own, ids, scores)], names=["query_id", "id", "score"])

    return _tiled(queries, corpus, search, "query_id long, id long, score double")


def block_group_topk(queries: DataFrame, corpus: DataFrame, k: int, group: Callable, name: str | None = None) -> DataFrame:
    """(query_id, id, grp, name, score): of each tile the k vectors of the corpus most similar to each query in each group,
    each name once at its best, by rounded cosine and then the smaller id.

    corpus: (id, vec, attr, ...); group(query ids, attrs, scores) gives an integer for every pair, from columns of shape
    (queries, 1), (1, vectors) and (queries, vectors). name: an integer column of the corpus; without it every id is its own.
    """

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]

        def best_of(number, own, ids, groups, named, scores):
            order = np.lexsort((ids, -scores, groups, number))
            if len(order) and name is not None:
                _, first = np.unique(np.stack([number[order], groups[order], named[order]]), axis=1, return_index=True)
                order = order[np.sort(first)]
            if len(order):
                order = order[_first([number[order], groups[order]], k)]
            return [x[order] for x in (number, own, ids, groups, named, scores)]

        for at, own, ids, scores, (attr, named) in _scored(held, asked):
            q, c = np.nonzero(np.isfinite(scores))
            groups = np.broadcast_to(group(own[:, None], attr[None, :], scores), scores.shape)[q, c].astype(np.int64)
            for part, x in zip(parts, best_of(q + at, own[q], ids[c], groups, named[c], scores[q, c]), strict=True):
                part.append(x)
        _, *columns = best_of(*_joined(parts, [np.int64] * 5 + [np.float64]))
        return pa.table([pa.array(x) for x in columns], names=["query_id", "id", "grp", "name", "score"])

    return _tiled(queries, corpus, search, "query_id long, id long, grp long, name long, score double", ("attr", name or "id"))
