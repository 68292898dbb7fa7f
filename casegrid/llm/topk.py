"""Exact top-k search by inner product: MaxScore over shards of component lists.

Every dimension is a term whose list holds its component in each vector of a shard. For a query the largest value that
each term can add is known. Terms that together can't lift a vector over the score of the k-th best so far are
non-essential: the others are summed for all vectors, and the non-essential ones are probed, largest bound first, only for
vectors that still compete. The best of each shard are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a shard, queries in a block, and vectors of a shard that are looked at together.
SHARD, BLOCK, STRIDE = 8192, 2048, 1024
#: Groups of shards for each core. Queries cross once for each group, so what is shuffled grows with the table.
GROUPS_A_CORE = 2


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, v, extra columns): components as floor(scale * x); without vectors that are null, empty or have null or non-finite
    parts, and without null ids. A component beyond 64 bits is an error."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"), *[c.alias(name) for name, c in (extra or {}).items()])
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(good)
    # floor() alone would give the nearest 64-bit integer.
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return rows.withColumn("v", F.transform("v", whole))


def _packed(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """Blocks of rows: (block, dim, ids, matrix), dealt evenly by a hash of id and row content."""

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        m = np.array(x["v"].tolist(), np.int64)
        order = np.argsort(x["id"].to_numpy(np.int64), kind="stable")
        return pd.DataFrame({name: [x[name].iloc[0]], "dim": [m.shape[1]], f"{name}_ids": [x["id"].to_numpy(np.int64)[order].tobytes()], f"{name}_m": [m[order].tobytes()]})

    dealt = rows.withColumns({name: F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"), "dim": F.size("v")})
    return dealt.groupBy(name, "dim").applyInPandas(pack, f"{name} int, dim int, {name}_ids binary, {name}_m binary")


def max_score(query: np.ndarray, own: int, lists: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of vectors that may be among the query's k best of this shard, all ties included.

    lists: the terms' lists, a row for each dimension; own: the id that is left out.
    """
    high, low = lists.max(axis=1), lists.min(axis=1)
    bounds = np.maximum(query * high, query * low)
    order = np.argsort(-(bounds - np.minimum(query * high, query * low)), kind="stable")  # terms that differ most first
    q, rest = query[order], np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # rest[i]: the most that terms from i on add
    least, at, scores = -np.inf, [], []
    best = np.empty(0)
    for start in range(0, lists.shape[1], STRIDE):
        alive = np.arange(start, min(start + STRIDE, lists.shape[1]))
        alive = alive[ids[alive] != own]
        done = 0
        partial = np.zeros(len(alive))
        # Essential: the first terms, without which no vector reaches the k-th best score; then the others by probing.
        first = len(q) if least == -np.inf else max(1, int(np.argmax(rest <= max(least, rest[-1]))))
        for upto in [first, *range(first + 8, len(q), 8), len(q)]:
            if upto <= done or not len(alive):
                continue
            terms = order[done:upto]
            partial = partial + q[done:upto] @ (lists[terms, start : start + STRIDE][:, alive - start] if len(alive) < STRIDE else lists[terms, start : start + STRIDE])
            done = upto
            if done < len(q):
                live = partial + rest[done] >= least
                alive, partial = alive[live], partial[live]
        at.append(alive)
        scores.append(partial)
        best = np.concatenate([best, partial])
        if len(best) > k:
            best = np.partition(best, len(best) - k)[-k:]
        if len(best) == k:
            least = best.min()
    at, scores = np.concatenate(at), np.concatenate(scores)
    keep = scores >= least
    return at[keep], scores[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best of vectors for each of queries, both as quantised() gives.

    Rows with the query's own id are left out; ties go to the smaller id; with fewer than k others, all are given. Rows
    that repeat an id are candidates each; queries that repeat both id and vector are one, and with other vectors are
    ranked each under their id. Vectors of another dimension than the query's never meet it. Null ids take no part, neither
    as candidates nor as queries. A score beyond 64 bits is an error. Empty tables give none. Shards are dealt to a fixed
    number of groups, and every group meets all blocks of queries, a pair of a shard and a block at a time; each pair gives k
    rows a query.
    """
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    groups = min(shards, GROUPS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism)
    packed = _packed(vectors, shards, "shard").withColumn("group", F.col("shard") % groups)
    asked = _packed(queries.distinct(), blocks, "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = packed.join(asked, ["group", "dim"])

    def search(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for row in x.itertuples(index=False):
                ids, own = np.frombuffer(row.shard_ids, np.int64), np.frombuffer(row.block_ids, np.int64)
                exact = np.frombuffer(row.shard_m, np.int64).reshape(len(ids), row.dim)
                asked = np.frombuffer(row.block_m, np.int64).reshape(len(own), row.dim)
                # Sums in doubles are exact while they stay under 2**53; beyond, Python's integers are used.
                small = float(np.abs(exact.astype(float)).max()) * float(np.abs(asked.astype(float)).max()) * row.dim < 2**52
                lists = np.ascontiguousarray(exact.T.astype(np.float64 if small else object))
                for q, who in zip(asked, own, strict=True):
                    if small:
                        at, scores = max_score(q.astype(np.float64), who, lists, ids, k)
                    else:
                        at = np.flatnonzero(ids != who)
                        scores = np.array([int(s) for s in q.astype(object) @ lists[:, at]], object)
                        if any(not -(2**63) <= s < 2**63 for s in scores):
                            raise OverflowError("a score is beyond 64 bits")
                    order = np.lexsort((ids[at], -scores.astype(np.float64)))[:k] if small else sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]]))[:k]
                    number = int.from_bytes(hashlib.blake2b(q.tobytes(), digest_size=8).digest(), "little", signed=True)
                    yield pd.DataFrame({"query_id": who, "query_no": number, "vec_id": ids[at][order], "score": scores[order].astype(np.int64)})

    local = met.mapInPandas(_gathered(search), "query_id long, query_no long, vec_id long, score long")
    best = W.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _gathered(search, rows: int = 50_000):
    """The frames of search joined to larger ones."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for x in search(frames):
            held.append(x)
            n += len(x)
            if n >= rows:
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    return run
