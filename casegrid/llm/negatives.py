"""Hard-negative mining with Four-Russians scores.

A candidate's integer components are kept as bit planes: for eight dimensions and one bit, the eight bits are a byte. An
anchor has, for every eight dimensions, a table of the sums of each of the 256 subsets of its components there. A score is read
off by look-ups alone: from the highest plane (the sign's, which counts negative) down, what is there so far is doubled and the
tables' entries at the plane's bytes are added. Scores are the exact inner products.

Anchors meet candidates in tiles. A first meeting finds each anchor's positives among the rows of its label; a second one,
told the positives' scores, finds what lies in their bands among the rows of other labels. Each tile gives the few best rows
of every anchor, which are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.operators import tiles

from .topk import quantised

#: Anchors whose tables are held at a time, and candidates that are scored at a time.
ANCHORS, STRIDE = 32, 2048


def planes_of(v: np.ndarray) -> np.ndarray:
    """Bit planes of rows of integers: bytes of shape (planes, dimensions / 8, rows), lowest plane first and the sign's last;
    as many planes as the largest component needs. Missing dimensions of the last eight count as zero."""
    n, dim = v.shape
    most = max(int(v.max(initial=0)), -1 - int(v.min(initial=0)))
    wide = np.zeros((n, -(-dim // 8) * 8), np.int64)
    wide[:, :dim] = v
    out = [np.packbits((wide >> p & 1).astype(bool), axis=1, bitorder="little").T for p in range(most.bit_length() + 1)]
    return np.stack(out)


def subset_sums(v: np.ndarray) -> np.ndarray:
    """For rows of integers, the sums of all subsets of each eight components: shape (dimensions / 8, 256, rows)."""
    n, dim = v.shape
    wide = np.zeros((n, -(-dim // 8) * 8), np.int64)
    wide[:, :dim] = v
    groups = wide.reshape(n, -1, 8).transpose(1, 2, 0)
    out = np.zeros((groups.shape[0], 256, n), np.int64)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + groups[:, j : j + 1]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products, of shape (candidates, anchors), of subset sums and bit planes. Arithmetic wraps at 64 bits, so a product
    that fits is exact whatever its parts are; tables of 32 bits are for products that fit there."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for p in range(len(planes) - 1, -1, -1):
        total += total
        for table, byte in zip(tables, planes[p], strict=True):
            if p == len(planes) - 1:
                total -= table[byte]
            else:
                total += table[byte]
    return total


class Candidates:
    """One tile's candidates of one dimension, ascending by id, in groups of equal label."""

    def __init__(self, rows: pa.Table, dim: int) -> None:
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[self.order], labels[self.order]
        groups = -(-dim // 8)
        packed = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, groups) for x in rows["planes"].combine_chunks()]
        most = max(map(len, packed))
        # Rows with fewer planes repeat their sign's.
        bits = np.stack([np.concatenate([x, np.repeat(x[-1:], most - len(x), axis=0)]) if len(x) < most else x for x in packed])
        self.planes = np.ascontiguousarray(bits[self.order].transpose(1, 2, 0))
        self.most = 1 << (most - 1)


def _components(rows: pa.Table) -> np.ndarray:
    return rows["v"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)


def _scored(held: Candidates, v: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, scores) of candidates a to b, some at a time, with the anchors of v."""
    bound = held.most * np.abs(v.astype(np.float64)).sum(axis=1).max()
    tables = subset_sums(v)
    if bound < 2**30:
        tables = tables.astype(np.int32)
    for at in range(a, b, STRIDE):
        part = held.planes[:, :, at : min(at + STRIDE, b)].astype(np.intp)
        if bound >= 2**62:
            # The same in doubles tells whether any product is beyond 64 bits.
            if np.abs(_rough(subset_sums(v), part)).max() >= 2.0**63 * (1 - 1e-9):
                raise OverflowError("a score is beyond 64 bits")
        yield at, at + part.shape[2], scores(tables, part)


def _rough(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return scores(tables.astype(np.float64), planes)


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first k of the places by descending score; places ascend with ids, so ties go to the smaller id."""
    if len(at) > 4 * k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.argsort(-score[at], kind="stable")][:k]


def _packed(rows: DataFrame) -> DataFrame:
    """(id, label, dim, planes) of candidates; nothing is shuffled."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                planes = planes_of(some.column(3).flatten().to_numpy().reshape(-1, dim))
                data = np.ascontiguousarray(planes.transpose(2, 0, 1)).reshape(some.num_rows, -1)
                packed = pa.array([x.tobytes() for x in data], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), packed], names=["id", "label", "dim", "planes"])

    return rows.select("id", "label", F.size("v").alias("dim"), "v").mapInArrow(pack, "id long, label long, dim int, planes binary")


_NUMBER = "anchor_no"


def _numbered(anchors: DataFrame) -> DataFrame:
    """Anchors once each, with a number that tells those of one id apart."""
    return anchors.distinct().withColumn(_NUMBER, F.xxhash64("label", "v"))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5)) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    rows and anchors: (id long, label long, v array of long), without nulls, as labelled() gives. An anchor's positives are its
    first rows of the same label by descending score, ties by smaller id; for each of them the first rows of other labels come
    whose score is at most the positive's and at least low (a fraction) of it. Where there are fewer, all come; a positive
    without any gives no rows, and so does a negative positive_score, as no score lies in its band.

    Rows with an anchor's id are never its candidates. Rows that repeat an id are candidates each; anchors that repeat id,
    label and vector are one, and with another label or vector are mined each. Vectors of another dimension never meet.
    Empty tables give none. A score beyond 64 bits is an error.

    A tile holds a bounded part of the rows and of the anchors, whatever their number and however labels are spread.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    grid = tiles.shape(tiles.cells(rows, F.size("v")), tiles.cells(anchors, F.size("v")), cores)
    packed, asked = _packed(rows), _numbered(anchors).withColumn("dim", F.size("v"))
    deal = (["id", "planes"], ["id", _NUMBER])

    def met(some: DataFrame, work: Callable, schema: str) -> DataFrame:
        return tiles.met(packed, some, grid, deal, ["dim"], work, schema)

    def find_positives(a: pa.Table, b: pa.Table) -> pa.Table:
        held, v = Candidates(a, b["dim"][0].as_py()), _components(b)
        ids, labels, numbers = b["id"].to_numpy(), b["label"].to_numpy(), b[_NUMBER].to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], []]
        for label in np.unique(labels):
            begin, end = np.searchsorted(held.labels, [label, label], "left")[0], np.searchsorted(held.labels, label, "right")
            mine_ = np.flatnonzero(labels == label)
            for i in range(0, len(mine_) if end > begin else 0, ANCHORS):
                some = mine_[i : i + ANCHORS]
                best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(some)
                for at, to, found in _scored(held, v[some], begin, end):
                    for j, anchor in enumerate(some):
                        top = _best(found[:, j], np.flatnonzero(held.ids[at:to] != ids[anchor]), positives)
                        near, score = np.concatenate([best[j][0], held.ids[at + top]]), np.concatenate([best[j][1], found[top, j].astype(np.int64)])
                        keep = np.argsort(-score, kind="stable")[:positives]
                        best[j] = near[keep], score[keep]
                for anchor, (near, score) in zip(some, best, strict=True):
                    for column, x in zip(out, (np.full(len(near), ids[anchor]), np.full(len(near), numbers[anchor]), near, score), strict=True):
                        column.append(x)
        return _table(out, ["id", _NUMBER, "positive_id", "positive_score"])

    local = met(asked, find_positives, f"id long, {_NUMBER} long, positive_id long, positive_score long")
    first = W.partitionBy("id", _NUMBER).orderBy(F.desc("positive_score"), "positive_id")
    placed = local.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    told = placed.groupBy("id", _NUMBER).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    told = told.select("id", _NUMBER, F.col("p.place").alias("places"), F.col("p.positive_id").alias("near"), F.col("p.positive_score").alias("marks"))
    banded = asked.join(told, ["id", _NUMBER])

    def find_negatives(a: pa.Table, b: pa.Table) -> pa.Table:
        held, v = Candidates(a, b["dim"][0].as_py()), _components(b)
        ids, labels, numbers = b["id"].to_numpy(), b["label"].to_numpy(), b[_NUMBER].to_numpy()
        near, marks = b["near"].to_pylist(), b["marks"].to_pylist()
        # The least whole score that is at least the fraction of each mark.
        floors = [[-(-low[0] * m // low[1]) for m in x] for x in marks]
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for i in range(0, len(ids), ANCHORS):
            some = range(i, min(i + ANCHORS, len(ids)))
            found_ids: list[list[np.ndarray]] = [[] for _ in some]
            found_scores: list[list[np.ndarray]] = [[] for _ in some]
            for at, to, found in _scored(held, v[i : i + ANCHORS], 0, len(held.ids)):
                for j, anchor in enumerate(some):
                    s = found[:, j]
                    inside = np.flatnonzero((s <= max(marks[anchor])) & (s >= min(floors[anchor])))
                    inside = inside[(held.labels[at + inside] != labels[anchor]) & (held.ids[at + inside] != ids[anchor])]
                    # What no positive's first few can be goes at once.
                    order = inside[np.lexsort((held.ids[at + inside], -s[inside].astype(np.int64)))]
                    own = -s[order].astype(np.int64)
                    keep = np.unique(np.concatenate([np.arange(x := np.searchsorted(own, -m), min(x + negatives, np.searchsorted(own, -f, "right"))) for m, f in zip(marks[anchor], floors[anchor], strict=True)]))
                    found_ids[j].append(held.ids[at + order[keep]])
                    found_scores[j].append(-own[keep])
            for j, anchor in enumerate(some):
                them, s = np.concatenate(found_ids[j]), np.concatenate(found_scores[j])
                order = np.lexsort((them, -s))
                them, own = them[order], -s[order]
                for place, (name, m, f) in enumerate(zip(near[anchor], marks[anchor], floors[anchor], strict=True)):
                    x = int(np.searchsorted(own, -m))
                    y = min(x + negatives, int(np.searchsorted(own, -f, "right")))
                    n = max(0, y - x)
                    values = (np.full(n, ids[anchor]), np.full(n, numbers[anchor]), np.full(n, place), np.full(n, name), np.full(n, m), them[x : x + n], -own[x : x + n])
                    for column, part in zip(out, values, strict=True):
                        column.append(part)
        return _table(out, ["anchor_id", _NUMBER, "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    schema = f"anchor_id long, {_NUMBER} long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = met(banded.drop("places"), find_negatives, schema)
    best = W.partitionBy("anchor_id", _NUMBER, "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(columns: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table([pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in columns], names=names)


def labelled(vectors: DataFrame, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v) for mine(): components as floor(scale * x); without rows whose label, id or vector is null or empty, or
    whose vector has null or non-finite parts."""
    rows = quantised(vectors, id_col, vec_col, scale, {"label": label.cast("long")})
    return rows.where(F.col("label").isNotNull()).select(F.col("id").cast("long").alias("id"), "label", "v")
