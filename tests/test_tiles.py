"""Tiles: every row meets every other, and what a task gets doesn't grow with the number of queries."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casegrid.functions import edits
from casegrid.operators import tiles, vectors


def frame(spark, n, seed, names):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(n)], f"{names[0]} long, {names[1]} array<double>")


def sizes_of_tiles(spark, queries, corpus):
    seen = vectors._tiled(queries, corpus, lambda a, b: pa.table({"held": [a.num_rows], "asked": [b.num_rows], "pairs": [a.num_rows * b.num_rows]}), "held long, asked long, pairs long")
    return seen.agg(F.max("held"), F.max("asked"), F.sum("pairs")).first()


def test_a_tile_does_not_grow_with_the_queries(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_CELLS", 800)
    corpus = frame(spark, 1000, 1, ("id", "vec"))
    for n in (300, 1500, 3000):
        held, asked, pairs = sizes_of_tiles(spark, frame(spark, n, 2, ("query_id", "query_vec")), corpus)
        assert pairs == 1000 * n
        # A tile has room for 200 vectors of either side; dealing by a hash isn't quite even.
        assert held <= 320 and asked <= 320


def test_best_of_tiles_are_the_best(spark, monkeypatch):
    corpus, queries = frame(spark, 500, 3, ("id", "vec")), frame(spark, 90, 4, ("query_id", "query_vec"))
    unit = lambda rows: {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows if np.linalg.norm(r[1]) > 0}
    c, q = unit(corpus.collect()), unit(queries.collect())
    want = sorted((i, *x) for i, v in q.items() for x in sorted(((j, round(float(v @ w), 6)) for j, w in c.items() if j != i), key=lambda x: (-x[1], x[0]))[:7])
    for cells, block in ((1 << 22, 4096), (300, 16)):
        monkeypatch.setattr(tiles, "TILE_CELLS", cells)
        rows = [tuple(r) for r in vectors.block_topk(queries, corpus, 7).collect()]
        got = []
        for i in q:
            mine = sorted((r for r in rows if r[0] == i), key=lambda r: (-r[2], r[1]))[:7]
            got += [(i, j, round(s, 6)) for _, j, s in mine]
        assert [(a, round(s, 5)) for a, _, s in sorted(got)] == [(a, round(s, 5)) for a, _, s in want]


def test_odd_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (None, [1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [1.0, 1.0])], "id long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (9, [2.0, 2.0, 2.0]), (8, None)], "query_id long, query_vec array<double>")
    assert sorted(tuple(r) for r in vectors.block_topk(queries, corpus, 3).collect()) == [(1, 7, 0.707107), (9, 6, 1.0)]
    assert vectors.block_topk(queries.where("query_id < 0"), corpus, 3).count() == 0


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("block", [3, 64, 8192])
def test_edit_distances_are_exact(monkeypatch, block):
    monkeypatch.setattr(edits, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(500):
        a, b = ("".join(rng.choice("ab日") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert edits.edit_distance(a, b) == plain(a, b)


def test_edits_of_long_texts_take_seconds(spark):
    import time

    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    b = "".join(x for x in a if rng.random() > 0.02)
    begin = time.time()
    n = edits.edit_distance(a, b)
    assert time.time() - begin < 60 and len(a) - len(b) <= n <= len(a) - len(b) + 10
    rows = spark.createDataFrame([("kitten", "sitting"), (None, "x"), ("x" * 300, "x" * 290 + "y"), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(edits.edits(F.col("a"), F.col("b"))).collect()] == [3, None, 10, 0]


def test_pages_come_from_the_ranges_that_hold_them(spark, tmp_path):
    from casegrid.operators.page_index import PageIndex

    rows = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))
    index = PageIndex(spark, f"{tmp_path}/p", [F.desc("g"), F.col("k")]).build(rows, 12)
    order = sorted(((r["k"], r["g"]) for r in rows.collect()), key=lambda x: (-x[1], x[0]))
    for number in (1, 2, 77, 149, 150, 400, 0):
        page = index.page(number)
        at = min(max(number, 1), 150)
        got = sorted((r["position"], r["k"], r["g"], r["page"]) for r in page.collect())
        assert got == [(i + 1, *order[i], at) for i in range((at - 1) * 20, at * 20)]
        assert len({f.split("range_=")[1].split("/")[0] for f in page.inputFiles()}) <= 2
    none = PageIndex(spark, f"{tmp_path}/n", [F.col("k")]).build(rows.limit(0))
    assert none.page(3).count() == 0
    with pytest.raises(Exception, match="counts.json|exist"):
        PageIndex(spark, f"{tmp_path}/gone", [F.col("k")]).page(1)
