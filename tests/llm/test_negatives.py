"""Hard negatives against brute force, and Four-Russians scores against products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from casegrid.llm import negatives, queries
from casegrid.operators import tiles


@pytest.mark.parametrize("dim,low,high", [(1, -1, 1), (7, -300, 300), (64, -256, 256), (65, 0, 9), (8, -(2**40), 2**40), (3, 0, 1)])
def test_scores_are_inner_products(dim, low, high):
    rng = np.random.default_rng(dim)
    a, c = rng.integers(low, high, (5, dim)), rng.integers(low, high, (97, dim))
    a[0], c[0] = low, low
    got = negatives.scores(negatives.subset_sums(a), negatives.planes_of(c).astype(np.intp))
    with np.errstate(over="ignore"):
        assert (got == c @ a.T).all()


def brute(rows, anchors, k=5):
    out = []
    for i, label, v in sorted({(r[0], r[1], tuple(r[2])) for r in anchors}):
        met = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in rows if j != i and len(w) == len(v))
        for p, j, _ in [x for x in met if x[2] == label][:k]:
            low = [(s, n) for s, n, m in met if m != label and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(low)]
    return sorted(out)


def made(n, dim, labels, spread, seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(-spread, spread, (3, dim))
    return [(i, int(rng.integers(labels)), (centre[rng.integers(3)] + rng.integers(-3, 4, dim)).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, v array<long>").repartition(3)


@pytest.mark.parametrize("n,dim,labels,spread", [(400, 6, 3, 8), (300, 9, 1, 5), (300, 3, 50, 2), (40, 17, 2, 10**6)])
def test_mining_equals_brute_force(spark, n, dim, labels, spread):
    rows = made(n, dim, labels, spread, n)
    df = frame(spark, rows)
    got = sorted(map(tuple, negatives.mine(df, df.where(F.col("id") % 10 == 0)).collect()))
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0])


def test_many_small_tiles_give_the_same(spark, monkeypatch):
    rows = made(600, 5, 2, 6, 1)
    df = frame(spark, rows)
    asked = df.where(F.col("id") % 3 == 0)
    monkeypatch.setattr(tiles, "TILE_CELLS", 400)
    assert tiles.shape(3000, 1000, 4) == (8, 3)
    assert sorted(map(tuple, negatives.mine(df, asked).collect())) == brute(rows, [r for r in rows if r[0] % 3 == 0])


def test_one_label_and_one_vector_in_a_third_of_all_rows(spark):
    rows = made(600, 5, 4, 6, 2)
    rows = [(i, 0, [5, 5, 5, 5, 5]) if i % 3 == 0 else r for i, r in enumerate(rows)]
    df = frame(spark, rows)
    assert sorted(map(tuple, negatives.mine(df, df.where(F.col("id") % 12 == 0)).collect())) == brute(rows, [r for r in rows if r[0] % 12 == 0])


def test_repeated_rows_other_dimensions_and_short_lists(spark):
    rows = made(60, 4, 2, 4, 3)
    rows += [rows[0], (0, rows[0][1], [1, 1, 1, 1]), rows[7], (100, 1, [1, 2]), (101, 0, [2, 1]), (102, 1, [2, 2]), (103, 1, [9] * 11)]
    df = frame(spark, rows)
    assert sorted(map(tuple, negatives.mine(df, df.where(F.col("id") % 10 == 0)).collect())) == brute(rows, [r for r in rows if r[0] % 10 == 0])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1, "c"), (1, [1.0, 0.25], 1, "c"), (2, [0.9, 0.25], 2, "c"), (3, None, 1, "c"), (4, [], 1, "c"), (5, [1.0, None], 1, "c"), (6, [nan, 1.0], 1, "c"), (8, [inf, 1.0], 2, "c"), (9, [1.0, 1.0], None, "c"), (None, [1.0, 1.0], 1, "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")
    df = negatives.labelled(vectors, F.col("label"))
    assert sorted(r["id"] for r in df.collect()) == [0, 1, 2]
    assert [tuple(r) for r in negatives.mine(df, df.where("id = 0")).collect()] == [(0, 1, 1, 2, 256 * 256 + 128 * 64, 230 * 256 + 128 * 64)]
    none = df.where("id < 0")
    assert negatives.mine(none, none).count() == 0 and negatives.mine(df, none).count() == 0 and negatives.mine(none, df).count() == 0


def test_values_beyond_64_bits_are_errors(spark):
    big = spark.createDataFrame([(0, [1e18, 1.0], 1), (1, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="beyond 64 bits"):
        negatives.labelled(big, F.col("label")).collect()
    rows = frame(spark, [(0, 1, [2**40] * 4), (1, 1, [2**40] * 4), (2, 2, [1] * 4)])
    with pytest.raises(Exception, match="beyond 64 bits"):
        negatives.mine(rows, rows.where("id = 0")).collect()


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, i % 2, [2**30 + i * 7, 2**29 - i, 2**30 + 3 * i]) for i in range(30)]
    df = frame(spark, rows)
    assert sorted(map(tuple, negatives.mine(df, df.where(F.col("id") % 10 == 0)).collect())) == brute(rows, [r for r in rows if r[0] % 10 == 0])


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert oracle.difference(queries.op12_hard_negatives(spark, sf), oracle.connect(sf), queries.oracle_sql()["op12_hard_negatives"]) == ""
