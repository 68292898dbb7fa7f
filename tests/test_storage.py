"""Scratch folders, numbering, blocked search, and jobs that are run again."""

import math
import random

import pytest
from pyspark.sql import functions as F

from casegrid import storage
from casegrid.operators import corpus, keyed_table, lookup, rank, vectors
from casegrid.streaming import jobs


def test_numbers_are_those_of_the_whole_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 30), i) for i in range(500)]
    got = storage.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), [F.desc("a"), "b"], "n", 5).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows, key=lambda x: (-x[0], x[1]))
    assert sorted(r["n"] for r in got) == list(range(5, 505))
    assert storage.numbered(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        storage.scratch_path(Cluster, "x")


def test_block_search_is_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    made = [(i, None if i == 7 else [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(3 if i % 11 else 2)]) for i in range(300)] + [(300, [0.0, 0.0, 0.0]), (301, []), (None, [1.0, 0.0, 0.0]), (302, [None, 1.0, 0.0])]
    corpus = spark.createDataFrame(made, "id long, vec array<float>").repartition(5)
    queries = spark.createDataFrame([x for x in made if x[0] is not None and x[0] % 50 == 0], "query_id long, query_vec array<float>")
    usable = {i: v for i, v in made if i is not None and v and None not in v and any(v)}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 6)
    want = []
    for q in [i for i in usable if i % 50 == 0]:
        best = sorted(((-cos(usable[q], v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])))[:6]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    got = rank.vector_topk(queries, corpus, 6).select("query_id", "id", "score", "rank").collect()
    assert sorted((a, b, round(c, 6), d) for a, b, c, d in got) == sorted((a, b, round(c + 0.0, 6), d) for a, b, c, d in want)
    assert rank.vector_topk(queries.limit(0), corpus, 6).count() == 0 and vectors.BLOCK > 0


def arrivals(spark, folder, rows):
    spark.createDataFrame(rows, "k long, v string, version int").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("k long, v string, version int").option("maxFilesPerTrigger", 1).parquet(folder)


def test_ingest_survives_restarts_and_resubmits(spark, tmp_path):
    source, path, check = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/check"
    asked = []

    def submit(rows):
        keys = sorted(r["k"] for r in rows.collect())
        asked.append(keys)
        failing = [2] if len(asked) == 1 else []
        return rows.select("k", F.when(F.col("k").isin(failing), "FAILED").otherwise("INDEXED").alias("status"))

    run = lambda stream: sorted(map(tuple, jobs.ingest(stream, "k", "version", path, check, submit).collect()))
    stream = arrivals(spark, source, [(1, "a", 1), (2, "b", 1), (2, "old", 0)])
    assert run(stream) == [(1, "a", 1), (2, "b", 1)]
    again = lambda: spark.readStream.schema("k long, v string, version int").option("maxFilesPerTrigger", 1).parquet(source)
    assert run(again()) == [(1, "a", 1), (2, "b", 1)]  # nothing new
    arrivals(spark, source, [(1, "older", 0), (3, "c", 1)])
    arrivals(spark, source, [(3, "d", 2)])
    assert run(again()) == [(1, "a", 1), (2, "b", 1), (3, "d", 2)]
    table = keyed_table.KeyedTable(spark, f"{path}/rows", "k")
    assert len(table.versions()) <= keyed_table.KEPT and table.manifest()["tags"]["batch"] == 2
    assert run(again()) == [(1, "a", 1), (2, "b", 1), (3, "d", 2)]
    assert asked == [[1, 2], [2], [3], []]


def test_first_run_without_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k long, v string, version int").parquet(f"{tmp_path}/in")
    assert jobs.ingest(stream, "k", "version", f"{tmp_path}/t", f"{tmp_path}/c").count() == 0
    assert jobs.stages(stream, "k", "v", "version", f"{tmp_path}/s", f"{tmp_path}/d").count() == 0


def test_a_batch_that_fails_before_its_manifest_is_taken_once(spark, tmp_path, monkeypatch):
    source, path, check = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/check"
    run = lambda stream, c=check: sorted(map(tuple, jobs.ingest(stream, "k", "version", path, c).collect()))
    assert run(arrivals(spark, source, [(i, "a", 1) for i in range(20)])) == [(i, "a", 1) for i in range(20)]
    stream = arrivals(spark, source, [(3, "b", 2), (50, "c", 1)])
    publish = keyed_table.KeyedTable._publish

    def broken(self, manifest, version):
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(keyed_table.KeyedTable, "_publish", broken)
    with pytest.raises(Exception, match="lost before"):
        run(stream)
    monkeypatch.setattr(keyed_table.KeyedTable, "_publish", publish)
    table = keyed_table.KeyedTable(spark, f"{path}/rows", "k")
    assert table.read().count() == 20 and table.read().where("v = 'b'").count() == 0  # as it was
    want = sorted([(i, "b" if i == 3 else "a", 2 if i == 3 else 1) for i in range(20)] + [(50, "c", 1)])
    assert run(arrivals(spark, source, [])) == want
    # Another checkpoint would take all batches again under the same numbers.
    with pytest.raises(Exception, match="another checkpoint"):
        run(arrivals(spark, source, []), f"{tmp_path}/other")


def test_an_upsert_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    base = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    table = keyed_table.KeyedTable(spark, f"{tmp_path}/t", "k").create(base.schema, 16)
    table.upsert(base)
    before = table.manifest()
    assert sum(p["rows"] for p in before["parts"].values()) == 5000 and len(before["parts"]) == 16
    delta = spark.createDataFrame([(7, "new"), (6000, "more")], "k long, v string")
    old = table.read()
    after = table.upsert(delta)
    changed = [b for b in after["parts"] if after["parts"][b]["folder"] != before["parts"][b]["folder"]]
    assert 1 <= len(changed) <= 2
    rewritten = sum(after["parts"][b]["rows"] for b in changed)
    assert rewritten <= 2 * 450  # two buckets of 16
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(table.read()) == rows(corpus.snapshot_upsert(base, delta, "k"))
    assert rows(old) == rows(base)  # a reader that began before
    assert {b: p["digest"] for b, p in table.upsert(delta)["parts"].items()} == {b: p["digest"] for b, p in after["parts"].items()}
    assert table.vacuum(1) >= len(changed) and rows(table.read()) == rows(corpus.snapshot_upsert(base, delta, "k"))
    table.update(spark.createDataFrame([(7, "newest"), (9, None), (9999, "x")], "k long, v string"), ["v"])
    assert {r["k"]: r["v"] for r in table.read().where("k in (7, 9, 9999)").collect()} == {7: "newest", 9: "v9"}
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, "x")], "k long, v string"))
    with pytest.raises(ValueError):
        keyed_table.KeyedTable(spark, f"{tmp_path}/none", "k").read()


def test_a_manifest_that_came_meanwhile_is_an_error(spark, tmp_path):
    table = keyed_table.KeyedTable(spark, f"{tmp_path}/t", "k").create(spark.createDataFrame([], "k long").schema, 4)
    table._publish(table.manifest(), 1)
    with pytest.raises(ValueError, match="meanwhile"):
        table._publish(table.manifest(), 1)
    assert table.versions() == [0, 1] and table.read().count() == 0


def test_sync_reads_differing_buckets_only_and_acts_as_the_full_join(spark, tmp_path):
    index = jobs.index_of(spark, f"{tmp_path}/i", "k").create(spark.createDataFrame([], "k long, status string").schema, 16)
    wanted = keyed_table.KeyedTable(spark, f"{tmp_path}/w", "key").create(spark.createDataFrame([], "key int").schema, 16)
    all_ = spark.range(1000)
    index.upsert(all_.select(F.col("id").alias("k"), F.lit("INDEXED").alias("status")))
    wanted.upsert(all_.select(F.col("id").cast("int").alias("key")))
    same = keyed_table.sync_changes(index, wanted, "status", True)
    assert keyed_table.differing(index, wanted) == [] and "FileScan" not in same._jdf.queryExecution().executedPlan().toString() and same.count() == 0
    index.upsert(spark.createDataFrame([(5, "FAILED"), (2000, "INDEXED")], "k long, status string"))
    wanted.upsert(spark.createDataFrame([(3000,)], "key int"))
    for delete in (True, False):
        got = sorted(map(tuple, keyed_table.sync_changes(index, wanted, "status", delete).collect()))
        full = lookup.sync_plan(index.read(), wanted.read().withColumnRenamed("key", "k"), "k", "status", delete).where("action <> 'skip'")
        assert got == sorted(map(tuple, full.collect())) and len(got) == 3
    assert len(keyed_table.differing(index, wanted)) <= 2


def test_old_bases_and_batches_go(spark, tmp_path):
    path = f"{tmp_path}/s"
    jobs._begin(spark, spark.createDataFrame([], "k long, v string, t long").schema, path)
    for n in range(6):
        jobs._write(spark.createDataFrame([(n % 2, f"v{n}", n)], "k long, v string, t long"), path, "batch", n)
        if n % 2:
            assert jobs.compact(spark, path, "k", "t")
    assert storage.names(spark, f"{path}/kind=base") == ["upto=3", "upto=5"] or storage.names(spark, f"{path}/kind=base")[-2:] == ["upto=3", "upto=5"]
    assert "upto=0" not in storage.names(spark, f"{path}/kind=batch") and "upto=1" not in storage.names(spark, f"{path}/kind=batch")
    assert sorted(map(tuple, jobs.current(spark, path, "k", "t").collect())) == [(0, "v4", 4), (1, "v5", 5)]
