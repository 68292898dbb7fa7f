"""Case states: any order, repeats, restarts, failures and evicted state give what one fold over all events gives."""

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from casegrid.operators import keyed_table
from casegrid.streaming import states

SCHEMA = "k string, at long, stage string, status string, error string, more int"


def brute(events):
    out = {}
    for k, at, stage, status, error, *_ in events:
        if k is None or at is None or (stage is None and status is None):
            continue
        s = out.setdefault(k, [(-1, None), (-1, None, "")])
        if stage is not None:
            s[0] = max(s[0], (at, stage), key=lambda x: (x[0], x[1] or ""))
        if status is not None:
            new = (at, status, (error or "") if status == "error" else None)
            s[1] = max(s[1], new, key=lambda x: (x[0], x[1] or "", x[2] or ""))
    none = lambda x, n: x if x[1] is not None else (None,) * n
    return sorted((k, *none(a, 2), *none(b, 3)) for k, (a, b) in out.items())


def made(seed, n):
    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    return [(pick(None, "hot", "hot", "hot", *(f"c{i}" for i in range(12))), pick(None, *range(30)), pick(None, "f1", "f2", "", "訴"), pick(None, "error", "processing", "done"), pick(None, "", "boom", "x" * 3000), 1) for _ in range(n)]


def put(spark, source, events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_states_equal_one_fold_over_all_events(spark, tmp_path):
    source, path, check = f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/c"
    first, second = made(1, 400), made(2, 300)
    put(spark, source, first)
    assert rows(states.case_states(put(spark, source, first[:100]), "k", "at", path, check, buckets=4)) == brute(first)
    # Late and repeated events after a restart of the stream from its checkpoint.
    stream = put(spark, source, second + first[::3])
    assert rows(states.case_states(stream, "k", "at", path, check, buckets=4)) == brute(first + second)
    version = keyed_table.KeyedTable(spark, f"{path}/cases", "k").manifest()
    # Nothing new: the states tell nothing, and no bucket is rewritten.
    assert rows(states.case_states(put(spark, source, second[:50]), "k", "at", path, check, buckets=4)) == brute(first + second)
    assert keyed_table.KeyedTable(spark, f"{path}/cases", "k").manifest()["parts"] == version["parts"]
    with pytest.raises(Exception, match="another checkpoint"):
        states.case_states(put(spark, source, first[:1]), "k", "at", path, f"{tmp_path}/other", buckets=4)


def test_an_error_keeps_the_stage_and_goes_with_the_next_status(spark, tmp_path):
    source, path, check = f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/c"
    run = lambda *events: rows(states.case_states(put(spark, source, [(*e, 0) for e in events]), "k", "at", path, check, buckets=2))
    assert run(("a", 1, "f1", "processing", None), ("a", 2, "screening", None, None)) == [("a", 2, "screening", 1, "processing", None)]
    assert run(("a", 3, None, "error", "timeout")) == [("a", 2, "screening", 3, "error", "timeout")]
    assert run(("a", 2, None, "done", None)) == [("a", 2, "screening", 3, "error", "timeout")]  # late
    assert run(("a", 4, "f3", "processing", "not an error's")) == [("a", 4, "f3", 4, "processing", None)]


def test_state_goes_by_timer_and_the_table_goes_on(spark, tmp_path):
    source, path, check = f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/c"
    run = lambda *events: rows(states.case_states(put(spark, source, [(*e, 0) for e in events]), "k", "at", path, check, idle=1, buckets=2))
    run(("a", 5, "f2", "error", "e5"), ("b", 5, "f2", None, None))
    run(("b", 6, "f3", None, None))
    held = spark.read.format("statestore").option("stateVarName", "held").load(check)
    assert held.where("key.case_ = 'a'").count() == 0
    assert run(("a", 4, "f1", "done", None), ("a", 7, "f4", None, None)) == [("a", 7, "f4", 5, "error", "e5"), ("b", 6, "f3", None, None, None)]


def test_a_batch_that_fails_before_its_manifest_is_told_again(spark, tmp_path, monkeypatch):
    source, path, check = f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/c"
    events, publish = made(5, 200), keyed_table.KeyedTable._publish
    states.case_states(put(spark, source, events[:50]), "k", "at", path, check, buckets=3)

    def broken(self, manifest, version):
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(keyed_table.KeyedTable, "_publish", broken)
    with pytest.raises(Exception, match="lost before"):
        states.case_states(put(spark, source, events[50:]), "k", "at", path, check, buckets=3)
    monkeypatch.setattr(keyed_table.KeyedTable, "_publish", publish)
    assert rows(states.case_states(spark.readStream.schema(SCHEMA).parquet(source), "k", "at", path, check, buckets=3)) == brute(events)


def test_no_events_and_times_of_day(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k long, at timestamp, stage string, status string, error string").parquet(f"{tmp_path}/in")
    assert states.case_states(stream, "k", "at", f"{tmp_path}/t", f"{tmp_path}/c", buckets=2).count() == 0
    t = datetime.datetime(2024, 2, 29, 23, 59, 59, 999999)
    big = 2**63 - 1
    df = spark.createDataFrame([(big, t, "f1", None, None), (big, t.replace(year=2020), "f0", "error", None)], "k long, at timestamp, stage string, status string, error string")
    df.write.mode("append").parquet(f"{tmp_path}/in")
    got = rows(states.case_states(stream, "k", "at", f"{tmp_path}/t", f"{tmp_path}/c", buckets=2))
    assert got == [(big, t, "f1", t.replace(year=2020), "error", "")]


def test_the_shuffle_gets_a_row_for_each_case_of_a_batch(spark):
    events = spark.range(5000).select((F.col("id") % 3).alias("case_"), F.col("id").alias("stage_at"), F.lit("s").alias("stage"), F.col("id").alias("status_at"), F.lit("error").alias("status"), F.col("id").cast("string").alias("error")).coalesce(1)
    few = events.mapInArrow(states.partial_fold, events.schema)
    assert rows(few) == [(k, n, "s", n, "error", str(n)) for k, n in ((0, 4998), (1, 4999), (2, 4997))]


def _tellings(spark, n, cases, parts):
    """n events of that many cases in an order of no use, over that many partitions."""
    at = F.col("id")
    told = spark.range(n).select((F.hash(at) % cases).alias("case_"), F.when(at % 3 > 0, at).alias("stage_at"), F.when(at % 3 > 0, F.concat(F.lit("s"), at % 7)).alias("stage"), F.when(at % 2 > 0, at).alias("status_at"), F.when(at % 4 == 1, "error").when(at % 2 > 0, "done").alias("status"), F.when(at % 4 == 1, F.concat(F.lit("e"), at)).alias("error"))
    return told.where("stage IS NOT NULL OR status IS NOT NULL").repartition(parts)


def test_a_state_is_handed_one_row_of_a_batch(spark):
    told = _tellings(spark, 60000, 500, 5)
    wanted = states.fold_tables(told, told.limit(0), "case_")
    assert rows(states.told_once(told)) == rows(wanted)


def test_a_task_folds_bounded_bytes_at_a_time(spark, monkeypatch):
    told = _tellings(spark, 6000, 400, 1)
    batches = told.toArrow().to_batches(max_chunksize=50)
    wanted = rows(states.fold_tables(told, told.limit(0), "case_"))
    held, fold = [], states._folded
    monkeypatch.setattr(states, "_folded", lambda t: held.append(t.nbytes) or fold(t))
    for most in (1, 5000, 20000, 1 << 30):
        monkeypatch.setattr(states, "FOLD_BYTES", most)
        held.clear()
        got = [r for b in states.task_fold(iter(batches)) for r in b.to_pylist()]
        assert max(held) <= most + max(b.nbytes for b in batches) or most == 1 << 30
        assert (len(got) == len(wanted)) == (most == 1 << 30)
        again = spark.createDataFrame([tuple(r.values()) for r in got], told.schema)
        assert rows(states.fold_tables(again, again.limit(0), "case_")) == wanted


def test_a_known_case_costs_two_calls_to_its_state():
    calls = []

    class Held:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    state = states._State(None, 5)
    state.held = Held()
    state.handle = type("Handle", (), {"registerTimer": lambda self, at: calls.append(at)})()
    row = lambda at: Row(case_="a", stage_at=at, stage="s", status_at=None, status=None, error=None)
    assert [r.stage_at for r in state.handleInputRows(("a",), iter([row(3)]), Now())] == [3]
    assert calls == ["get", 1005, "update"]
    calls.clear()
    assert list(state.handleInputRows(("a",), iter([row(2)]), Now())) == [] and state.held.value == (3, "s", None, None, None, 1000)
    assert calls == ["get", "update"]
