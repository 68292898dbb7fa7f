"""What is known of each case, from events that tell some of it: keyed state with timers, folded into a table.

An event says that a case reached a stage, or that its work has a status, or both; what it doesn't say stays as it was. A case
whose work failed keeps the stage at which it failed, and the error's text until a later status takes it away. Each field goes by
its own time, so events may come late, in any order and more than once: the fold gives the same from any order and grouping.
That lets it run in four places: within a task before the shuffle, so that a case with very many events sends a row from each
Arrow batch only; within a task after it, so that a case's state is handed a row and not each event; in the case's state, which
tells what an event changed; and in the table, which takes what states tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from casegrid.operators.keyed_table import KeyedTable

from .jobs import BUCKETS, take_batches

FAILED = "error"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # With timers of processing time there always is another batch without data, so a run would never end.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: The fields of a case's state; those after each time go by it.
FIELDS = ("stage_at", "stage", "status_at", "status", "error")
#: How long a case's state is held after the last event, in milliseconds of processing time. The table goes on without it.
IDLE = 24 * 3600 * 1000
#: Bytes of rows that a task holds at most to fold them together.
FOLD_BYTES = 32 << 20


def _folded(rows: pa.Table) -> pa.Table:
    """One row for each case of rows."""
    last = []
    for names in (FIELDS[:2], FIELDS[2:]):
        part = rows.select(["case_", *names]).filter(pc.is_valid(rows[names[1]]))
        part = part.sort_by([(n, "ascending") for n in names])
        # The last of a sorted column, nulls too: an error's text belongs to its status.
        found = part.group_by("case_", use_threads=False).aggregate([(n, "last", pc.ScalarAggregateOptions(skip_nulls=False)) for n in names])
        last.append(found.rename_columns([c.removesuffix("_last") for c in found.column_names]))
    both = last[0].join(last[1], "case_", join_type="full outer", use_threads=False).select(rows.column_names)
    return both.cast(rows.schema)


def partial_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each case of a batch."""
    for batch in batches:
        yield from _folded(pa.Table.from_batches([batch])).to_batches()


def task_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each case of a task; where these outgrow half of FOLD_BYTES, they go on and others of their cases may follow."""
    held, size = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size > FOLD_BYTES:
            held = [_folded(pa.concat_tables(held))]
            size = held[0].nbytes
            # Were most of the bytes kept, they would be folded anew with each batch.
            if size > FOLD_BYTES // 2:
                yield from held[0].to_batches()
                held, size = [], 0
    if held:
        yield from _folded(pa.concat_tables(held)).to_batches()


def told_once(rows: DataFrame) -> DataFrame:
    """A batch's rows (case_, FIELDS), one for each case: each row that a state is handed goes through Python by itself."""
    schema = StructType([StructField(f.name, f.dataType, True) for f in rows.schema])
    return rows.mapInArrow(partial_fold, schema).repartition("case_").mapInArrow(task_fold, schema)


def _later(old: tuple, new: tuple) -> tuple:
    """Of two (time, value, ...) the later one, and of equal times the greater one; a missing value is the least."""
    rank = lambda x: tuple((v is not None, v) for v in x)
    if old[1] is None or new[1] is None:
        return new if old[1] is None else old
    return max(old, new, key=rank)


def merged(old: tuple, new: tuple) -> tuple:
    """Two states of a case as one."""
    return _later(old[:2], new[:2]) + _later(old[2:], new[2:])


class _State(StatefulProcessor):
    def __init__(self, schema: StructType, idle: int) -> None:
        self.schema, self.idle = schema, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        old = self.held.get()  # each call goes to the JVM and back
        now = timerValues.getCurrentProcessingTimeInMs()
        state = old[:5] if old else (None,) * 5
        for r in rows:
            state = merged(state, tuple(r[n] for n in FIELDS))
        if old is None:
            self.handle.registerTimer(now + self.idle)
        self.held.update(state + (now,))
        if old is None or state != old[:5]:
            yield Row(case_=key[0], **dict(zip(FIELDS, state, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.held.get()
        due = (held[5] if held else 0) + self.idle
        if due > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(due)  # events came since the timer was set
        else:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold_tables(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, FIELDS) of both tables, by the same rule as merged()."""
    last = lambda names: F.max(F.when(F.col(names[1]).isNotNull(), F.struct(*names)))
    found = old.unionByName(new).groupBy(key).agg(last(FIELDS[:2]).alias("a_"), last(FIELDS[2:]).alias("b_"))
    return found.select(key, *[F.col(f"{'a_' if n in FIELDS[:2] else 'b_'}.{n}").alias(n) for n in FIELDS])


def case_states(events: DataFrame, case: str, ts: str, path: str, checkpoint: str, stage: str = "stage", status: str = "status", error: str = "error", idle: int = IDLE, buckets: int = BUCKETS) -> DataFrame:
    """(case, stage_at, stage, status_at, status, error): every case that the stream at events has told of so far.

    A batch rewrites the table's buckets of the cases that it changed, once, whatever fails in between; a checkpoint other than
    the table's own is an error. State is held of cases with events in the last idle milliseconds, by timers that are looked at
    with each batch; what comes after is folded into the table just so. Events without a case, a time, or both stage and status tell nothing. Of events at one time
    the greater stage or (status, error) holds. error counts with status FAILED only; a missing one is an empty text then.
    """
    spark = events.sparkSession
    failed = F.when(F.col(status) == FAILED, F.coalesce(F.col(error).cast("string"), F.lit("")))
    told = events.where(F.col(case).isNotNull() & F.col(ts).isNotNull() & (F.col(stage).isNotNull() | F.col(status).isNotNull()))
    rows = told.select(F.col(case).alias("case_"), F.when(F.col(stage).isNotNull(), F.col(ts)).alias("stage_at"), F.col(stage).cast("string").alias("stage"), F.when(F.col(status).isNotNull(), F.col(ts)).alias("status_at"), F.col(status).cast("string").alias("status"), failed.alias("error"))
    few = told_once(rows)
    schema = few.schema
    states = few.groupBy("case_").transformWithState(
        statefulProcessor=_State(StructType([f for f in schema if f.name != "case_"]).add("seen", "long"), idle),
        outputStructType=schema, outputMode="Update", timeMode="ProcessingTime",
    )
    table = KeyedTable(spark, f"{path}/cases", case).create(StructType([StructField(case if f.name == "case_" else f.name, f.dataType, True) for f in schema]), buckets)
    before = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)  # taken by the stream at its start
    try:
        take_batches(states.withColumnRenamed("case_", case), table, lambda old, new: fold_tables(old, new, case), checkpoint, stateful=True)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return table.read()

