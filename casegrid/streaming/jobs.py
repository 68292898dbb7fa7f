"""Incremental jobs: idempotent arrival of chunks, and the current stage of each case.

Arriving chunks go into a table of key buckets, whose manifest says which query's batch was the last one: a batch that is
replayed after a failure is taken once, and a checkpoint that was lost is an error. The stages' table is a folder of changes:
every batch writes its own, under its number; compact() folds the changes into a new base now and then and removes what
the base before it made useless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid import storage
from casegrid.operators.keyed_table import KeyedTable
from casegrid.operators.lookup import pending_rows

#: Batches since the last base from which a run ends with a compaction.
COMPACT_FROM = 20


def _write(rows: DataFrame, path: str, kind: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/kind={kind}/upto={number}")


def _begin(spark: SparkSession, schema, path: str) -> None:
    """An empty base, so that there is a table before the first batch."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/kind=base/upto=-1")


def changes(spark: SparkSession, path: str) -> DataFrame:
    """The last base and the batches after it, with upto, the number of the batch."""
    rows = spark.read.parquet(path)
    base = rows.where("kind = 'base'").agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]
    return rows.where((F.col("upto") > base) | ((F.col("kind") == "base") & (F.col("upto") == base)))


def current(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The table: of each key the row that is last by order and then by batch."""
    rows = changes(spark, path)
    columns = [c for c in rows.columns if c not in ("kind", "upto")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "upto")).alias("x")).select("x.*")


def compact(spark: SparkSession, path: str, key: str, order: str, least: int = 1) -> bool:
    """Write the table as a new base if there are at least so many batches since the last one."""
    rows = changes(spark, path)
    seen = rows.agg(F.count_distinct(F.when(F.col("kind") == "batch", F.col("upto"))).alias("n"), F.max("upto").alias("last")).first()
    if (seen["n"] or 0) < least:
        return False
    before = rows.where("kind = 'base'").agg(F.max("upto")).first()[0]
    _write(current(spark, path, key, order), path, "base", seen["last"])
    # Readers that began before may still read the base before this one and its batches, but nothing older.
    for kind in ("base", "batch"):
        for name in storage.names(spark, f"{path}/kind={kind}"):
            upto = int(name.removeprefix("upto=")) if name.startswith("upto=") else None
            if upto is not None and before is not None and (upto < before if kind == "base" else upto <= before):
                storage.remove(spark, f"{path}/kind={kind}/{name}")
    return True


#: Buckets of a table of arriving chunks.
BUCKETS = 32


def take_batches(arriving: DataFrame, table: KeyedTable, change: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, stateful: bool = False) -> None:
    """Merge every batch of a stream into a table, each once; a checkpoint other than the table's own is an error."""
    spark = table.spark

    def take(batch: DataFrame, number: int) -> None:
        tags = table.manifest()["tags"]
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if tags.get("query", query) != query:
            raise ValueError(f"the table at {table.path} was written with another checkpoint than {checkpoint}")
        if number > tags.get("batch", -1):
            # A merge reads its batch more than once, but a step of a stateful stream must run once.
            table.merge(storage.materialize(batch, "batch") if stateful else batch, change, {"query": query, "batch": number})
            table.vacuum()

    arriving.writeStream.outputMode("update" if stateful else "append").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(arriving: DataFrame, key: str, order: str, path: str, checkpoint: str, submit: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Take every batch of a stream into the table at path and give the table: of each key the row that is last by order.

    A batch rewrites the buckets of its keys, and its number is published with them, so a crash between both leaves the table
    as it was and the replay takes the batch once. A run that finds nothing new gives the table as it is. A checkpoint other
    than the one that the table was written with is an error. With submit, rows that the index doesn't hold as done are
    handed to it after the batches, those that failed before among them; it gives (key, status) of each, which are written
    beside the table and decide what the next run submits.
    """
    spark = arriving.sparkSession
    table = KeyedTable(spark, f"{path}/rows", key).create(arriving.schema, buckets)
    last = F.max_by(F.struct(*arriving.columns), F.struct(F.col(order), F.col("turn_"))).alias("x")

    def latest(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("turn_", F.lit(0)).unionByName(new.withColumn("turn_", F.lit(1)))
        return both.groupBy(key).agg(last).select("x.*")

    take_batches(arriving, table, latest, checkpoint)
    if submit is not None:
        resubmit(table, f"{path}/index", submit)
    return table.read()


def index_of(spark: SparkSession, path: str, key: str) -> KeyedTable:
    """The table of (key, status), the last status of each key that was submitted, with a mark that counts failed ones."""
    return KeyedTable(spark, path, key, {"failed": F.count_if(F.col("status") == "FAILED")})


def resubmit(table: KeyedTable, index: str, submit: Callable[[DataFrame], DataFrame]) -> None:
    """Submit the rows that the index doesn't hold as done and record what becomes of them."""
    spark, key = table.spark, table.key
    rows = table.read()
    schema = rows.select(key, F.lit("").alias("status")).schema
    held = index_of(spark, index, key).create(schema, table.manifest()["buckets"])
    pending = pending_rows(rows, held.read(), key, "status")
    # What was submitted must not be submitted again because its outcome is read twice.
    told = storage.materialize(submit(pending).select(key, F.col("status").cast("string").alias("status")), "submitted")
    held.upsert(told)
    held.vacuum()


def stages(events: DataFrame, case: str, stage: str, ts: str, path: str, checkpoint: str) -> DataFrame:
    """(case, stage, ts): the last stage of each case; state is one row a case, and every batch writes what it changed."""
    spark = events.sparkSession
    schema = events.select(case, stage, ts).schema
    _begin(spark, schema, path)

    def put(batch: DataFrame, number: int) -> None:
        _write(batch.select(case, stage, ts), path, "batch", number)

    latest = events.groupBy(case).agg(F.max_by(stage, ts).alias(stage), F.max(ts).alias(ts))
    latest.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    compact(spark, path, case, ts, COMPACT_FROM)
    return current(spark, path, case, ts)
