"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only: elsewhere no
    folder of one machine can be read by all."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="casegrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back, so that later steps don't depend on its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task is to sort at most, where keys are many.
PART_ROWS = 1 << 20


def parted(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """rows dealt by keys, of which there are count rows: by as many parts as keep a task's rows to PART_ROWS or so. Where the
    session's own number of parts does, it's left to Spark."""
    parts = -(-count // PART_ROWS)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def numbered(rows: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """rows with name, their place in the order from start. Rows are dealt by ranges of the order, each range counts its own,
    and the ranges' sums are added up: no task sees more than a range."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # A partition's number is in the high bits of these ids, and the row's in it in the low ones.
    placed = materialize(dealt.withColumn("at_", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("at_", 33)
    held = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("n_")).orderBy("part_").collect()
    before, offsets = start, []
    for r in held:  # one row for each range
        offsets.append((r["part_"], before))
        before += r["n_"]
    if not offsets:
        return placed.select(*rows.columns, F.lit(None).cast("long").alias(name))
    starts = rows.sparkSession.createDataFrame(offsets, "part_ long, before_ long")
    out = placed.withColumn("part_", part).join(F.broadcast(starts), "part_")
    return out.select(*rows.columns, (F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1)).alias(name))


def _place(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop client, which reaches whatever Spark does."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where it is missing."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, through the driver."""
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that readers see whole or not at all. An error if there is one of that name."""
    fs, place = _place(spark, path)
    _, own = _place(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(own, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(place) or not fs.rename(own, place):
        fs.delete(own, False)
        raise ValueError(f"{path} was written meanwhile")


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)
