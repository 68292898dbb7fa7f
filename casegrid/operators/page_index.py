"""Pages of a long ordered list from an index of its ranges.

The list is dealt by ranges of its order once, a folder for each, and the rows of each are counted. A page is then a matter of
the counts and of the one or two ranges that hold it; nothing else is read or ordered, however far back it is.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casegrid import storage


class PageIndex:
    """The index at a path. order: columns that decide the order whole, so that every row has one place."""

    def __init__(self, spark: SparkSession, path: str, order: list[Column]) -> None:
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def build(self, rows: DataFrame, ranges: int | None = None) -> PageIndex:
        """Write rows by ranges and their counts; the counts come last, so that a build that failed is no index. An index isn't
        changed: a list that has changed gets a new one at a new path."""
        dealt = rows.repartitionByRange(*([ranges] if ranges else []), *self.order)
        dealt.withColumn("range_", F.spark_partition_id()).write.partitionBy("range_").parquet(f"{self.path}/rows")
        held = self.spark.read.parquet(f"{self.path}/rows").groupBy("range_").count().collect() if self._ranges() else []  # one row for each range
        told = {"schema": rows.schema.jsonValue(), "counts": sorted((r["range_"], r["count"]) for r in held)}
        storage.write_whole(self.spark, f"{self.path}/counts.json", json.dumps(told))
        return self

    def _ranges(self) -> list[str]:
        return [n for n in storage.names(self.spark, f"{self.path}/rows") if n.startswith("range_=")]

    def page(self, number: int, size: int = 20) -> DataFrame:
        """Rows of a page, numbered from 1, with position, their place in the list, and page; a page beyond the last is the
        last. Only the ranges that hold the page are read and put in order."""
        told = json.loads(storage.read_text(self.spark, f"{self.path}/counts.json"))
        total = sum(n for _, n in told["counts"])
        page = min(max(number, 1), max(1, -(-total // size)))
        first, last, before, start, some = (page - 1) * size, page * size, 0, 0, []
        for r, n in told["counts"]:
            if before < last and before + n > first:
                start = start if some else before
                some.append(f"{self.path}/rows/range_={r}")
            before += n
        schema = StructType.fromJson(told["schema"])
        rows = self.spark.read.schema(schema).parquet(*some) if some else self.spark.createDataFrame([], schema)
        head = rows.orderBy(*self.order).limit(last - start)
        numbered = head.withColumn("position", (F.row_number().over(Window.orderBy(*self.order)) + F.lit(start)).cast("int"))
        return numbered.where(F.col("position") > first).withColumn("page", F.lit(page))
