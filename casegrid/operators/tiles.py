"""Two tables whose rows must all meet, in tiles of bounded size.

One side is dealt to the rows of a grid and copied to its columns, the other is dealt to the columns and copied to the rows. A
task gets one tile: so much of either side, whatever the sides' sizes. What is sent is each side times the number of parts of
the other, which is the least that tiles of this size allow.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Numbers (components of vectors) that either side of a tile holds, and the least that it pays to deal out further.
TILE_CELLS, LEAST_CELLS = 1 << 22, 1 << 16


def shape(held: int, asked: int, cores: int) -> tuple[int, int]:
    """(rows, columns) of the grid for sides of so many numbers. Small tables are dealt out to all cores."""
    columns = max(1, -(-asked // TILE_CELLS))
    rows = max(1, -(-held // TILE_CELLS), min(-(-held // LEAST_CELLS), -(-2 * cores // columns)))
    return rows, columns


def cells(rows: DataFrame, size: Column) -> int:
    """How many numbers a table has, given the number of each row; it sizes tiles only."""
    return int(rows.agg(F.sum(F.greatest(F.coalesce(size, F.lit(0)), F.lit(1))).alias("n")).first()["n"] or 0)


def met(held: DataFrame, asked: DataFrame, grid: tuple[int, int], deal: tuple[list[str], list[str]], keys: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(part of held, part of asked) of every tile, for each value of the key columns apart.

    deal: the columns by whose hash the rows of either side are dealt out. work gets the columns as they are, and the tile's
    number in tile_; it isn't called where a side has no rows.
    """
    rows, columns = grid
    place = lambda names, n: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.withColumn("row_", place(deal[0], rows)).withColumn("column_", each(columns))
    right = asked.withColumn("column_", place(deal[1], columns)).withColumn("row_", each(rows))
    # The number of partitions is given, as adaptive execution would put small tiles, each much work, into one task.
    dealt = [side.withColumn("tile_", F.col("row_") * columns + F.col("column_")).drop("row_", "column_").repartition(rows * columns, "tile_", *keys) for side in (left, right)]

    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    run = lambda a, b: work(a, b) if a.num_rows and b.num_rows else nothing
    by = ["tile_", *keys]
    return dealt[0].groupBy(*by).cogroup(dealt[1].groupBy(*by)).applyInArrow(run, schema)
