"""Edit distances of texts of any length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Rows of the distance table that are worked on as the bits of one integer, and characters up to which the JVM's own function,
#: which takes time by the product of the lengths, is as good.
BLOCK, SHORT = 8192, 256


def edit_distance(a: str, b: str) -> int:
    """Least insertions, deletions and replacements between two texts, with memory by their lengths.

    Bit-parallel: a column's differences between neighbouring rows are two sets of bits, and a column follows from the one
    before by a few operations on whole integers. Rows are taken in blocks; a block hands the differences along its last row
    to the next one."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = sorted((a[start : len(a) - end], b[start : len(b) - end]), key=len)
    across = [1] * len(b)
    for begin in range(0, len(a), BLOCK):
        block = a[begin : begin + BLOCK]
        bits = (1 << len(block)) - 1
        last = 1 << (len(block) - 1)
        where: dict[str, int] = {}
        for i, c in enumerate(block):
            where[c] = where.get(c, 0) | 1 << i
        up, down = bits, 0  # rows that are one more, and one less, than the row before
        for j, c in enumerate(b):
            equal, given = where.get(c, 0), across[j]
            vertical = equal | down
            if given < 0:
                equal |= 1
            level = (((equal & up) + up) ^ up) | equal
            more, less = (down | ~(level | up)) & bits, up & level & bits
            across[j] = 1 if more & last else -1 if less & last else 0
            more, less = more << 1, less << 1
            if given < 0:
                less |= 1
            elif given > 0:
                more |= 1
            up, down = (less | ~(vertical | more)) & bits, more & vertical & bits
    return len(a) + sum(across)


@F.pandas_udf(IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edits(a: Column, b: Column) -> Column:
    """The edit distance of two texts, null if either is: in the JVM where both are short, else in Arrow batches."""
    short = (F.length(a) <= SHORT) & (F.length(b) <= SHORT)
    return F.when(short, F.levenshtein(a, b)).otherwise(_edits(F.when(~short, a), F.when(~short, b)))
