"""The package's own code for Python workers that can't import it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def send(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="casegrid-code-"), "casegrid.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)


#: Spark 4.1 says that a union of tables that are parted alike is parted so too, but adaptive execution may merge each
#: table's partitions in another way; an aggregation over the union then gives a key twice.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


def settle(spark: SparkSession) -> None:
    """Make the settings that results depend on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def sending(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        send(spark)
        settle(spark)
        return query(spark, sf_dir)

    return run
