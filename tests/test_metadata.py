"""Filters on typed paths of parsed metadata."""

import json

import pytest
from pyspark.sql import functions as F

from casegrid.functions import scalars
from casegrid.operators import rank

ROWS = [
    {"a": "x", "n": 1, "b": True, "d": {"e": "deep"}},
    {"a": "", "n": 1.0, "b": False},
    {"a": None, "n": 1.5},
    {"a": 1, "n": "1", "b": "true", "d": "flat"},
    {},
    {"A": "x", "n": 2**63, "d.e": "dotted"},
]


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(i, json.dumps(r)) for i, r in enumerate(ROWS)] + [(6, "{not json"), (7, None), (8, "[1]"), (9, '"x"')]
    return spark.createDataFrame(texts, "i int, t string").select("i", scalars.metadata(F.col("t")).alias("m"))


@pytest.mark.parametrize(
    "spec, want",
    [
        (None, range(10)),
        ({"andAll": []}, range(10)),
        ({"equals": ["a", "x"]}, [0]),
        ({"equals": ["a", ""]}, [1]),
        ({"equals": ["a", 1]}, [3]),
        ({"equals": ["n", 1]}, [0, 1]),
        ({"equals": ["n", 1.5]}, [2]),
        ({"equals": ["b", True]}, [0]),
        ({"equals": ["d.e", "deep"]}, [0]),
        ({"notEquals": ["a", "x"]}, [1]),
        ({"distinct": ["a", "x"]}, range(1, 10)),
        ({"distinct": ["b", False]}, [0, *range(2, 10)]),
        ({"in": ["a", ["x", ""]]}, [0, 1]),
        ({"in": ["a", []]}, []),
        ({"andAll": [{"equals": ["n", 1]}, {"distinct": ["a", "x"]}]}, [1]),
    ],
)
def test_filter(rows, spec, want):
    got = rows.where(rank.metadata_filter(spec, F.col("m"))).select("i").collect()
    assert sorted(r["i"] for r in got) == list(want)


def test_attributes(rows):
    got = {r["i"]: r["x"] for r in rows.select("i", scalars.metadata_attributes(F.col("m"), ["a", "d.e", "b"]).alias("x")).collect()}
    assert got[0] == {"a": "x", "d.e": "deep", "b": "true"} and got[1] == {"b": "false"} and got[3] == {"a": "1", "b": "true"}
    assert got[2] == got[4] == got[5] == got[8] == got[9] == {}


def test_a_text_is_parsed_once(spark):
    texts = spark.range(10).select(F.concat(F.lit('{"a": "'), F.col("id").cast("string"), F.lit('"}')).alias("t")).select(scalars.metadata(F.col("t")).alias("m"))
    spec = {"andAll": [{"in": ["a", ["1", "2", "3"]]}, {"distinct": ["a", "2"]}]}
    plan = texts.where(rank.metadata_filter(spec, F.col("m")))
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")  # else the plan's text is shortened
    try:
        condition = plan.select(F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert condition.count("parseJson(") == 1
    assert sorted(plan.select(rank.metadata_value(F.col("m"), "a", "").alias("a")).toPandas()["a"]) == ["1", "3"]
