"""Terms of a table, against the expressions over lists and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from casegrid.operators import rules, terms


def test_ten_thousand_terms_equal_a_plain_search(spark, monkeypatch):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab訴c é") for _ in range(n))
    wanted = sorted({word(r.randint(1, 7)) for _ in range(10_000)})
    texts = [(i, word(r.randint(0, 60)), "more") for i in range(300)] + [(300, None, None), (301, "", "x"), (301, "ab", "x"), (302, word(50_000), "x")]
    df = spark.createDataFrame(texts, "k int, t string, term string")
    table = spark.createDataFrame([(w,) for w in wanted] + [(None,), ("",), (wanted[0],)], "term string")
    want = sorted((k, t or "", [w for w in wanted if w in (t or "")]) for k, t, _ in texts)
    got = lambda: sorted((x["k"], x["t"] or "", x["terms"]) for x in terms.with_terms(df, "t", table, "term").collect())
    assert got() == want
    monkeypatch.setattr(terms, "PART_CHARS", 15_000)  # several parts
    assert got() == want
    assert "Exchange" not in terms.with_terms(df, "t", table.limit(0), "term")._jdf.queryExecution().executedPlan().toString()
    assert all(x["terms"] == [] for x in terms.with_terms(df, "t", table.where("false"), "term").collect())
    with pytest.raises(ValueError):
        terms.with_terms(df, "t", table, "term", "k")


def test_slots_by_a_table_equal_the_expression(spark):
    lists = {"a": (["訴願書", "xy"], ["p", "q"]), "b": (["處分書"], ["p", "r", "p"]), "c": ([], ["p", "q", "r", "s"])}
    texts = ["訴 願　書 p", "處分書 訴願書", "p q r s", "p", "", None, "xy p q 處分書 r", "訴願", "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    table = spark.createDataFrame([(s, t, n == 0) for s, both in lists.items() for n, ts in enumerate(both) for t in ts], "slot string, term string, strong boolean")
    want = sorted(map(tuple, rules.document_type_score(docs, "k", F.col("t"), lists).collect()))
    assert sorted(map(tuple, terms.document_type_scores(docs, "k", F.col("t"), table).collect())) == want
