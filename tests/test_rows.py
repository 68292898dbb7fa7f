"""What columns cost a row: an input that is worked out once, however many fields come of it."""

import re

import pytest
from pyspark.sql import functions as F

from casegrid.functions import scalars
from casegrid.operators import corpus, plugins, rules, segment, terms


def uses(df, mark="9731"):
    """How often an expression that is told by a number is worked out in a plan."""
    return len(re.findall(rf"\b{mark}\b", df._jdf.queryExecution().optimizedPlan().toString()))



def fields(df, c):
    return df.select(c.alias("x")).select("x.*")


@pytest.mark.parametrize("name", ["deadline_facts", "notice_period", "deadline_facts_by_slot"])
def test_a_record_is_worked_out_once(spark, name):
    c = F.concat(F.lit("於民國114年3月5日送達。"), (F.col("id") + 9731).cast("string"))
    made = {"deadline_facts": lambda: rules.deadline_facts(c), "notice_period": lambda: rules.notice_period(c, F.lit(""), F.lit("")), "deadline_facts_by_slot": lambda: rules.deadline_facts_by_slot(c, F.lit("x"))}
    assert uses(fields(spark.range(3), made[name]())) == 1


def marked():
    return F.concat(F.lit("上列訴願人決定如下：主文 "), (F.col("id") + 9731).cast("string"))


def test_a_decision_is_worked_out_once(spark):
    assert uses(fields(spark.range(3), segment.decision_sections(marked()))) == 1


def test_header_fields_are_found_once_by_constant_patterns(spark):
    fields_ = segment.header_fields(marked(), {"a": r"a:\s*", "b": r"b:\s*", "c": r"c:\s*"})
    df = spark.range(3).select(fields_.alias("f"))
    assert uses(df) == 1
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 3
    got = segment.header_fields(F.lit("x a: 1 c:3 b: 2"), {"a": r"a:\s*", "b": r"b:\s*", "c": r"c:\s*"})
    assert spark.range(1).select(got).first()[0] == {"a": "1 c:3", "b": "2"}


def test_scores_read_dates_and_clauses_once(spark):
    day = lambda c: scalars.format_minguo_date(scalars.parse_minguo_date(c))
    for c in (scalars.clause_key(marked()), scalars.parse_minguo_date(marked())):
        assert uses(spark.range(3).select(c.alias("x"))) == 1
    df = spark.createDataFrame([("民國114年3月5日",), ("２０２５/3/5",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(day(F.col("t"))).collect()] == ["民國114年3月5日"] * 2 + [None] * 3
    assert [r[0] for r in df.select(corpus.score_text(F.col("t"), F.lit("114年3月5日"), True)).collect()] == ["correct", "correct", "wrong", "unsure", "unsure"]


def test_strip_takes_the_spaces_of_any_script(spark):
    from casegrid.functions.patterns import strip, wide

    texts = [f"{c}a{c}b{c}\n{c}" for c in "\t\x0b\x1c\x85\xa0\u1680\u2003\u2028\u3000"] + ["", "　", "\u200ba\u200b", "\x00a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(strip(F.col("t")), F.regexp_replace("t", wide(r"^\s+|\s+$"), "")).collect()
    assert all(a == b for a, b in got)


def largest(make):
    """The rows of the largest batch that a Python step hands on, of those that it gets as one."""
    import pyarrow as pa

    class Rows:
        columns, schema = ["k", "t"], []

        def mapInArrow(self, run, schema):
            return max(b.num_rows for b in run([pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["a b"] * 5000)], names=["k", "t"])]))

    return make(Rows())


def test_embeddings_go_on_batch_by_batch():
    assert largest(lambda rows: plugins.embed_batches(rows, "t", batch=32)) == 32


def test_terms_go_on_a_few_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    df, seen = spark.createDataFrame([(1, "ab")], "k int, t string"), []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, *more: (seen.append(run), plain(self, run, *more))[1])
    terms.with_terms(df, "t", spark.createDataFrame([("a",)], "x string"), "x")
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["ab"] * 5000), pa.array([[]] * 5000, pa.list_(pa.string()))], names=["k", "t", "terms"])
    out = list(seen[0]([batch]))
    assert sum(b.num_rows for b in out) == 5000 and max(b.num_rows for b in out) <= terms.ROWS


def test_citations_are_dealt_by_parts_of_bounded_size(spark, monkeypatch):
    from casegrid import storage
    from casegrid.plans import retrieval

    d = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, retrieval.candidate_frequency(spark, d).collect()))
    monkeypatch.setattr(storage, "PART_ROWS", 200)
    df = retrieval.candidate_frequency(spark, d)
    parts = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 200)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert set(re.findall(rf"hashpartitioning\((\w+)#\d+L?, {parts}\), REPARTITION_BY_NUM", plan)) == {"l_orderkey", "party"}
    assert sorted(map(tuple, df.collect())) == plain
