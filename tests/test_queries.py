"""Every registered query against its SQL on the smallest tables; plans; order of rows."""

import pytest

import oracle
from casegrid import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_prunes_before_its_shuffle(spark):
    text = plan(QUERIES["vector_topk"](spark, SF))
    assert "WindowGroupLimit" in text and "NestedLoop" not in text and "CartesianProduct" not in text and text.count("FlatMapCoGroupsInArrow") == 1


@pytest.mark.parametrize("name", ["append_only_ids", "full_id_assignment", "numeric_code_sort"])
def test_numbering_has_no_single_task(spark, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, SF))


def test_calendar_is_broadcast(spark):
    text = plan(QUERIES["business_day_roll"](spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["deadline_check", "reconcile_deadline", "pack_chunks", "notice_period_rule", "deadline_facts", "split_items", "extract_citations"])
def test_rules_stay_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_scan_reads_only_what_it_needs(spark):
    text = plan(QUERIES["facet_values"](spark, SF))
    assert "ReadSchema: struct<p_type:string>" in text


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "entity", "score", "rank"] and out.count() == 125


def test_both_legs_search_every_vector(spark):
    from casegrid.plans import retrieval

    hits = retrieval._whole_legs(spark, SF).select("query_id", "leg", "id").collect()
    assert {(r["leg"], r["id"] % 3) for r in hits} == {(leg, k) for leg in (0, 1) for k in range(3)}
    both = [{(r["query_id"], r["id"]) for r in hits if r["leg"] == leg} for leg in (0, 1)]
    assert both[0] & both[1] and both[0] != both[1]


def test_entry_fuses_both_whole_legs(spark, con):
    import __spark_entry__

    assert oracle.difference(__spark_entry__.entry(spark), con, SQL["rrf_fuse_whole"]) == ""
