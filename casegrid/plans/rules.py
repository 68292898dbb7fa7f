"""Deadlines and decision tables over the docket."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid.operators import calendar as c
from casegrid.operators import rules as r
from casegrid.operators import terms
from casegrid.registry import query

from . import adapters as a
from .adapters import with_

_HOLIDAYS = """cal AS (SELECT day::DATE AS day, isodow(day) <= 5 AND NOT ((month(day) = 1 AND day(day) <= 2) OR (month(day) = 2 AND day(day) = 28) OR (month(day) = 4 AND day(day) IN (4, 5)) OR (month(day) = 10 AND day(day) = 10)) AS open
  FROM (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2004-12-31', INTERVAL 1 DAY)) AS day)), roll AS (SELECT day, min(CASE WHEN open THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_open FROM cal)"""
_FILED = """filings AS (SELECT l_orderkey AS case_id, max(l_shipdate)::DATE AS filed FROM lineitem GROUP BY 1)"""


def generated_calendar(spark):
    """Weekends and the same holidays each year, from 1994 to 2004."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1994-01-01").cast("date"), F.lit("2004-12-31").cast("date"))).alias("day"))
    m, d = F.month("day"), F.dayofmonth("day")
    holidays = days.where(((m == 1) & (d <= 2)) | ((m == 2) & (d == 28)) | ((m == 4) & d.isin(4, 5)) | ((m == 10) & (d == 10)))
    return c.calendar(spark, "1994-01-01", "2004-12-31", holidays)


@query(f"WITH {_HOLIDAYS} SELECT o_orderkey, next_open AS rolled FROM orders LEFT JOIN roll ON o_orderdate::DATE = day")
def business_day_roll(spark, d):
    rows = a.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return c.business_day_roll(rows, "day", generated_calendar(spark), "rolled").select("o_orderkey", "rolled")


@query(f"""WITH {_HOLIDAYS}, {_FILED}, o AS (SELECT o_orderkey AS case_id, o_orderdate::DATE AS service, (o_custkey % 7)::INT AS transit FROM orders),
d AS (SELECT case_id, service + 1 AS start, service + 30 + transit AS original, CASE WHEN month(service + 1) = 2 AND day(service + 1) = 29 THEN ((service + 1) + INTERVAL 1 YEAR)::DATE ELSE ((service + 1) + INTERVAL 1 YEAR)::DATE - 1 END AS year_due,
  service + CASE case_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 1 ELSE 20 END AS notice FROM o)
SELECT d.case_id, start, original, r1.next_open AS due, r2.next_open AS year_due, notice, filed > r1.next_open AS overdue FROM d JOIN roll r1 ON original = r1.day JOIN roll r2 ON year_due = r2.day LEFT JOIN filings f ON f.case_id = d.case_id""")
def deadline_compute(spark, d):
    rows = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("service"), (F.col("o_custkey") % 7).alias("transit"))
    start, original = c.deadline_columns(F.col("service"), F.lit(30), F.col("transit"))
    kind = F.when(F.col("case_id") % 3 == 0, "abroad").when(F.col("case_id") % 3 == 1, "repeat").otherwise("")
    days = generated_calendar(spark)
    rows = rows.withColumns({"start": start, "original": original, "year_raw": c.one_year_due(F.col("service")), "notice": c.public_notice_date(F.col("service"), kind)})
    rows = c.business_day_roll(c.business_day_roll(rows, "original", days, "due"), "year_raw", days, "year_due")
    filings = a.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.to_date(F.max("l_shipdate")).alias("filed"))
    return rows.join(filings, "case_id", "left").select("case_id", "start", "original", "due", "year_due", "notice", (F.col("filed") > F.col("due")).alias("overdue"))


_BASIS = "CASE case_id % 6 WHEN 0 THEN 'statutory' WHEN 1 THEN 'stated_longer' WHEN 2 THEN 'one_year' WHEN 3 THEN 'restart' WHEN 4 THEN 'undetermined' ELSE 'not_assessed' END"


@query(f"""WITH {_HOLIDAYS}, {_FILED}, o AS (SELECT o_orderkey AS case_id, o_orderdate::DATE AS service, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 5)::INT END AS transit, CASE WHEN o_custkey % 11 = 0 THEN 'doubt' ELSE '' END AS caveat FROM orders),
b AS (SELECT *, {_BASIS} AS basis FROM o), x AS (SELECT b.*, CASE WHEN b.case_id % 8 = 7 THEN NULL ELSE filed END AS filed,
  CASE basis WHEN 'undetermined' THEN NULL WHEN 'one_year' THEN CASE WHEN month(service + 1) = 2 AND day(service + 1) = 29 THEN ((service + 1) + INTERVAL 1 YEAR)::DATE ELSE ((service + 1) + INTERVAL 1 YEAR)::DATE - 1 END
    WHEN 'restart' THEN service + 10 + 30 + transit WHEN 'stated_longer' THEN service + 60 + transit ELSE service + 30 + transit END AS raw FROM b LEFT JOIN filings USING (case_id)),
y AS (SELECT x.*, next_open AS due, filed > next_open AS overdue FROM x LEFT JOIN roll ON raw = day),
z AS (SELECT *, CASE WHEN due IS NULL THEN CASE WHEN basis = 'undetermined' THEN 'not computed, basis undetermined' ELSE 'not computed, travel days unknown' END
  ELSE concat_ws(';', CASE WHEN filed IS NULL THEN 'no filing day' END, CASE WHEN basis <> 'statutory' THEN 'basis ' || basis END, CASE WHEN basis = 'stated_longer' AND overdue THEN 'beyond the stated period' END, nullif(caveat, '')) END AS note FROM y)
SELECT case_id, due, overdue, note, due IS NOT NULL AND note <> '' AS blocked FROM z""")
def deadline_check(spark, d):
    filings = a.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.to_date(F.max("l_shipdate")).alias("filed"))
    k = F.col("case_id") % 6
    basis = F.when(k == 0, "statutory").when(k == 1, "stated_longer").when(k == 2, "one_year").when(k == 3, "restart").when(k == 4, "undetermined").otherwise("not_assessed")
    rows = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("service"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 5).alias("transit_days"), F.when(F.col("o_custkey") % 11 == 0, "doubt").otherwise("").alias("caveat"))
    rows = rows.join(filings, "case_id", "left").withColumns({"basis": basis, "stated_days": F.lit(60), "corrected": F.date_add("service", 10), "transit_note": F.lit(""), "filed": F.when(F.col("case_id") % 8 != 7, F.col("filed"))})
    return c.deadline_check(rows, generated_calendar(spark)).select("case_id", "due", "overdue", "note", "blocked")


@query("""WITH m AS (SELECT r_name AS agency, n_name AS residence, (n_nationkey * 7 + r_regionkey) % 31 AS days FROM nation, region),
x AS (SELECT c_custkey, (SELECT r_name FROM region WHERE r_regionkey = c_custkey % 5) AS agency, CASE WHEN c_custkey % 4 = 3 THEN 'nowhere' WHEN c_custkey % 4 = 2 THEN 'a NATION_2x b' ELSE 'at NATION_' || c_nationkey || (CASE WHEN c_nationkey = 1 THEN ' x' WHEN c_nationkey = 2 THEN ' y' ELSE '' END) END AS address, c_nationkey FROM customer),
g AS (SELECT agency, min(days) AS lo, max(days) AS hi FROM m WHERE residence IN ('NATION_1', 'NATION_10', 'NATION_11') GROUP BY agency)
SELECT c_custkey, CASE WHEN address = 'nowhere' OR address LIKE 'a %' THEN NULL WHEN c_nationkey IN (1, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19) THEN NULL WHEN c_nationkey >= 20 OR c_nationkey = 2 THEN NULL ELSE (SELECT days FROM m WHERE m.agency = x.agency AND residence = 'NATION_' || c_nationkey) END AS transit_days FROM x""")
def transit_days_lookup(spark, d):
    """Names that contain another's name name two places, so those addresses are left open."""
    matrix = a.read(spark, d, "nation").join(F.broadcast(a.read(spark, d, "region"))).select(F.col("r_name").alias("agency"), F.col("n_name").alias("residence"), ((F.col("n_nationkey") * 7 + F.col("r_regionkey")) % 31).alias("days"))
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey")
    address = F.when(k == 3, "nowhere").when(k == 2, "a NATION_2x b").otherwise(F.concat(F.lit("at NATION_"), n.cast("string"), F.when(n == 1, " x").when(n == 2, " y").otherwise("")))
    region = a.read(spark, d, "region").select("r_regionkey", F.col("r_name").alias("agency"))
    rows = a.read(spark, d, "customer").withColumn("r_regionkey", (F.col("c_custkey") % 5).cast("int")).join(F.broadcast(region), "r_regionkey").select("c_custkey", "agency", address.alias("address"))
    plain = [f"NATION_{i}" for i in range(25) if i not in (1, 2)]
    return c.transit_days_lookup(rows, "agency", "address", matrix, {}, ["NATION_1", "NATION_2"], [p for p in plain if not p.startswith(("NATION_1", "NATION_2"))]).select("c_custkey", "transit_days")


@query("SELECT min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year, count(DISTINCT year(o_orderdate)) AS years, max(year(o_orderdate)) < 2002 AS stale FROM orders")
def reference_coverage(spark, d):
    return c.reference_coverage(a.read(spark, d, "orders"), "o_orderdate", F.lit("2001-08-01").cast("date"))


def _screenings(spark, d):
    """A screening for each case: passed for three of four, with clauses of all kinds."""
    o = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("p"))
    clause = F.when(F.col("k") % 5 == 0, "不適用").when(F.col("k") % 5 == 1, None).otherwise(F.concat(F.lit("77條第"), (F.col("p") % 8 + 1).cast("string"), F.lit("款")))
    return o.withColumn("s", r.screening(F.col("k") % 4 != 0, clause, F.lit("because"), F.when(F.col("k") % 3 == 0, "seen").otherwise("")))


_SCREEN = "s AS (SELECT o_orderkey AS k, o_custkey % 8 + 1 AS n, o_orderkey % 4 <> 0 AS passed, CASE o_orderkey % 5 WHEN 0 THEN '不適用' WHEN 1 THEN NULL ELSE '77條第' || (o_custkey % 8 + 1) || '款' END AS clause, CASE WHEN o_orderkey % 3 = 0 THEN 'seen' ELSE '' END AS note FROM orders)"


def _flat(df):
    return df.select("k", "s.passed", "s.clause", "s.reasoning", "s.note")


@query(f"""WITH {_SCREEN}, g AS (SELECT k, n, passed AND k % 5 > 1 AS flipped, passed, clause, note FROM s),
h AS (SELECT k, n, passed AND NOT flipped AS passed, clause, CASE WHEN flipped THEN concat_ws('；', nullif(note, ''), 'contradicts clause ' || clause) ELSE note END AS note FROM g)
SELECT k, passed, clause, 'because' AS reasoning, CASE WHEN passed OR (k % 5 > 1 AND n <> 5) THEN note ELSE concat_ws('；', nullif(note, ''), CASE WHEN k % 5 > 1 THEN 'clause ' || n || ' isn''t judged here' ELSE 'clause unreadable' END) END AS note FROM h""")
def screening_guards(spark, d):
    rows = _screenings(spark, d).withColumn("s", r.guard_contradictory(F.col("s")))
    return _flat(rows.withColumn("s", r.guard_unsupported(F.col("s"))))


@query(f"""WITH {_SCREEN}, m AS (SELECT s.*, list_filter([CASE WHEN c_custkey % 6 = 0 THEN 'name' END, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 'agency' END], lambda x: x IS NOT NULL) AS missing, c_custkey AS p FROM orders JOIN s ON o_orderkey = k JOIN customer ON o_custkey = c_custkey),
x AS (SELECT *, array_to_string(missing, '、') AS t, len(missing) = 2 AS hopeless, p % 3 > 0 AS notified, p % 3 = 1 AS corrected, p % 4 > 0 AS late FROM m)
SELECT k, t AS missing, CASE WHEN t <> '' AND (hopeless OR (notified AND NOT corrected AND late)) THEN false ELSE passed END AS passed, CASE WHEN t <> '' AND (hopeless OR (notified AND NOT corrected AND late)) THEN '77條第1款' ELSE clause END AS clause,
  CASE WHEN t = '' THEN note WHEN hopeless THEN concat_ws('；', nullif(note, ''), 'failed by rule 1, to be confirmed') WHEN NOT notified THEN concat_ws('；', nullif(note, ''), 'to be notified: ' || t) WHEN corrected THEN note
    WHEN late THEN concat_ws('；', nullif(note, ''), 'failed by rule 1, to be confirmed') ELSE concat_ws('；', nullif(note, ''), 'notified, not yet due: ' || t) END AS note FROM x""")
def required_fields(spark, d):
    p = F.col("c_custkey")
    items = {"name": [F.when(p % 6 == 0, r.NOT_STATED).otherwise(F.col("c_name"))], "agency": [F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.when(p % 2 == 1, "other").otherwise("")]}
    rows = _screenings(spark, d).join(a.read(spark, d, "customer"), F.col("p") == p).withColumn("missing", r.missing_fields(items))
    s = r.apply_required(F.col("s"), F.col("missing"), F.size("missing") < 2, p % 3 > 0, p % 3 == 1, p % 4 > 0)
    return rows.withColumn("s", s).select("k", F.array_join("missing", "、").alias("missing"), "s.passed", "s.clause", "s.note")


@query(f"""WITH {_SCREEN}, x AS (SELECT s.*, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 5 <> 1 END AS same, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS has FROM orders JOIN s ON o_orderkey = k JOIN customer ON o_custkey = c_custkey)
SELECT k, same, CASE WHEN NOT same AND NOT has THEN false ELSE passed END AS passed, CASE WHEN NOT same AND NOT has THEN '77條第3款' ELSE clause END AS clause,
  CASE WHEN same THEN note ELSE concat_ws('；', nullif(note, ''), CASE WHEN same IS NULL THEN 'standing not checked' WHEN has IS NULL THEN 'standing to be judged' WHEN has THEN 'standing by interest, to be confirmed' ELSE 'failed by rule 3, to be confirmed' END) END AS note FROM x""")
def standing_rule(spark, d):
    p, k = F.col("c_custkey"), F.col("k")
    rows = _screenings(spark, d).join(a.read(spark, d, "customer"), F.col("p") == p)
    rows = rows.withColumn("same", r.standing(F.when(p % 5 == 0, "").when(p % 5 == 1, "another").otherwise(F.col("c_name")), F.col("c_name")))
    has = r.accepted_assessment(k % 3 == 0, F.when(k % 2 == 0, "some law").otherwise("some law#18-1"))
    return rows.withColumn("s", r.apply_standing(F.col("s"), F.col("same"), has)).select("k", "same", "s.passed", "s.clause", "s.note")


@query(f"""WITH {_SCREEN}, x AS (SELECT s.*, CASE k % 7 WHEN 0 THEN NULL ELSE k % 7 < 4 END AS late, k % 11 < 4 AS blocked, k % 5 > 1 AND n = 2 AS claims FROM s)
SELECT k, CASE WHEN late AND NOT blocked THEN false WHEN NOT late AND claims AND NOT blocked THEN true ELSE passed END AS passed, CASE WHEN late AND NOT blocked THEN '77條第2款' WHEN NOT late AND claims AND NOT blocked THEN NULL ELSE clause END AS clause,
  CASE WHEN late AND NOT blocked THEN 'computed before: because' WHEN NOT late AND claims AND NOT blocked THEN 'not overdue; before: because' ELSE 'because' END AS reasoning,
  CASE WHEN late AND blocked THEN concat_ws('；', nullif(note, ''), 'overdue, unconfirmed: check') WHEN NOT late AND claims AND NOT blocked THEN concat_ws('；', nullif(note, ''), 'overdue clause withdrawn') ELSE note END AS note,
  CASE WHEN late AND blocked THEN 'check；not used to override' WHEN NOT late AND claims THEN 'check；differs from the clause' ELSE 'check' END AS check_note FROM x""")
def reconcile_deadline(spark, d):
    k = F.col("k")
    s, note = r.reconcile_deadline(F.col("s"), F.when(k % 7 != 0, k % 7 < 4), k % 11 < 4, F.lit("computed"), F.lit("check"))
    return _screenings(spark, d).select("k", s.alias("s"), note.alias("check_note")).select("k", "s.passed", "s.clause", "s.reasoning", "s.note", "check_note")


@query(f"""WITH {_SCREEN} SELECT k, CASE WHEN passed THEN 'admissible' ELSE 'inadmissible' END AS track, CASE WHEN passed THEN '' WHEN clause = '77條第2款' THEN 'act#77,act#14' WHEN clause = '77條第3款' THEN 'act#77,act#18' ELSE 'act#77' END AS laws FROM s""")
def track_router(spark, d):
    keys = r.inadmissible_keys(F.col("s.clause"), {"77條第2款": ["act#77", "act#14"], "77條第3款": ["act#77", "act#18"]}, ["act#77"])
    passed = F.col("s.passed")
    return _screenings(spark, d).select("k", F.when(passed, "admissible").otherwise("inadmissible").alias("track"), F.when(passed, "").otherwise(F.array_join(keys, ",")).alias("laws"))


@query(f"""WITH {_SCREEN}, x AS (SELECT k, passed, CASE k % 3 WHEN 0 THEN '部分不受理部分駁回' WHEN 1 THEN '駁回' END AS kind FROM s) SELECT k, CASE WHEN passed OR k % 3 = 0 THEN kind ELSE '不受理' END AS kind, CASE WHEN passed OR k % 3 = 0 THEN 'main' ELSE '訴願不受理。' END AS main, CASE WHEN passed OR k % 3 = 0 THEN 'fact' ELSE '' END AS fact FROM x""")
def draft_format_rule(spark, d):
    kind = F.when(F.col("k") % 3 == 0, r.PARTIAL).when(F.col("k") % 3 == 1, "駁回")
    out = r.enforce_format(F.col("s.passed"), kind, F.lit("main"), F.lit("fact"), "訴願不受理。")
    return _screenings(spark, d).select("k", out.alias("f")).select("k", "f.*")


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber || '-' || l_partkey AS label, l_returnflag = 'R' AS ocr, l_linestatus = 'F' AS confirmed FROM lineitem),
g AS (SELECT k, string_agg(label, '、' ORDER BY label) FILTER (ocr AND NOT confirmed) AS o, string_agg(label, '、' ORDER BY label) FILTER (ocr AND confirmed) AS c FROM s GROUP BY k)
SELECT k, k % 9 = 0 OR o IS NOT NULL AS blocked, concat_ws('；', 'n', o || ' read by machine', c || ' confirmed') AS note FROM g""")
def ocr_date_guard(spark, d):
    slot = F.struct(F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("label"), (F.col("l_returnflag") == "R").alias("ocr"), (F.col("l_linestatus") == "F").alias("confirmed"))
    cases = a.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    blocked, note = r.scanned_guard(F.col("slots"), F.col("k") % 9 == 0, F.lit("n"))
    return cases.select("k", blocked.alias("blocked"), note.alias("note"))


_REVIEW = """v AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'collecting' ELSE 'error' END AS status, coalesce(bool_or(l_returnflag = 'R' AND l_linestatus = 'O'), false) AS failed,
  CASE o_orderkey % 4 WHEN 0 THEN '駁回' WHEN 1 THEN '撤銷另處' WHEN 2 THEN '其他' END AS result, o_orderpriority AS category, o_custkey % 13 = 0 AS noted FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def _reviews(spark, d):
    """(k, status, failed, result, category, noted, review)."""
    bad = a.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("bad"))
    o = a.read(spark, d, "orders").withColumnRenamed("o_orderkey", "k").join(bad, "k", "left")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "collecting").otherwise("error")
    result = F.when(F.col("k") % 4 == 0, "駁回").when(F.col("k") % 4 == 1, "撤銷另處").when(F.col("k") % 4 == 2, "其他")
    rows = o.select("k", status.alias("status"), F.coalesce("bad", F.lit(False)).alias("failed"), result.alias("result"), F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 13 == 0).alias("noted"))
    return rows.withColumn("review", r.any_true(F.col("failed"), F.col("noted"), (F.col("result") == "撤銷另處") & (F.col("k") % 8 == 1), F.col("result").isNull() & (F.col("status") == "done")))


@query(f"WITH {_REVIEW} SELECT k, failed OR noted OR coalesce(result = '撤銷另處' AND k % 8 = 1, false) OR (result IS NULL AND status = 'done') AS review FROM v")
def needs_review(spark, d):
    return _reviews(spark, d).select("k", "review")


_CASES = """c AS (SELECT o_orderkey AS k, o_custkey AS p, o_orderstatus = 'F' AS ready FROM orders),
s AS (SELECT l_orderkey AS k, bool_or((l_returnflag <> 'N' AND (l_linenumber > 1 OR l_partkey % 2 = 0)) OR l_partkey % 97 = 0) AS bad FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_CASES}, x AS (SELECT c.k, p, coalesce(bad, false) AS bad, p % 17 = 0 AS noted, p % 19 = 0 AS screened, k % 3 > 0 AS admissible, CASE k % 6 WHEN 0 THEN '駁回' WHEN 1 THEN '不受理' WHEN 2 THEN '撤銷另處' WHEN 3 THEN '部分不受理部分駁回' WHEN 4 THEN '原處分撤銷' END AS kind FROM c LEFT JOIN s USING (k))
SELECT k, bad OR noted OR screened OR coalesce(admissible AND kind = '不受理' AND p % 5 > 0, false) OR (kind IS NOT NULL AND (p % 23 = 0 OR p % 29 = 0)) OR coalesce(kind <> '不受理' AND p % 31 = 0, false)
  OR coalesce(kind = '部分不受理部分駁回', false) OR coalesce(kind = '撤銷另處' AND p % 2 = 0, false) OR p % 37 = 0 OR p % 41 = 0 OR p % 43 = 0 AS review FROM x""")
def needs_review_sources(spark, d):
    """needs_review from its ten sources, each rendered from the case's order, items and party."""
    slot = F.struct(F.when(F.col("l_linenumber") == 1, "service").otherwise("appeal").alias("slot"), (F.col("l_returnflag") == "N").alias("matched"), F.when(F.col("l_partkey") % 2 == 0, "text").otherwise(" ").alias("text"), F.when(F.col("l_partkey") % 97 == 0, "n").otherwise("").alias("note"))
    slots = a.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(slot).alias("slots"))
    rows = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("p")).join(slots, "k", "left")
    k, p = F.col("k"), F.col("p")
    kind = F.get(F.array(*map(F.lit, ["駁回", "不受理", "撤銷另處", r.PARTIAL, "原處分撤銷"])), (k % 6).cast("int"))
    main = F.when(p % 29 == 0, "").when(p % 2 == 0, "main").otherwise("於30日內另為處分")
    draft = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), main.alias("main"), F.when(p % 31 == 0, " ").otherwise("fact").alias("fact"), F.when(p % 23 == 0, "").otherwise("reason").alias("reason")))
    note = lambda n: F.when(p % n == 0, "to be confirmed")
    review = r.case_needs_review(F.coalesce("slots", F.array().cast(slots.schema["slots"].dataType)), ["service"], note(17), note(19), k % 3 > 0, draft, p % 5 == 0, F.when(p % 37 == 0, F.array(F.lit("name"))), p % 41 != 0, p % 43 == 0)
    return rows.select("k", review.alias("review"))


@query(f"""WITH {_SCREEN}, x AS (SELECT k, passed, CASE k % 5 WHEN 0 THEN '部分不受理部分駁回' WHEN 1 THEN '不受理' WHEN 2 THEN '和解' WHEN 3 THEN '駁回' END AS kind FROM s)
SELECT k, kind, CASE WHEN kind IS NULL THEN NULL WHEN kind = '和解' THEN false ELSE NOT (passed AND kind = '不受理') END AS allowed, CASE WHEN passed THEN 4 ELSE 5 END AS choices FROM x""")
def allowed_result_types(spark, d):
    kind = F.get(F.array(*map(F.lit, [r.PARTIAL, r.INADMISSIBLE, "和解", "駁回"])), (F.col("k") % 5).cast("int"))
    passed = F.col("s.passed")
    return _screenings(spark, d).select("k", kind.alias("kind"), r.result_allowed(passed, kind).alias("allowed"), F.size(r.allowed_results(passed)).alias("choices"))


@query(f"""WITH {_REVIEW}, w AS (SELECT *, failed OR noted OR coalesce(result = '撤銷另處' AND k % 8 = 1, false) OR (result IS NULL AND status = 'done') AS review FROM v)
SELECT k, CASE WHEN status = 'error' OR (status = 'collecting' AND failed) THEN '處理失敗' WHEN status = 'done' AND NOT review THEN '已審結' ELSE '審理中' END AS progress, CASE result WHEN '駁回' THEN 'reject' WHEN '撤銷另處' THEN 'pass' WHEN '其他' THEN 'accent' END AS seal FROM w""")
def progress_and_result(spark, d):
    rows = _reviews(spark, d)
    return rows.select("k", r.progress(F.col("status"), F.col("review"), F.col("failed")).alias("progress"), r.result_seal(F.col("result")).alias("seal"))


@query(f"""WITH {_REVIEW} SELECT k, category, failed OR noted OR coalesce(result = '撤銷另處' AND k % 8 = 1, false) OR (result IS NULL AND status = 'done') AS review, result, failed AS documents_failed FROM v""")
def case_list_summary(spark, d):
    return r.case_summary(_reviews(spark, d), "k", "category", "review", "result", "failed")


_TERMS = [("en", "the", True), ("en", "and", False), ("en", "of", False), ("de", "der", True), ("de", "und", False), ("fr", "les", True), ("fr", "une", False), ("es", "que", True), ("es", "los", False)]


def _slot_terms():
    return {slot: ([t for s, t, strong in _TERMS if s == slot and strong], [t for s, t, strong in _TERMS if s == slot and not strong]) for slot in dict.fromkeys(s for s, *_ in _TERMS)}


@query(f"""WITH t(slot, term, strong) AS (VALUES {', '.join(f"('{a_}', '{b}', {c_})" for a_, b, c_ in _TERMS)}), x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS b FROM documents),
s AS (SELECT doc_id, slot, 3 * max((strong AND contains(b, term))::INT) + sum((NOT strong AND contains(b, term))::INT) AS score FROM x, t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, slot DESC) AS n, count(*) OVER (PARTITION BY doc_id, score) AS same FROM s)
SELECT doc_id, score::INT AS score, CASE WHEN score < 3 OR same > 1 THEN 'unknown' ELSE slot END AS slot FROM r WHERE n = 1""")
def document_type_score(spark, d):
    return r.document_type_score(a.read(spark, d, "documents"), "doc_id", F.col("text"), _slot_terms())


@query("""WITH t AS (SELECT DISTINCT role AS slot, lower(substring(text, 1, 4)) AS term, conv_id % 2 = 0 AS strong FROM conversations WHERE length(text) >= 4 AND NOT regexp_matches(substring(text, 1, 4), '\\s')), x AS (SELECT doc_id, regexp_replace(coalesce(lower(text), ''), '\\s+', '', 'g') AS b FROM documents),
s AS (SELECT doc_id, slot, 3 * max(strong::INT) + sum((NOT strong)::INT) AS score FROM x LEFT JOIN t ON contains(b, term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, slot DESC) AS n, count(*) OVER (PARTITION BY doc_id, score) AS same FROM s)
SELECT doc_id, coalesce(score, 0)::INT AS score, CASE WHEN coalesce(score, 0) < 3 OR same > 1 THEN 'unknown' ELSE slot END AS slot FROM r WHERE n = 1""")
def document_type_scores(spark, d):
    """Documents by the beginnings of all conversation turns, of even conversations as strong terms of their role."""
    turns, begin = a.read(spark, d, "conversations"), F.substring("text", 1, 4)
    table = turns.where((F.length("text") >= 4) & ~begin.rlike(r"\s")).select(F.col("role").alias("slot"), F.lower(begin).alias("term"), (F.col("conv_id") % 2 == 0).alias("strong")).distinct()
    return terms.document_type_scores(a.read(spark, d, "documents"), "doc_id", F.lower("text"), table)


@query(f"""WITH t(slot, term, strong) AS (VALUES {', '.join(f"('{a_}', '{b}', {c_})" for a_, b, c_ in _TERMS)}), x AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS b FROM documents),
s AS (SELECT doc_id, lang, slot, 3 * max((strong AND contains(b, term))::INT) + sum((NOT strong AND contains(b, term))::INT) AS score FROM x, t GROUP BY 1, 2, 3),
m AS (SELECT doc_id, lang, max(score) AS best FROM s GROUP BY 1, 2),
w AS (SELECT m.doc_id, m.lang, best, count(*) AS n, any_value(slot) AS slot, string_agg(upper(slot), '、' ORDER BY position(slot IN 'en de fr es')) AS tied FROM m JOIN s ON m.doc_id = s.doc_id AND best = score GROUP BY ALL)
SELECT doc_id, CASE WHEN best >= 3 AND n = 1 THEN slot = lang END AS matched, CASE WHEN best >= 3 AND n = 1 THEN 'rule' ELSE 'none' END AS method,
  CASE WHEN best < 3 THEN '規則判斷特徵不足，無法確認文件類型' WHEN n > 1 THEN '規則判斷特徵在' || tied || '之間並列，無法確認文件類型' WHEN slot = lang THEN '符合' || upper(lang) || '的文字特徵' ELSE '文字特徵更接近' || upper(slot) || '，不是' || upper(lang) END AS note FROM w""")
def document_type_check(spark, d):
    check = r.document_type_check(F.col("text"), F.col("lang"), _slot_terms(), {x: x.upper() for x in ("en", "de", "fr", "es")})
    return a.read(spark, d, "documents").select("doc_id", check.alias("c")).select("doc_id", "c.*")


@query("""WITH p(profile, pos, ks) AS (VALUES ('a', 0, ['the ', 'this', 'zz']), ('b', 1, ['les ', 'une ', 'dans']), ('c', 2, ['tion', 'eaux', 'ing '])),
s AS (SELECT doc_id, profile, pos, len(list_filter(ks, lambda k: contains(text, k))) AS n FROM documents, p), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS i FROM s)
SELECT doc_id, CASE WHEN n >= 2 THEN profile END AS profile FROM r WHERE i = 1""")
def sample_keyword_match(spark, d):
    profiles = [("a", ["the ", "this", "zz"]), ("b", ["les ", "une ", "dans"]), ("c", ["tion", "eaux", "ing "])]
    return r.keyword_match(a.read(spark, d, "documents"), "doc_id", "text", profiles)


@query(with_("citations") + """, x AS (SELECT case_id, string_agg(CASE WHEN law_id % 4 = 0 THEN 'law' || law_id ELSE 'law' || law_id || ' 第 ' || pos || ' 條' END, chr(10) ORDER BY pos) AS related FROM citations GROUP BY 1)
SELECT case_id, related, '上列訴願人因' || o_orderpriority || '事件，不服原處分機關民國' || (year(o_orderdate) - 1911) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' || o_custkey || '所為之處分，提起訴願一案，本府依法決定如下：' AS preamble FROM x JOIN orders ON o_orderkey = case_id""")
def header_defaults(spark, d):
    from casegrid.functions.scalars import format_minguo_date

    law = F.concat(F.lit("law"), F.col("law_id").cast("string"))
    key = F.when(F.col("law_id") % 4 == 0, law).otherwise(F.concat(law, F.lit("#"), F.col("pos").cast("string")))
    keys = a.citations(spark, d).groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", key.alias("key")))), lambda x: x["key"]).alias("keys"))
    o = a.read(spark, d, "orders").withColumnRenamed("o_orderkey", "case_id")
    text = r.opening(format_minguo_date(F.to_date("o_orderdate")), F.col("o_orderpriority"), F.col("o_custkey").cast("string"))
    return keys.join(o, "case_id").select("case_id", r.related_lines(F.col("keys")).alias("related"), text.alias("preamble"))


@query("""WITH x AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'f1' WHEN 'click' THEN 'screening' ELSE 'f2' END AS st, event_type = 'error' AS running, event_id % 3 > 0 AS info, event_id % 5 > 0 AS scr, event_id % 2 = 0 AS passed FROM events),
e AS (SELECT *, CASE WHEN running THEN 'running' WHEN st <> 'f1' AND NOT info THEN 'no case information' WHEN st = 'f2' AND NOT scr THEN 'no screening' END AS error FROM x)
SELECT event_id, error, CASE WHEN error IS NULL THEN CASE st WHEN 'f1' THEN 6 WHEN 'screening' THEN 3 ELSE 1 END END AS resets, CASE WHEN error IS NULL THEN CASE WHEN st = 'f2' AND NOT passed THEN 'f2_refs' ELSE st END END AS stage FROM e""")
def rerun_plan(spark, d):
    k = F.col("event_id")
    start = F.when(F.col("event_type") == "signup", "f1").when(F.col("event_type") == "click", "screening").otherwise("f2")
    status = F.when(F.col("event_type") == "error", "processing").otherwise("done")
    error, resets, stage = r.rerun_plan(start, status, k % 3 > 0, k % 5 > 0, k % 2 == 0)
    return a.read(spark, d, "events").select("event_id", error.alias("error"), F.when(error.isNull(), F.size(resets)).alias("resets"), stage.alias("stage"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_custkey % 6 = 5 THEN 'not_assessed' WHEN o_custkey % 6 = 4 THEN 'one_year' WHEN o_orderkey % 50 = 30 THEN 'statutory' WHEN o_orderkey % 50 > 30 THEN 'stated_longer' WHEN o_custkey % 6 = 3 THEN 'one_year' WHEN o_custkey % 6 = 2 THEN 'restart' ELSE 'undetermined' END AS basis,
  CASE WHEN o_custkey % 6 < 4 THEN o_orderkey % 50 END AS days, CASE WHEN o_custkey % 6 = 2 AND o_orderkey % 50 < 30 THEN o_orderdate::DATE END AS corrected FROM orders""")
def notice_period_rule(spark, d):
    return _notices(spark, d, lambda text: text)


def _notices(spark, d, written):
    from casegrid.functions.scalars import format_minguo_date

    k, p = F.col("o_orderkey"), F.col("o_custkey") % 6
    days = F.concat(F.lit("本件說明如下。如不服本處分，應於收受後"), (k % 50).cast("string"), F.lit("日內提起訴願。"))
    clause = F.when(p == 5, "").when(p == 4, "本處分自送達生效。").otherwise(days)
    record = F.when(p == 3, "機關未為更正，漏未更正。").when(p == 2, F.concat(F.lit("更正通知於"), format_minguo_date(F.to_date("o_orderdate"), "short"), F.lit("送達。"))).otherwise("無記載。")
    texts = a.read(spark, d, "orders").select(k.alias("k"), clause.alias("clause"), record.alias("record"))
    rules = texts.select("k", r.notice_period(written(F.col("clause")), F.lit(""), written(F.col("record"))).alias("rule"))
    return rules.select("k", "rule.basis", F.col("rule.days").cast("long").alias("days"), "rule.corrected")


@query("""SELECT o_orderkey AS k, CASE WHEN o_custkey % 6 = 5 THEN 'not_assessed' WHEN o_custkey % 6 = 4 THEN 'one_year' WHEN o_orderkey % 50 = 30 THEN 'statutory' WHEN o_orderkey % 50 > 30 THEN 'stated_longer' WHEN o_custkey % 6 = 3 THEN 'one_year' WHEN o_custkey % 6 = 2 THEN 'restart' ELSE 'undetermined' END AS basis,
  CASE WHEN o_custkey % 6 < 4 THEN o_orderkey % 50 END AS days, CASE WHEN o_custkey % 6 = 2 AND o_orderkey % 50 < 30 THEN o_orderdate::DATE END AS corrected FROM orders""")
def notice_period_rule_wide(spark, d):
    """The same notices with full-width digits and ideographic spaces; blank ones are of a line feed and such a space."""
    return _notices(spark, d, a.written_wide)


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 30 THEN '原處分書教示救濟期間３０日，與法定期間相符' WHEN o_orderkey % 50 > 30 THEN '原處分書告知之救濟期間' || n || '日較法定３０日為長' ELSE '原處分書告知之救濟期間' || n || '日與法定３０日不符' END AS finding, o_orderkey % 50 = 30 AS settled
FROM (SELECT *, translate((o_orderkey % 50)::VARCHAR, '0123456789', '０１２３４５６７８９') AS n FROM orders WHERE o_orderkey % 50 > 0)""")
def notice_findings(spark, d):
    """What a decision may cite of each order's notice, and whether nothing is left to a reviewer."""
    k = F.col("o_orderkey")
    clause = F.concat(F.lit("如不服本處分，應於收受後"), (k % 50).cast("string"), F.lit("日內提起訴願。"))
    rule = r.notice_period(clause, F.lit(""), F.lit("無記載。"))
    return a.read(spark, d, "orders").where(k % 50 > 0).select(k.alias("k"), rule.alias("rule")).select("k", "rule.finding", (F.col("rule.note") == "").alias("settled"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE + 20 WHEN 2 THEN NULL ELSE o_orderdate::DATE END AS service, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE + 25 END AS filed,
  CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 9 WHEN 3 THEN 0 END AS transit, o_orderkey % 4 = 1 AS public_notice, CASE WHEN o_orderkey % 4 = 2 THEN '送達日無法認定：抽到 2 個' END AS problem FROM orders""")
def deadline_facts(spark, d):
    return _facts(spark, d, lambda text: text)


def _facts(spark, d, written):
    from casegrid.functions.scalars import format_minguo_date as era

    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    on = lambda x: era(x, "short")
    text = (
        F.when(k == 0, F.concat(F.lit("處分書於"), on(day), F.lit("送達。扣除在途期間"), (F.col("o_custkey") % 9).cast("string"), F.lit("日。收文日期："), on(F.date_add(day, 25))))
        .when(k == 1, F.concat(F.lit("本件公示送達，於"), on(day), F.lit("公告。")))
        .when(k == 2, F.concat(F.lit("其一"), on(day), F.lit("送達。其二"), on(F.date_add(day, 1)), F.lit("寄存。")))
        .otherwise(F.concat(F.lit("簽收日期為"), on(day), F.lit("。毋須扣除在途期間。")))
    )
    texts = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text"))
    facts = texts.select("k", r.deadline_facts(written(F.col("text"))).alias("f"))
    return facts.select("k", "f.service", "f.filed", F.col("f.transit").cast("long").alias("transit"), "f.public_notice", "f.problem")


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE + 20 WHEN 2 THEN NULL ELSE o_orderdate::DATE END AS service, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE + 25 END AS filed,
  CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 9 WHEN 3 THEN 0 END AS transit, o_orderkey % 4 = 1 AS public_notice, CASE WHEN o_orderkey % 4 = 2 THEN '送達日無法認定：抽到 2 個' END AS problem FROM orders""")
def deadline_facts_wide(spark, d):
    """The same records with full-width digits and ideographic spaces."""
    return _facts(spark, d, a.written_wide)


@query("""SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN 20 ELSE 30 END AS period, CASE WHEN o_custkey % 4 > 0 THEN o_orderdate::DATE + 1 END AS stated_start,
  CASE o_custkey % 4 WHEN 1 THEN o_orderdate::DATE + 30 WHEN 2 THEN o_orderdate::DATE + 31 END AS stated_due, CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'N' || o_custkey || '市甲區乙路1號' ELSE '丁縣丙鄉' || o_custkey || '村' END AS residence FROM orders""")
def deadline_statement(spark, d):
    """What a record itself states: the correction's period, its own start and end of the period, and the residence."""
    from casegrid.functions.scalars import format_minguo_date as era

    day, p = F.to_date("o_orderdate"), F.col("o_custkey")
    on = lambda n: era(F.date_add(day, n), "short")
    start = F.concat(F.lit("期間應自送達之翌日"), on(1), F.lit("起算，"))
    statement = F.when(p % 4 == 1, F.concat(start, F.lit("至"), on(30), F.lit("屆滿，惟訴願人遲至"), on(99), F.lit("提起。"))).when(p % 4 == 2, F.concat(start, F.lit("至"), on(30), F.lit("屆滿，以"), on(31), F.lit("代之。"))).when(p % 4 == 3, F.concat(start, F.lit("惟訴願人遲至"), on(99), F.lit("提起。"))).otherwise("無記載。")
    home = F.when(p % 5 == 0, "住址：聯絡電話").when(p % 5 == 1, F.concat(F.lit("住址：聯絡電話\n住居所：N"), p.cast("string"), F.lit("市甲區乙路1號"))).otherwise(F.concat(F.lit("（地址：丁縣丙鄉"), p.cast("string"), F.lit("村）")))
    text = F.concat(F.when(p % 3 == 0, "命於20日補正期間內補正。").otherwise(""), statement, F.lit("\n"), home, F.lit("\n"))
    facts = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), r.deadline_facts(text).alias("f"))
    return facts.select("k", "f.period", "f.stated_start", "f.stated_due", "f.residence")


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey % 6 AS c, o_orderkey % 3 AS a, o_orderdate::DATE AS day FROM orders)
SELECT k, CASE WHEN c = 5 THEN day + 7 WHEN c < 2 THEN day WHEN a > 0 THEN day + (a - 1)::INT END AS service, coalesce(c BETWEEN 2 AND 4 AND a > 0, false) AS self_reported,
  CASE WHEN c BETWEEN 2 AND 4 AND a > 0 THEN CASE c WHEN 2 THEN 'missing_field' WHEN 3 THEN 'absent_slot' ELSE 'unreadable' END END AS fallback, CASE WHEN c < 2 AND a = 2 THEN day + 1 END AS disputed,
  CASE WHEN c BETWEEN 2 AND 4 AND a = 0 THEN '期間未計算，送達日無法認定：抽到 0 個' END AS problem FROM x""")
def deadline_facts_by_slot(spark, d):
    """Certificate and appeal apart: the certificate's day, or why the appellant's own is taken, or what they dispute."""
    from casegrid.functions.scalars import format_minguo_date as era

    day, c, own = F.to_date("o_orderdate"), F.col("o_custkey") % 6, F.col("o_orderkey") % 3
    certificate = F.when(c < 2, F.concat(F.lit("送達時間："), era(day, "short"), F.lit("上午。"))).when(c == 2, "本件文書已交付").when(c == 3, F.lit(" ")).when(c == 4, "※◎●□◆").otherwise("簽收日期為")
    appeal = F.when(own > 0, F.concat(F.lit("收受或知悉行政處分日期："), era(F.date_add(day, own.cast("int") - 1), "short"))).otherwise("訴願人不服。")
    f = r.deadline_facts_by_slot(appeal, certificate, service=F.when(c == 5, F.date_add(day, 7)))
    return a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), f.alias("f")).select("k", *[f"f.{x}" for x in ("service", "self_reported", "fallback", "disputed", "problem")])
