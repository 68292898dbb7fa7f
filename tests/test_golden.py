"""Fixed cases: dates, deadlines, notices, records and layouts of decisions."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from casegrid.functions import scalars as s
from casegrid.operators import calendar as c
from casegrid.operators import corpus as k
from casegrid.operators import rank, rules, segment


def one(spark, column, *values):
    """What a column builder makes of one row of strings."""
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, day",
    [
        ("民國114年7月4日", "2025-07-04"),
        ("中華民國 114 年 7 月 4 日 下午3時", "2025-07-04"),
        ("114.7.4", "2025-07-04"),
        ("2025-07-04 10:20", "2025-07-04"),
        ("2025/7/4", "2025-07-04"),
        ("114年2月30日", None),
        ("未載明", None),
        ("", None),
        (None, None),
    ],
)
def test_minguo_dates(spark, text, day):
    got = one(spark, s.parse_minguo_date, text)
    assert (got and got.isoformat()) == day


@pytest.mark.parametrize("text, key", [("訴願法第 77 條第 8 款", "77(8)"), ("77條第2款", "77(2)"), ("第二款", "77(2)"), ("第十款", "77(10)"), ("無", None), (None, None)])
def test_clauses(spark, text, key):
    assert one(spark, s.clause_key, text) == key


@pytest.mark.parametrize("text, n", [("十", 10), ("三十", 30), ("二十五", 25), ("九", 9), ("百", None), ("", None)])
def test_numerals(spark, text, n):
    assert one(spark, s.cjk_number, text) == n


def test_tokens_and_marks(spark):
    assert one(spark, s.normalize_token, "府訴字 第１２３—４號") == "府訴字第123-4"
    assert one(spark, s.amend_date, "bad") == "未收錄" and one(spark, s.amend_date, "113.1.9") == "民國 113 年 01 月 09 日"
    assert one(spark, lambda x: s.sentence_summary(x, 5), "一。二三四五六") == "一。"
    assert one(spark, lambda x: s.key_problem(x, F.lit(False), ["new"]), "案件-1") is None
    assert one(spark, lambda x: s.key_problem(x, F.lit(False), ["new"]), "a b") == "malformed"


HOLIDAYS = ["2024-02-08", "2024-02-09", "2024-02-12", "2024-02-13", "2024-02-14", "2025-06-11", "2025-06-12", "2025-06-13"]


@pytest.fixture(scope="module")
def days(spark):
    return c.calendar(spark, "2021-01-01", "2027-12-31", spark.createDataFrame([(dt.date.fromisoformat(d),) for d in HOLIDAYS], "day date"))


@pytest.mark.parametrize("service, transit, original, due", [("2025-07-04", 0, "2025-08-03", "2025-08-04"), ("2025-02-24", 3, "2025-03-29", "2025-03-31"), ("2025-05-12", 0, "2025-06-11", "2025-06-16")])
def test_deadlines(spark, days, service, transit, original, due):
    row = spark.createDataFrame([(service, transit)], "s string, t int").withColumn("s", F.to_date("s"))
    start, raw = c.deadline_columns(F.col("s"), F.lit(30), F.col("t"))
    got = c.business_day_roll(row.withColumns({"start": start, "raw": raw}), "raw", days, "due").first()
    assert (got["start"] - got["s"]).days == 1 and got["raw"].isoformat() == original and got["due"].isoformat() == due


@pytest.mark.parametrize("service, due", [("2024-05-28", "2025-05-28"), ("2024-02-28", "2025-02-28"), ("2024-02-27", "2025-02-27")])
def test_one_year(spark, service, due):
    assert one(spark, lambda x: c.one_year_due(F.to_date(x)), service).isoformat() == due


@pytest.mark.parametrize("kind, day", [("", "2021-10-07"), ("abroad", "2021-11-16"), ("repeat", "2021-09-18")])
def test_public_notices(spark, kind, day):
    assert one(spark, lambda x: c.public_notice_date(F.to_date(F.lit("2021-09-17")), x), kind).isoformat() == day


def test_overdue_is_strictly_after_the_last_day(spark, days):
    rows = [("2025-08-04", 0), ("2025-08-05", 0), (None, 0), ("2025-08-05", None)]
    table = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(rows)], "i int, f string, transit_days int")
    table = table.withColumns({"service": F.to_date(F.lit("2025-07-04")), "filed": F.to_date("f"), "basis": F.lit("statutory"), "stated_days": F.lit(30), "corrected": F.lit(None).cast("date"), "caveat": F.lit(""), "transit_note": F.lit("")})
    got = {r["i"]: r for r in c.deadline_check(table, days).collect()}
    assert [got[i]["overdue"] for i in range(4)] == [False, True, None, None]
    assert [got[i]["blocked"] for i in range(4)] == [False, False, True, False]
    assert got[3]["due"] is None and "unknown" in got[3]["note"]


def test_travel_days(spark):
    groups = {"臺中市（一）": ["中區"], "臺中市（二）": ["和平區"], "高雄市（一）": ["鹽埕區"], "高雄市（二）": ["那瑪夏區"]}
    days = {"臺北市": {"臺中市（一）": 4, "臺中市（二）": 5, "高雄市（一）": 5, "高雄市（二）": 6, "宜蘭縣": 4}, "新北市": {"臺中市（一）": 5, "臺中市（二）": 5, "宜蘭縣": 2}}
    matrix = spark.createDataFrame([(a, r, n) for a, row in days.items() for r, n in row.items()], "agency string, residence string, days int")
    cases = [("新北市", "台中市○○區"), ("臺北市", "高雄市○○區"), ("臺北市", "台中市和平區某路"), ("新北市", "宜蘭縣某鎮"), ("新北市", "某處"), ("新北市", "桃園市")]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, agency string, address string")
    got = {r["i"]: r for r in c.transit_days_lookup(rows, "agency", "address", matrix, groups, ["臺中市", "高雄市"], ["宜蘭縣"]).collect()}
    assert [got[i]["transit_days"] for i in range(6)] == [5, None, 5, 2, None, None]
    assert "1" in got[1]["transit_note"] and got[4]["transit_note"] == "" and len(got) == 6


@pytest.mark.parametrize(
    "clause, disposition, record, basis, days",
    [
        ("", "", "", "not_assessed", None),
        ("本處分自即日生效。", "", "", "one_year", None),
        ("不服者得於三十日內提起訴願。", "", "", "statutory", 30),
        ("截斷", "如不服，應於收受後30日之內提起訴願", "", "statutory", 30),
        ("得於60日內提起訴願", "", "", "stated_longer", 60),
        ("得於20日內提起訴願", "", "機關迄未通知更正。", "one_year", 20),
        ("得於二十日內提起訴願", "", "嗣以更正通知書於114年5月2日送達。", "restart", 20),
        ("得於二十日內提起訴願", "", "卷附更正通知。", "undetermined", 20),
        ("得於二十日內提起訴願", "", "別無記載。", "undetermined", 20),
        ("應於十日內改善。得於三十日內提起訴願", "", "", "statutory", 30),
    ],
)
def test_notices(spark, clause, disposition, record, basis, days):
    got = one(spark, rules.notice_period, clause, disposition, record)
    assert (got["basis"], got["days"]) == (basis, days)
    assert (got["corrected"] is not None) == (basis == "restart")


@pytest.mark.parametrize(
    "text, service, filed, transit, problem",
    [
        ("處分書於114年3月5日送達，有送達證書可稽。扣除在途期間4日。收文日期：中華民國114年4月2日", "2025-03-05", "2025-04-02", 4, None),
        ("送達時間（郵局）：114年3月5日。訴願人遲至114年5月1日始提起。無須扣除在途期間。", "2025-03-05", "2025-05-01", 0, None),
        ("其一114年3月5日送達，其二114年3月6日寄存。", None, None, None, "送達日無法認定：抽到 2 個"),
        ("卷內無記載", None, None, None, "送達日無法認定：抽到 0 個"),
        ("公示送達，114年3月5日公告。", "2025-03-25", None, None, None),
        ("公示送達，114年3月5日公告，依行政程序法第79條辦理。", None, None, None, "公示送達之種類無法認定"),
        ("本件於114年2月30日送達，114年3月5日送達。", "2025-03-05", None, None, None),
    ],
)
def test_records(spark, text, service, filed, transit, problem):
    got = one(spark, rules.deadline_facts, text)
    iso = lambda d: d and d.isoformat()
    assert (iso(got["service"]), iso(got["filed"]), got["transit"], got["problem"]) == (service, filed, transit, problem)


BODY = "上列訴願人因某事件，決定如\n下：\n　主　文\n訴願駁回。\n　事　實\n緣訴願人不服。\n　理　由\n一、按法規。二、卷查本件。\n綜上論結，決定如主文。\n訴願審議委員會主任委員 某"


@pytest.mark.parametrize(
    "text, problem, facts",
    [
        (BODY, None, "緣訴願人不服。"),
        ("案由：x\n全文：" + BODY, None, "緣訴願人不服。"),
        (BODY.replace("　事　實\n緣訴願人不服。\n", ""), None, ""),
        (BODY.replace("訴願審議委員會主任委員 某", ""), "no signature", None),
        (BODY.replace("　主　文", ""), "no main text", None),
        (BODY.replace("訴願駁回。", "長" * 300), "main text too long", None),
        (BODY.replace("　理　由\n", ""), None, ""),
        ("沒有標題", "no main text", None),
    ],
)
def test_decisions(spark, text, problem, facts):
    got = one(spark, segment.decision_sections, text)
    assert (got["problem"], got["facts"]) == (problem, facts)
    if problem is None:
        assert got["main"] == "訴願駁回。" and "決定如主文" in got["reasons"]


def test_items_inside_quotes_stay(spark):
    assert one(spark, segment.split_items, "引言。一、甲「規定：。二、乙」。\n三、丙") == ["引言。", "一、甲「規定：。二、乙」。", "三、丙"]
    assert one(spark, segment.split_items, "") == [] and one(spark, segment.split_items, "無項次") == ["無項次"]


def test_appeals(spark):
    got = one(spark, segment.appeal_items, "訴願書\n　事　實　\n一、甲\n續行\n二、乙\n理由\n一、丙\n附送證件\n一、丁")
    assert got["facts"] == ["甲續行", "乙"] and got["reasons"] == ["丙"]
    assert one(spark, segment.appeal_items, "訴願答辯書\n事實\n一、甲\n理由\n一、乙")["facts"] == []
    assert one(spark, segment.appeal_items, "事實\n無項次\n理由\n一、乙")["reasons"] == []


def test_citations(spark):
    rows = spark.createDataFrame([(1, "依廢棄物清理法第27條、同法第50條及訴願法第 79 條之 1，又廢棄物清理法第27條。"), (2, "同法第1條")], "k int, t string")
    got = sorted((r["pos"], r["law"], r["number"]) for r in segment.extract_citations(rows, "k", "t").collect())
    assert got == [(0, "廢棄物清理法", "27"), (1, "廢棄物清理法", "50"), (2, "訴願法", "79-1")]
    listed = spark.createDataFrame([(1, "停車場法 第40條之1；亂碼; 訴願法第77條")], "k int, t string")
    assert [(r["name"], r["number"]) for r in segment.parse_citation_string(listed, "k", "t").orderBy("pos").collect()] == [("停車場法", "40-1"), (None, None), ("訴願法", "77")]


@pytest.mark.parametrize(
    "section, text, last, role",
    [
        ("事實", "任何內容", False, "事實敘述"),
        ("理由", "綜上論結，本件為無理由。", True, "結語"),
        ("理由", "一、按訴願法規定", False, "法規引述"),
        ("理由", "規定於第1條及第2條", False, "法規引述"),
        ("理由", "訴願人主張不知情云云", False, "其他項次"),
        ("理由", "又本府認定", False, "接續段"),
        ("理由", "系爭土地屬實", False, "本案論理"),
        ("理由", "三、其餘部分", False, "其他項次"),
        ("理由", "其餘", False, "本案論理"),
    ],
)
def test_roles(spark, section, text, last, role):
    assert one(spark, lambda a, b: segment.paragraph_role(a, b, F.lit(last)), section, text) == role


def test_statutes(spark):
    law = "法規名稱：某法\n第 一 章 總則\n第 1 條 為管理\n某事。\n一、甲\n第 1-1 條\n本法\n第 二 章 罰則\n第 2 條 罰。"
    got = [tuple(r)[1:] for r in segment.split_articles(spark.createDataFrame([(1, law)], "k int, t string"), "k", "t").orderBy("place").collect()]
    assert got == [(1, "第 一 章 總則", "1", "為管理某事。\n一、甲"), (2, "第 一 章 總則", "1-1", "本法"), (3, "第 二 章 罰則", "2", "罰。")]


def test_packing(spark):
    text = "\n\n".join(["a" * 800, "b" * 699, "c" * 10, "d" * 1600])
    assert [len(x) for x in one(spark, segment.pack_chunks, text)] == [1500, 10, 1600]
    assert one(spark, segment.pack_chunks, " short ") == ["short"] and one(spark, segment.pack_chunks, "") == [""]


def test_fusion_and_reranking(spark):
    ranks = spark.createDataFrame([(1, 0, "B", 1), (1, 0, "A", 2), (1, 1, "A", 1)], "q int, leg int, e string, rank int")
    assert [r["e"] for r in rank.rrf_fuse(ranks, "e", ["q"], k=1).orderBy("rank").collect()] == ["A", "B"]
    cand = spark.createDataFrame([(1, x, i) for i, x in enumerate("abc")], "q int, id string, pos int")
    ext = spark.createDataFrame([(1, "c", 1), (1, "zz", 2), (1, "c", 3), (1, "a", 4)], "q int, id string, ext int")
    got = rank.rerank_merge(cand, ext, ["q"], 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["c", "a", "b"] and got[0]["reranked"]
    none = rank.rerank_merge(cand, ext.where("id = 'zz'"), ["q"], 2).orderBy("rank").collect()
    assert [r["id"] for r in none] == ["a", "b"] and not none[0]["reranked"]


def test_new_ids_follow_the_largest_and_stay(spark):
    have = spark.createDataFrame([("a#1", 10), ("a#2", 12)], "key string, id long")
    come = spark.createDataFrame([("a#2", "a", 2), ("b#2", "b", 2), ("b#10", "b", 10), ("a#3", "a", 3)], "key string, name string, no int")
    first = rank.append_only_ids(have, come, "key", [F.col("name"), F.col("no")])
    assert {r["key"]: r["id"] for r in first.collect()} == {"a#3": 13, "b#2": 14, "b#10": 15}
    again = rank.append_only_ids(have, come.unionByName(spark.createDataFrame([("a#0", "a", 0)], come.schema)), "key", [F.col("name"), F.col("no")], first.cache())
    assert {r["key"]: r["id"] for r in again.collect()} == {"a#3": 13, "b#2": 14, "b#10": 15, "a#0": 16}


def test_scores_and_tally(spark):
    rows = [("correct",), ("correct",), ("wrong",), ("unsure",)]
    got = k.tally(spark.createDataFrame([("x", *r) for r in rows], "layer string, score string"), "layer", "score").where("layer is null").first()
    assert got["wrong_rate"] == 0.25
    assert one(spark, lambda e, a: k.score_field(e, a, F.lit(False)), "x", "未載明") == "unsure"
    assert one(spark, lambda e, a: k.score_field(e, a, F.lit(False)), "x", "y") == "wrong"


def test_upsert_twice_changes_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = k.snapshot_upsert(base, delta, "k")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(once) == [(1, "a"), (2, "c"), (3, "d")] == rows(k.snapshot_upsert(once, delta, "k"))


def test_notes_of_a_district(spark):
    got = one(spark, segment.districts_from_note, "臺中市（一）：中區、東區，西區。臺中市（二）：和平區。")
    assert got == {"臺中市（一）": ["中區", "東區", "西區"], "臺中市（二）": ["和平區"]}


#: The nine rules as Python has them, each with texts that break it and texts that nearly do.
SCREENED = {
    "id_number": (r"(?<![A-Za-z0-9])[A-Z][12]\d{8}(?!\d)", ["證A123456789。", "B298765432"], ["xA123456789", "A1234567890", "A323456789"]),
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ["at a.b+1@mail.example.com,", "..x@y.zz"], ["a@b", "a@b.1", "@b.cc"]),
    "mobile": (r"(?<!\d)09\d{2}[- ]?\d{3}[- ]?\d{3}(?!\d)", ["0912345678", "tel 0912 345-678."], ["10912345678", "09123456789"]),
    "card": (r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)", ["card 4111 1111 1111 1111.", "4111111111111", "1234-5678-9012-3456-789 x"], ["411111111111", "41111111111111111111"]),
    "account": (r"(?:銀行帳號|金融帳號|信用卡號|存摺帳號|付款帳號).{0,24}\d{5,}", ["銀行帳號：第一銀行\r12345", "付款帳號 １２３４５"], ["銀行帳號\n12345", "帳號12345"]),
    "address": (r"(?:戶籍地址|居住地址|通訊地址|住址)\s*[：:]", ["住址　：台北", "通訊地址\n:", "住址\x1c:"], ["住址在台北"]),
    "medical": (r"(?:病歷|診斷證明|身心障礙|精神疾病|罹患|住院|就醫|醫院診療)", ["曾住院三日"], ["醫院"]),
    "identity": (r"(?:身分證字號|國民身分證|統一編號).{0,24}[A-Z0-9]{6,}", ["統一編號：12345678"], ["統一編號：12345", "統一編號\n12345678"]),
    "injected": (r"(?i)(?:<script\b|javascript:|ignore previous instructions|忽略先前指示)", ["<SCRIPT>", "<script", "JavaScript:x", "Ignore previous instructions", "請忽略先前指示"], ["<scripts>", "<script_", "ignore all instructions"]),
}


@pytest.mark.parametrize("name", SCREENED)
def test_each_screening_rule_agrees_with_python(spark, name):
    pattern, hits, misses = SCREENED[name]
    texts = hits + misses
    assert [bool(re.search(pattern, t)) for t in texts] == [True] * len(hits) + [False] * len(misses)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", s.screening_findings(F.col("text")).alias("x")).orderBy("i").collect()
    assert [list(r["x"]) for r in rows] == [[n for n, (p, _, _) in SCREENED.items() if re.search(p, t)] for t in texts]


def test_screen_over_documents_reports_other_rules_too(spark):
    from casegrid import registry

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: list(r["findings"]) for r in registry.queries()["content_safety_screen_all"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r["doc_id"]: [n for n, (p, _, _) in SCREENED.items() if re.search(p, r["text"] or "")] for r in docs}
    assert {n for x in got.values() for n in x} - {"email", "injected"}


@pytest.mark.parametrize(
    "clause, disposition, record, basis, days",
    [
        ("如不服本處分,得於本處分書送達之次日起三十日內,繕具訴願書向本府提起訴願。", "主旨:裁處罰鍰。", "", "statutory", 30),
        ("得於送達次日起30日內提起訴願。", "主旨:裁處罰鍰。", "", "statutory", 30),
        ("", "主旨:裁處罰鍰。", "", "one_year", None),
        ("如不服本處分,得繕具訴願書向本府提起訴願。", "主旨:裁處罰鍰。", "", "one_year", None),
        ("如不服本處分,", "主旨:裁處罰鍰。得於三十日內提起訴願。", "", "statutory", 30),
        ("得於送達次日起六十日內提起訴願。", "主旨:裁處罰鍰。", "", "stated_longer", 60),
        ("得於送達次日起二十日內提起訴願。", "主旨:裁處罰鍰。", "另以更正通知於114年6月10日送達訴願人。", "restart", 20),
        ("得於送達次日起二十日內提起訴願。", "主旨:裁處罰鍰。", "告知之救濟期間有誤,迄未通知更正。", "one_year", 20),
        ("得於送達次日起二十日內提起訴願。", "主旨:裁處罰鍰。", "原處分機關未為更正。", "one_year", 20),
        ("得於送達次日起二十日內提起訴願。", "主旨:裁處罰鍰。", "", "undetermined", 20),
        ("得於送達次日起二十日內提起訴願。", "主旨:裁處罰鍰。", "原處分機關已另發更正通知。", "undetermined", 20),
        ("", "", "", "not_assessed", None),
    ],
)
def test_notice_branches(spark, clause, disposition, record, basis, days):
    got = one(spark, rules.notice_period, clause, disposition, record)
    assert (got["basis"], got["days"]) == (basis, days)


def test_what_a_record_states(spark):
    text = "命於20日補正期間內補正。期間應自送達之翌日114年2月4日起算，至114年3月3日屆滿，以114年3月4日代之，惟訴願人遲至114年5月1日始提起。\n住址：聯絡電話\n　新北市板橋區中山路1號\n"
    got = one(spark, rules.deadline_facts, text)
    iso = lambda d: d and d.isoformat()
    assert (got["period"], iso(got["stated_start"]), iso(got["stated_due"])) == (20, "2025-02-04", "2025-03-04")
    assert got["residence"] == "新北市板橋區中山路1號" or got["residence"] == ""
    bare = one(spark, rules.deadline_facts, "卷內無記載")
    assert (bare["period"], bare["stated_start"], bare["stated_due"], bare["residence"]) == (30, None, None, "")
    fallback = "期間應自114年2月4日起算，至114年3月3日屆滿。退步言之，至遲應自114年4月1日起算。"
    assert iso(one(spark, rules.deadline_facts, fallback)["stated_due"]) == "2025-03-03"


def test_certificate_precedes_the_appeal(spark):
    both = lambda a, b: one(spark, lambda x, y: rules.deadline_facts_by_slot(x, y), a, b)
    own = "收受或知悉行政處分日期：114年3月6日"
    got = both(own, "送達時間：中華民國114年3月5日")
    assert got["service"].isoformat() == "2025-03-05" and got["disputed"].isoformat() == "2025-03-06" and not got["self_reported"]
    assert both(own, "送達時間：中華民國114年3月6日")["disputed"] is None
    for certificate, why in (("", "absent_slot"), (None, "absent_slot"), ("※◎●□◆", "unreadable"), ("本件文書已交付", "missing_field")):
        got = both(own, certificate)
        assert (got["service"].isoformat(), got["fallback"], got["self_reported"]) == ("2025-03-06", why, True)
    assert both("無", "")["problem"].startswith("期間未計算，")
    confirmed = one(spark, lambda x, y: rules.deadline_facts_by_slot(x, y, service=F.lit(dt.date(2025, 3, 1))), own, "送達時間：中華民國114年3月5日")
    assert confirmed["service"].isoformat() == "2025-03-01" and confirmed["disputed"] is None and not confirmed["public_notice"]


TERMS = {"appeal": (["訴願書"], ["訴願人", "請求"]), "service": (["送達證書"], ["受送達人"]), "answer": (["訴願答辯書"], ["答辯"])}
LABELS = {"appeal": "訴願書", "service": "送達證書", "answer": "訴願答辯書"}


@pytest.mark.parametrize(
    "text, slot, matched, note",
    [
        ("訴　願　書\n訴願人", "appeal", True, "符合訴願書的文字特徵"),
        ("送達證書", "appeal", False, "文字特徵更接近送達證書，不是訴願書"),
        ("訴願書 送達證書", "appeal", None, "規則判斷特徵在訴願書、送達證書之間並列，無法確認文件類型"),
        ("", "appeal", None, "規則判斷特徵不足，無法確認文件類型"),
        (None, "service", None, "規則判斷特徵不足，無法確認文件類型"),
    ],
)
def test_document_types(spark, text, slot, matched, note):
    got = one(spark, lambda t, s_: rules.document_type_check(t, s_, TERMS, LABELS), text, slot)
    assert (got["matched"], got["note"]) == (matched, note)


@pytest.mark.parametrize(
    "actual, expected, is_date, score",
    [
        ("新北環稽字第41–112–010273號", "新北環稽字第41-112-010273號", False, "correct"),
        ("新北環稽字第４１-１１２-０１０２７３號", "新北環稽字第41-112-010273號", False, "correct"),
        ("新北環稽字第41-112-010999號", "新北環稽字第41-112-010273號", False, "wrong"),
        ("民國 112 年 1 月 10 日", "112年1月10日", True, "correct"),
        ("112年01月10日", "112年1月10日", True, "correct"),
        ("112年1月11日", "112年1月10日", True, "wrong"),
        ("無法辨識", "112年1月10日", True, "wrong"),
        ("未載明", "x", False, "unsure"),
        ("", "x", False, "unsure"),
        (None, "x", False, "unsure"),
    ],
)
def test_field_scores(spark, actual, expected, is_date, score):
    assert one(spark, lambda a, e: k.score_text(a, e, is_date), actual, expected) == score


def test_category_decision_and_screening_scores(spark):
    of = lambda f, *v: one(spark, f, *v)
    assert of(k.score_category, "廢棄物清理法", "違反廢棄物清理法事件") == "correct"
    assert of(k.score_category, "違反廢棄物清理法第27條之事件紀錄", "違反廢棄物清理法事件") == "wrong"
    assert of(k.score_category, "未分類", "違反廢棄物清理法事件") == "unsure" and of(k.score_category, "事件", "事件") == "wrong"
    assert of(k.score_decision, "部分不受理部分駁回", "不受理") == "wrong" and of(k.score_decision, None, "不受理") == "unsure"
    screening = lambda clause, note: k.score_screening(F.lit(False), clause, note, F.lit(False), F.lit("77(2)"))
    assert of(screening, "77條第二款", "") == "correct" and of(screening, "77條第8款", None) == "wrong" and of(screening, "77條第2款", "x") == "unsure"
    assert of(lambda c: k.score_screening(F.lit(True), c, F.lit(None).cast("string"), F.lit(True), F.lit(None).cast("string")), None) == "correct"


def review(spark, **change):
    given = {
        "slots": "array(named_struct('slot', 'service', 'matched', cast(null as boolean), 'text', ' ', 'note', ''), named_struct('slot', 'appeal', 'matched', true, 'text', 'x', 'note', ''))",
        "deadline": "cast(null as string)",
        "screening": "''",
        "admissible": "true",
        "draft": "named_struct('kind', '駁回', 'main', 'm', 'fact', 'f', 'reason', 'r')",
        "edited": "false",
        "missing": "cast(array() as array<string>)",
        "same": "cast(null as boolean)",
        "stale": "false",
    } | change
    row = spark.range(1).select(*[F.expr(v).alias(n) for n, v in given.items()])
    c = F.col
    return row.select(rules.case_needs_review(c("slots"), ["service"], c("deadline"), c("screening"), c("admissible"), c("draft"), c("edited"), c("missing"), c("same"), c("stale")).alias("x")).first()["x"]


def test_each_reason_for_review(spark):
    draft = lambda kind, main="m", fact="f", reason="r": f"named_struct('kind', '{kind}', 'main', '{main}', 'fact', '{fact}', 'reason', '{reason}')"
    assert not review(spark) and not review(spark, draft="cast(null as struct<kind: string, main: string, fact: string, reason: string>)")
    assert review(spark, slots="array(named_struct('slot', 'service', 'matched', false, 'text', 'x', 'note', ''))")
    assert review(spark, slots="array(named_struct('slot', 'appeal', 'matched', true, 'text', 'x', 'note', 'n'))")
    assert review(spark, deadline="'n'") and review(spark, screening="'n'") and review(spark, stale="true") and review(spark, same="false") and review(spark, missing="array('x')")
    assert review(spark, draft=draft("不受理")) and not review(spark, draft=draft("不受理"), edited="true") and not review(spark, draft=draft("不受理", fact=""), admissible="false")
    assert review(spark, draft=draft("駁回", main="")) and review(spark, draft=draft("駁回", reason=" ")) and review(spark, draft=draft("駁回", fact=""))
    assert review(spark, draft=draft("部分不受理部分駁回")) and review(spark, draft=draft("撤銷另處")) and not review(spark, draft=draft("撤銷另處", main="於2 個月內另為處分"))


def test_results_allowed_on_each_track(spark):
    allowed = lambda passed, kind: one(spark, lambda x: rules.result_allowed(F.lit(passed), x), kind)
    assert allowed(True, "駁回") and not allowed(True, "不受理") and allowed(False, "不受理") and not allowed(False, "和解") and allowed(True, None) is None


def test_json_lines_that_are_missing_or_malformed(spark, tmp_path):
    from casegrid.sources import files

    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\nnot json\n{"k": 4}\n')
    path = str(tmp_path / "a.jsonl")
    assert [tuple(r) for r in files.malformed_lines(spark, path, "k long").collect()] == [("a.jsonl", 4, "not json")]
    loose = files.jsonl_source(spark, path, "k long", strict=False)
    assert sorted((r["k"] or 0, r["corrupt"]) for r in loose.collect()) == [(0, "not json"), (1, None), (2, None), (4, None)]
    with pytest.raises(Exception, match="malformed line in a.jsonl, line 4: not json"):
        files.jsonl_source(spark, path, "k long").collect()
    gone = files.jsonl_source(spark, str(tmp_path / "none.jsonl"), "k long", skip_missing=True)
    assert gone.columns == ["k", "file"] and gone.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.jsonl_source(spark, str(tmp_path / "none.jsonl"), "k long").count()


def test_embedding_agrees_with_plain_python(spark):
    import zlib

    from casegrid.operators import plugins

    texts = ["a b a", "", None, "c " * 70]
    got = plugins.embed_batches(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), "text", batch=2)
    for r in got.collect():
        want = [0.0] * 64
        for w in (texts[r["id"]] or "").split():
            h = zlib.crc32(w.encode())
            want[h % 64] += 1 if h >> 16 & 1 else -1
        norm = sum(x * x for x in want) ** 0.5 or 1
        assert all(abs(x - y / norm) < 1e-6 for x, y in zip(r["embedding"], want))


def test_sections_with_a_repeated_heading(spark):
    rows = spark.createDataFrame([(1, "A.\nx\nB.\ny"), (2, "A.\nx\nA.\ny"), (3, "x")], "k int, t string")
    got = {(r["k"], r["section"]): (r["name"], r["body"]) for r in segment.labelled_sections(rows, "k", "t", r"^([A-Z])\.$", unique=True).collect()}
    assert got == {(1, 1): ("A", "x"), (1, 2): ("B", "y"), (2, 0): (None, "A.\nx\nA.\ny"), (3, 0): (None, "x")}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,day",
    [("民國１１４年３月４日", "2025-03-04"), ("中華民國　１１４　年　3　月　４　日", "2025-03-04"), ("　１１４．７．４".replace("．", "."), "2025-07-04"), ("２０２５/７/４", "2025-07-04"), ("中華114年3月4日", None), ("114年２月３０日", None)],
)
def test_minguo_dates_in_wide_forms(spark, text, day):
    got = value(spark, s.parse_minguo_date(F.lit(text)))
    assert (str(got) if got else None) == day


@pytest.mark.parametrize(
    "clause,disposition,basis,days",
    [
        ("如不服本處分，得於３０日內提起訴願。", "", "statutory", 30),
        ("如不服，得於三十　日內提起訴願。", "", "statutory", 30),
        ("如不服，得於６０　日內提起訴願。", "", "stated_longer", 60),
        ("\n", "　", "not_assessed", None),
        ("\x1f", "", "not_assessed", None),
        ("得於０日內提起訴願。", "得於30日內提起訴願。", "statutory", 30),
    ],
)
def test_notices_in_wide_forms(spark, clause, disposition, basis, days):
    got = value(spark, rules.notice_period(F.lit(clause), F.lit(disposition), F.lit("")))
    assert (got["basis"], got["days"]) == (basis, days)


def test_records_in_wide_forms(spark):
    text = "處分書於１１４　年　3　月　４　日送達。扣除　在途期間　２　日。收文日期：　１１４年４月１日。命於２０　日補正期間內補正。"
    got = value(spark, rules.deadline_facts(F.lit(text)))
    assert (str(got["service"]), str(got["filed"]), got["transit"], got["period"]) == ("2025-03-04", "2025-04-01", 2, 20)
    assert value(spark, F.lit("應於３０　日內另為處分").rlike(rules._REMAND_PERIOD)) and value(spark, F.lit("應於2個月內").rlike(rules._REMAND_PERIOD))


def test_citations_in_wide_forms(spark):
    rows = spark.createDataFrame([(1, "依訴願法第　77　條、民法第１４條之２及同法第\u20033條")], "k int, t string")
    found = [(r["law"], r["number"]) for r in segment.extract_citations(rows, "k", "t").orderBy("pos").collect()]
    assert found == [("訴願法", "77"), ("民法", "１４-２"), ("民法", "3")]
    parsed = segment.parse_citation_string(spark.createDataFrame([(1, "民法　第１４條之２；x；")], "k int, t string"), "k", "t").orderBy("pos").collect()
    assert [(r["name"], r["number"]) for r in parsed] == [("民法", "１４-２"), (None, None)]
    assert value(spark, segment.clause_of(F.lit("訴願法第　77　條第　２　款"))) == "§77(２)"
    assert value(spark, segment.last_date(F.lit("中華民國　１１４　年３月４日"))) == "中華民國　１１４　年３月４日"


@pytest.mark.parametrize("pattern,java", [(r"\d+\s", r"\p{Nd}+[\s\x0b\x1c-\x1f\x85\p{Z}]"), (r"[\d\s]", r"[\p{Nd}\s\x0b\x1c-\x1f\x85\p{Z}]"), (r"\\d[^\n]\S", r"\\d[^\n][^\s\x0b\x1c-\x1f\x85\p{Z}]"), (r"[0-9\]]\d", r"[0-9\]]\p{Nd}")])
def test_patterns_for_any_script(pattern, java):
    from casegrid.functions import patterns

    assert patterns.wide(pattern) == java and patterns.wide(java).count("Nd") == java.count("Nd")


def plain_items(text):
    """Items by looking at every marker in turn."""
    import re

    text, mark = text.strip(), re.compile(r"(?:(?<=\A)|(?<=[。\n」]))\s*[一二三四五六七八九十百]+\s*、")
    places = [m.start() for m in mark.finditer(text) if (text[: m.start()].count("「") - text[: m.start()].count("」")) % 2 == 0]
    edges = [0, *places, len(text)]
    return [p for p in (text[x:y].strip() for x, y in zip(edges, edges[1:])) if p]


def test_items_of_made_texts(spark):
    import random

    rng = random.Random(4)
    parts = ["一、", "二 、", "十二、", "。", "\n", "「", "」", "x", "　", " ", "\x01", "\x01e", "\x01m", "、"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", segment.split_items(F.col("t")).alias("x")).collect():
        assert r["x"] == plain_items(r["t"]), repr(r["t"])
    assert value(spark, segment.split_items(F.lit(None).cast("string"))) is None


def test_items_take_time_by_the_length(spark):
    import time

    def seconds(n):
        begin = time.time()
        assert value(spark, F.size(segment.split_items(F.repeat(F.lit("x。一、「二、」"), F.lit(n))))) == n + 1
        return time.time() - begin

    seconds(1000)
    assert seconds(120_000) < 20  # a megabyte; its square would take hours


def plain_sections(text, unique):
    """Sections line by line: headings are single capital letters with a full stop."""
    lines = text.split("\n")
    names = [x[0] for x in lines if len(x) == 2 and x[0].isupper() and x[1] == "."]
    if not names or (unique and len(set(names)) < len(names)):
        return [(0, None, text.strip())] if text.strip() else []
    out = []
    for x in lines:
        if len(x) == 2 and x[0].isupper() and x[1] == ".":
            out.append([x[0], []])
        elif out:
            out[-1][1].append(x)
    return [(i + 1, n, "\n".join(b).strip()) for i, (n, b) in enumerate(out) if "\n".join(b).strip()]


@pytest.mark.parametrize("unique", [False, True])
def test_sections_of_made_texts_without_a_shuffle(spark, unique):
    import random

    rng = random.Random(5)
    parts = ["A.", "B.", "C.", "A. ", "x", "\n", "\n", "\r", " ", "\x01", "\x01m", "\u2028"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(800)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    out = segment.labelled_sections(df, "i", "t", r"^([A-Z])\.$", unique)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("i", "section").collect():
        got.setdefault(r["i"], []).append((r["section"], r["name"], r["body"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_sections(t, unique), repr(t)
    assert -1 not in got


def test_articles_without_a_shuffle_in_time_by_the_length(spark):
    import time

    df = spark.createDataFrame([(1, None), (2, ""), (3, "所有條文\n第 1 條 a\nb\n１　c\n一、d\n第 一 章 總則\nlost\n第 ２-１ 條\n（一）e\n第 3 條\x01a")], "i int, t string")
    out = segment.split_articles(df, "i", "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in out.orderBy("place").collect()] == [(1, "", "1", "ab\n１　c\n一、d"), (2, "第 一 章 總則", "２-１", "（一）e"), (3, "第 一 章 總則", "3", "\x01a")]
    begin = time.time()
    long = spark.range(1).select(F.col("id").alias("i"), F.repeat(F.lit("第 1 條 a\nb\n"), F.lit(80_000)).alias("t"))
    assert segment.split_articles(long, "i", "t").count() == 80_000 and time.time() - begin < 30


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    from casegrid.sources import files

    for name, n in (("a", 4000), ("b", 10)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"k": {i}}}\n' if i % 3 else "\n" for i in range(n)) + "bad\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        path = str(tmp_path)
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        rows = files.jsonl_source(spark, path, "k long", strict=False, numbered=True).collect()
        assert sorted((r["file"], r["line"], r["k"]) for r in rows if r["corrupt"] is None) == sorted((f"{f}.jsonl", i + 1, i) for f, n in (("a", 4000), ("b", 10)) for i in range(n) if i % 3)
        assert sorted(map(tuple, files.malformed_lines(spark, path, "k long").collect())) == [("a.jsonl", 4001, "bad"), ("b.jsonl", 11, "bad")]
        with pytest.raises(Exception, match="malformed line in a.jsonl, line 4001: bad|malformed line in b.jsonl, line 11: bad"):
            files.jsonl_source(spark, path, "k long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    "clause,record,finding,note",
    [
        ("", "", "", "卷內無原處分書，有無教示救濟期間未經檢核"),
        ("本處分自送達生效。", "", "原處分書未告知救濟期間", "原處分書未告知救濟期間，期間依行政程序法第９８條第３項認定為一年（此分支未經語料驗證），不據以覆寫程序審查，須人工確認"),
        ("得於30日內提起訴願。", "", "原處分書教示救濟期間３０日，與法定期間相符", ""),
        ("得於60日內提起訴願。", "", "原處分書告知之救濟期間６０日較法定３０日為長", None),
        ("得於20日內提起訴願。", "未為更正", "原處分書告知之救濟期間２０日有錯誤，卷內載明未為更正", None),
        ("得於20日內提起訴願。", "更正通知書於114年3月4日送達。", "原處分書告知之救濟期間２０日有錯誤，更正通知於114年3月4日送達", None),
        ("得於20日內提起訴願。", "更正通知在卷。", "原處分書告知之救濟期間２０日有錯誤，卷內載有更正通知", "更正通知之送達日無法認定，行政程序法第９８條第１項之法定期間起算日因而無從認定，須人工調閱更正通知"),
        ("得於20日內提起訴願。", "無記載。", "原處分書告知之救濟期間２０日與法定３０日不符", None),
    ],
)
def test_findings_and_notes_of_notices(spark, clause, record, finding, note):
    got = value(spark, rules.notice_period(F.lit(clause), F.lit(""), F.lit(record)))
    assert got["finding"] == finding and (note is None or got["note"] == note) and (got["note"] == "") == (got["basis"] == "statutory") and "{" not in got["note"]
