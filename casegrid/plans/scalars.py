"""Scalar functions over whole tables: every query renders its input from a table and applies one function."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid.functions import scalars as s
from casegrid.operators import corpus
from casegrid.registry import query

from . import adapters as a


def _orders(spark, d):
    return a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), "o_custkey", "o_orderstatus", "o_orderpriority")


_DAY = "WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day, year(o_orderdate) - 1911 AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, o_custkey, o_orderstatus, o_orderpriority FROM orders) "


@query(_DAY + "SELECT k, CASE WHEN k % 5 = 4 THEN NULL ELSE day END AS parsed FROM o")
def parse_minguo_date(spark, d):
    return _era_dates(spark, d, lambda text: text)


def _era_dates(spark, d, written):
    o, day = _orders(spark, d), F.col("day")
    y = (F.year(day) - 1911).cast("string")
    text = (
        F.when(F.col("k") % 5 == 0, s.format_minguo_date(day))
        .when(F.col("k") % 5 == 1, F.concat(F.lit(" "), F.date_format(day, "yyyy/M/d"), F.lit(" 10:20")))
        .when(F.col("k") % 5 == 2, F.concat_ws(".", y, F.month(day).cast("string"), F.dayofmonth(day).cast("string")))
        .when(F.col("k") % 5 == 3, s.format_minguo_date(day, "short"))
        .otherwise(F.concat(y, F.lit("年2月30日")))
    )
    return o.select("k", s.parse_minguo_date(written(text)).alias("parsed"))


@query(_DAY + "SELECT k, CASE WHEN k % 5 = 4 THEN NULL ELSE day END AS parsed FROM o")
def parse_minguo_date_wide(spark, d):
    """The same dates with full-width digits and ideographic spaces."""
    return _era_dates(spark, d, a.written_wide)


@query(_DAY + """SELECT k, '民國' || y || '年' || m || '月' || dd || '日' AS long, y || '年' || m || '月' || dd || '日' AS short,
  CASE WHEN k % 3 = 0 THEN '未收錄' ELSE '民國 ' || y || ' 年 ' || lpad(m::VARCHAR, 2, '0') || ' 月 ' || lpad(dd::VARCHAR, 2, '0') || ' 日' END AS amended FROM o""")
def format_minguo_date(spark, d):
    o, day = _orders(spark, d), F.col("day")
    raw = F.when(F.col("k") % 3 == 0, F.lit("not a date")).otherwise(day.cast("string"))
    return o.select("k", s.format_minguo_date(day).alias("long"), s.format_minguo_date(day, "short").alias("short"), s.amend_date(raw).alias("amended"))


@query("SELECT l_orderkey, l_linenumber, translate(l_partkey::VARCHAR, '0123456789', '０１２３４５６７８９') AS wide FROM lineitem")
def fullwidth_digits(spark, d):
    return a.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.fullwidth_digits(F.col("l_partkey")).alias("wide"))


@query("SELECT p_partkey, p_size AS n, CASE WHEN p_size <= 19 THEN p_size END AS small FROM part")
def cjk_number(spark, d):
    numeral = s.to_cjk_number(F.col("p_size"))
    return a.read(spark, d, "part").select("p_partkey", s.cjk_number(numeral).alias("n"), s.cjk_number(numeral, 19).alias("small"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '81(' || (o_custkey % 9 + 1) || ')' WHEN 3 THEN NULL ELSE '77(' || (o_custkey % 9 + 1) || ')' END AS key,
  CASE WHEN o_orderkey % 4 = 2 THEN '77(' || (o_custkey % 9 + 1) || ')' ELSE '' END AS section FROM orders""")
def parse_clause(spark, d):
    n, k = (F.col("o_custkey") % 9 + 1), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("訴願法第81條第"), n.cast("string"), F.lit("款"))).when(k == 1, F.concat(F.lit("第"), s.to_cjk_number(n), F.lit("款"))).when(k == 2, F.concat(F.lit("77條第 "), n.cast("string"), F.lit(" 款"))).otherwise("不適用")
    section = F.when(k == 2, F.concat(F.lit("§77("), n.cast("string"), F.lit(")"))).otherwise("§81(2)")
    return a.read(spark, d, "orders").select("o_orderkey", s.clause_key(text).alias("key"), s.section_key(section).alias("section"))


@query("""SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE', 'PROMO') THEN p_type WHEN p_type = 'MEDIUM' THEN 'LARGE' ELSE 'OTHER' END AS bucket FROM part""")
def canonical_category(spark, d):
    name = F.concat(F.lit("case of "), F.col("p_type"), F.lit(" matter"))
    return a.read(spark, d, "part").select("p_partkey", s.canonical_category(name, "case of ", " matter", {"MEDIUM": "LARGE"}, ["SMALL", "LARGE", "PROMO"], "OTHER").alias("bucket"))


@query("""SELECT doc_id, round(CASE WHEN length(text) = 0 OR text IS NULL THEN 0 ELSE 1 - length(regexp_replace(text, '[A-Za-z ]', '', 'g')) / length(text) END, 9) AS ratio,
  CASE WHEN length(text) = 0 OR text IS NULL THEN 0 ELSE 1 - length(regexp_replace(text, '[A-Za-z ]', '', 'g')) / length(text) END < 0.5 AS unreadable FROM documents""")
def readable_ratio(spark, d):
    ratio = s.readable_ratio(F.col("text"), "A-Za-z ")
    return a.read(spark, d, "documents").select("doc_id", F.round(ratio, 9).alias("ratio"), (ratio < 0.5).alias("unreadable"))


@query("""SELECT doc_id, md5(regexp_replace(translate(regexp_replace(coalesce(text, ''), '[ \\n\\t]+', '', 'g'), '–—', '--'), '號$', '')) AS digest FROM documents""")
def normalize_token(spark, d):
    """These texts are in compatibility form already, which SQL can't make; other forms are tested apart."""
    return a.read(spark, d, "documents").select("doc_id", F.md5(s.normalize_token(F.coalesce("text", F.lit("")))).alias("digest"))


@query("""SELECT doc_id, md5(substr(text, 1, 100)) AS clipped, md5(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 200) || '…' || right(text, 200) END) AS ends,
  CASE WHEN length(text) <= 200 THEN text WHEN contains(substr(text, 1, 200), '.') THEN regexp_extract(substr(text, 1, 200), '^(.*\\.)', 1, 's') ELSE substr(text, 1, 200) END AS summary FROM documents""")
def clip_texts(spark, d):
    t = F.col("text")
    return a.read(spark, d, "documents").select("doc_id", F.md5(s.clip(t, 100)).alias("clipped"), F.md5(s.head_tail(t, 200)).alias("ends"), s.sentence_summary(t, 200, r"\.").alias("summary"))


#: The names that pages' addresses have: two grammars, the longer first.
URL_GRAMMARS = {
    "titled": (r"^https?://([^/]+)/([a-z]{2})/([0-9]+)\.html", ["host", "lang", "number"]),
    "plain": (r"^https?://([^/]+)/([a-z]{2})/([0-9]+)", ["host", "lang", "number"]),
}


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+/[a-z]{2}/[0-9]+\.html') THEN 'titled' WHEN regexp_matches(url, '^https?://[^/]+/[a-z]{2}/[0-9]+') THEN 'plain' END AS grammar,
  nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/[0-9]+', 1), '') AS lang, nullif(regexp_extract(url, '^https?://[^/]+/[a-z]{2}/([0-9]+)', 1), '') AS number FROM pages""")
def filename_metadata(spark, d):
    meta = s.filename_metadata(F.col("url"), URL_GRAMMARS)
    return a.read(spark, d, "pages").select("page_id", meta["grammar"].alias("grammar"), meta["fields"]["lang"].alias("lang"), meta["fields"]["number"].alias("number"))


@query(r"""SELECT page_id, number, lang FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/[a-z]{2}/([0-9]+)', 1) AS number, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/[0-9]+', 1) AS lang FROM pages) WHERE number <> ''""")
def grammar_registry(spark, d):
    """Grammars are passed by name; names that none fits are left out."""
    meta = s.filename_metadata(F.col("url"), {"only": URL_GRAMMARS["plain"]})
    return a.read(spark, d, "pages").withColumn("m", meta).where("m is not null").select("page_id", F.col("m.fields")["number"].alias("number"), F.col("m.fields")["lang"].alias("lang"))


@query("""SELECT p_partkey, CASE WHEN n_name IS NOT NULL THEN 'https://law.example/' || n_name || '?no=' || p_size WHEN p_partkey % 7 = 0 THEN 'http://raw.example/' || p_partkey END AS url
  FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 40""")
def derive_url(spark, d):
    dim = a.read(spark, d, "nation").select(F.col("n_nationkey").alias("code_key"), F.col("n_name").alias("code"))
    part = a.read(spark, d, "part").withColumn("code_key", (F.col("p_partkey") % 40).cast("int"))
    raw = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("http://raw.example/"), F.col("p_partkey").cast("string"))).otherwise("no address")
    return part.join(dim, "code_key", "left").select("p_partkey", s.derive_url(F.col("code"), F.col("p_size").cast("string"), raw, ("https://law.example/", "?no=")).alias("url"))


@query("""SELECT doc_id, i - 1 AS i, source || '#' || (i - 1) || CASE WHEN n > 1 THEN '#p' || i ELSE '' END AS chunk_id, '[' || lang || ']' || chr(10) || piece AS body
FROM (SELECT doc_id, source, lang, n, i, string_split(text, chr(10))[i] AS piece FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM documents), range(1, n + 1) r(i))""")
def chunk_key_and_header(spark, d):
    docs = a.read(spark, d, "documents").withColumn("pieces", F.split("text", "\n"))
    rows = docs.select("doc_id", "source", "lang", F.size("pieces").alias("n"), F.posexplode("pieces").alias("i", "piece"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), s.chunk_key(F.col("source"), F.col("i"), F.col("n")).alias("chunk_id"), s.chunk_body(F.col("lang"), F.col("piece")).alias("body"))


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'act' ELSE 'rule' END AS law_type FROM part")
def law_type(spark, d):
    return a.read(spark, d, "part").select("p_partkey", s.closed_type(F.col("p_brand"), ["Brand#1", "Brand#2", "Brand#3"], "act", "rule").alias("law_type"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def clean_text(spark, d):
    return a.read(spark, d, "documents").select("doc_id", F.md5(s.clean_text(F.concat(F.lit("\0"), F.col("text"), F.lit("(2)")))).alias("digest"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 1 AS n FROM events")
def metadata_project(spark, d):
    m = s.metadata_project(F.col("props"), ["k", "none"])
    return a.read(spark, d, "events").select("event_id", m["k"].alias("k"), F.size(m).alias("n"))


@query("SELECT o_orderkey, concat_ws('；', nullif(CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE '' END, ''), CASE WHEN o_orderkey % 3 = 0 THEN 'third' END, o_orderstatus) AS notes FROM orders")
def join_notes(spark, d):
    k = F.col("o_orderkey")
    return a.read(spark, d, "orders").select("o_orderkey", s.join_notes(F.when(k % 2 == 0, "even").otherwise(""), F.when(k % 3 == 0, "third"), F.col("o_orderstatus")).alias("notes"))


@query("SELECT doc_id, (8 + coalesce(strlen(text), 0) + strlen(lang))::BIGINT AS bytes, 8 + coalesce(strlen(text), 0) + strlen(lang) > 10000 AS large FROM documents")
def payload_bytes(spark, d):
    n = s.payload_bytes(text=F.col("text"), lang=F.col("lang"))
    return a.read(spark, d, "documents").select("doc_id", n.cast("long").alias("bytes"), (n > 10000).alias("large"))


@query("""SELECT conv_id, md5('【first】' || chr(10) || coalesce(max(text) FILTER (turn = 0), '') || chr(10) || chr(10) || '【second】' || chr(10) || coalesce(max(text) FILTER (turn = 1), '') || chr(10) || chr(10) || '【third】' || chr(10) || coalesce(max(text) FILTER (turn = 2), '')) AS digest FROM conversations GROUP BY conv_id""")
def build_input_text(spark, d):
    turns = a.read(spark, d, "conversations").groupBy("conv_id").pivot("turn", [0, 1, 2]).agg(F.max("text"))
    return turns.select("conv_id", F.md5(s.build_input_text({"first": F.col("0"), "second": F.col("1"), "third": F.col("2")})).alias("digest"))


@query("""SELECT conv_id, short, CASE WHEN conv_id % 4 = 0 THEN short ELSE long END AS long FROM (SELECT conv_id, trim('type ' || substr(max(text) FILTER (turn = 0), 1, 40)) AS short,
  substr(concat_ws(chr(10), max(text) FILTER (turn = 0), max(text) FILTER (turn = 1)), 1, 900) AS long FROM conversations GROUP BY conv_id)""")
def retrieval_query_text(spark, d):
    turns = a.read(spark, d, "conversations").groupBy("conv_id").pivot("turn", [0, 1]).agg(F.max("text"))
    blank = F.col("conv_id") % 4 == 0
    q = s.retrieval_query_text(F.lit("type"), F.array("0"), F.when(~blank, F.col("0")), F.when(~blank, F.col("1")))
    return turns.select("conv_id", q["short"].alias("short"), q["long"].alias("long"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS key FROM pages) SELECT page_id, key, CASE WHEN trim(key) = '' THEN NULL WHEN NOT regexp_full_match(key, '[A-Za-z0-9_-]{1,64}') THEN 'malformed' WHEN lower(key) IN ('1', '2', 'new') THEN 'reserved' WHEN key IN (SELECT doc_id::VARCHAR FROM documents WHERE doc_id % 2 = 0) THEN 'taken' END AS problem FROM t""")
def valid_case_key(spark, d):
    keys = a.read(spark, d, "pages").select("page_id", F.regexp_extract("url", "[^/]*$", 0).alias("key"))
    taken = a.read(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("key"), F.lit(True).alias("taken"))
    return keys.join(taken, "key", "left").select("page_id", "key", s.key_problem(F.col("key"), F.col("taken"), ["1", "2", "new"]).alias("problem"))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n, (SELECT count(*) FROM orders WHERE year(o_orderdate) IN (1996, 1999)) AS dropped FROM orders WHERE year(o_orderdate) NOT IN (1996, 1999) GROUP BY 1")
def holdout_filter(spark, d):
    rows, dropped = s.holdout_filter(a.read(spark, d, "orders"), F.year("o_orderdate"), [1996, 1999])
    total = dropped.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))
    return rows.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))


@query("SELECT conv_id, turn FROM conversations WHERE role NOT IN ('system', 'assistant')")
def index_role_filter(spark, d):
    return a.read(spark, d, "conversations").where(s.indexed_role(F.col("role"), ["system", "assistant"])).select("conv_id", "turn")


@query(r"""SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') THEN 'email' END, CASE WHEN regexp_matches(text, '(?i)ignore (?:all |previous )+instructions|<script') THEN 'injected' END], lambda x: x IS NOT NULL) AS findings FROM documents""")
def content_safety_screen(spark, d):
    """Two rules of its own; content_safety_screen_all has all nine."""
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "injected": r"(?i)ignore (?:all |previous )+instructions|<script"}
    return a.read(spark, d, "documents").select("doc_id", s.screening_findings(F.col("text"), rules).alias("findings"))


@query(r"""SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z0-9])[A-Z][12]\p{Nd}{8}(?:\P{Nd}|$)') THEN 'id_number' END,
  CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'email' END,
  CASE WHEN regexp_matches(text, '(?:^|\P{Nd})09\p{Nd}{2}[- ]?\p{Nd}{3}[- ]?\p{Nd}{3}(?:\P{Nd}|$)') THEN 'mobile' END,
  CASE WHEN regexp_matches(text, '(?:^|\P{Nd})(?:\p{Nd}[ -]?){13,19}(?:\P{Nd}|$)') THEN 'card' END,
  CASE WHEN regexp_matches(text, '(?:銀行帳號|金融帳號|信用卡號|存摺帳號|付款帳號)[^\n]{0,24}\p{Nd}{5,}') THEN 'account' END,
  CASE WHEN regexp_matches(text, '(?:戶籍地址|居住地址|通訊地址|住址)[\s\x0b\x1c-\x1f\x{85}\p{Z}]*[：:]') THEN 'address' END,
  CASE WHEN regexp_matches(text, '病歷|診斷證明|身心障礙|精神疾病|罹患|住院|就醫|醫院診療') THEN 'medical' END,
  CASE WHEN regexp_matches(text, '(?:身分證字號|國民身分證|統一編號)[^\n]{0,24}[A-Z0-9]{6,}') THEN 'identity' END,
  CASE WHEN regexp_matches(text, '(?i)<script(?:[^\p{L}\p{N}_]|$)|javascript:|ignore previous instructions|忽略先前指示') THEN 'injected' END], lambda x: x IS NOT NULL) AS findings FROM documents""")
def content_safety_screen_all(spark, d):
    """All nine rules. Its SQL has a character or an end where the patterns look around, which finds the same texts."""
    return a.read(spark, d, "documents").select("doc_id", s.screening_findings(F.col("text")).alias("findings"))


@query("""SELECT o.l_orderkey, list(l_partkey || '#' || CASE l_linenumber % 3 WHEN 0 THEN '12' WHEN 1 THEN '40-1' ELSE 'x' END ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber % 3 < 2) AS keys FROM lineitem o GROUP BY 1 HAVING count(*) FILTER (l_linenumber % 3 < 2) > 0""")
def valid_citation_filter(spark, d):
    tail = F.when(F.col("l_linenumber") % 3 == 0, "12").when(F.col("l_linenumber") % 3 == 1, "40-1").otherwise("x")
    rows = a.read(spark, d, "lineitem").withColumn("key", F.concat(F.col("l_partkey").cast("string"), F.lit("#"), tail))
    lists = rows.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "key"))), lambda x: x["key"]).alias("keys"))
    return lists.select("l_orderkey", s.valid_citations(F.col("keys")).alias("keys")).where(F.size("keys") > 0)


@query("""SELECT o_orderkey FROM orders WHERE (contains(lower(o_orderpriority), 'low') OR contains(o_orderkey::VARCHAR, '77')) AND o_orderstatus = 'F' AND o_orderdate::DATE >= DATE '2001-08-01' - 365""")
def case_list_filter(spark, d):
    o = a.read(spark, d, "orders")
    kept = s.list_filter("low", [F.col("o_orderpriority")], F.col("o_orderstatus"), "F", F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date"), 365)
    other = s.list_filter("77", [F.col("o_orderkey")], F.col("o_orderstatus"), "F", F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date"), 365)
    return o.where(kept | other).select("o_orderkey")


@query("SELECT law_id, law_name, article_no FROM (SELECT p_partkey AS law_id, p_brand AS law_name, p_size AS article_no, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r FROM part WHERE p_type <> 'PROMO' AND p_name <> '' AND p_retailprice > 905) WHERE r = 1")
def law_row_validity(spark, d):
    """Deleted, unnamed and empty rows go; a number that isn't one is an error; the first row of a key wins."""
    part = a.read(spark, d, "part").select(F.col("p_partkey").alias("law_id"), F.col("p_brand").alias("law_name"), s.article_number(F.col("p_size")).cast("int").alias("article_no"), "p_type", "p_name", "p_retailprice")
    good = (F.col("p_type") != "PROMO") & (F.col("p_name") != "") & (F.col("p_retailprice") > 905)
    return corpus.valid_articles(part, good, "law_name", "article_no", "law_id").select("law_id", "law_name", "article_no")
