"""Texts to rows, and the incremental jobs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.operators import plugins
from casegrid.operators import segment as s
from casegrid.registry import query
from casegrid.streaming import jobs, states

from . import adapters as a
from .adapters import with_
from .corpus import _folder


_DECISION = """上列訴願人因事件，決定如
下：
　主　文
訴願{result}。
{fact}　理　由
一、按{law}。二、卷查{case}。
綜上論結，決定如主文。
{signed}"""


@query("""SELECT o_orderkey AS k, CASE WHEN o_custkey % 7 = 0 THEN 'no signature' WHEN o_custkey % 7 = 1 THEN 'no main text' WHEN o_custkey % 7 = 2 THEN 'main text too long' END AS problem,
  CASE WHEN o_custkey % 7 > 2 THEN '訴願' || o_orderpriority || '。' END AS main, CASE WHEN o_custkey % 7 > 2 THEN CASE WHEN o_custkey % 2 = 0 THEN '緣' || o_custkey || '不服。' ELSE '' END END AS fact FROM orders""")
def split_decision_layouts(spark, d):
    """Decisions rendered from orders: with and without facts, without signature or main text, with too long a one."""
    p, k = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    parts = {
        "result": F.when(p % 7 == 2, F.repeat(F.lit("長"), F.lit(300))).otherwise(F.col("o_orderpriority")),
        "fact": F.when(p % 2 == 0, F.concat(F.lit("　事　實\n緣"), p.cast("string"), F.lit("不服。\n"))).otherwise(""),
        "law": F.concat(F.lit("法"), k),
        "case": F.concat(F.lit("本件"), k),
        "signed": F.when(p % 7 == 0, "").otherwise("訴願審議委員會主任委員 某"),
    }
    text = F.lit(_DECISION)
    for name, part in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), part)
    text = F.when(p % 7 == 1, F.replace(text, F.lit("　主　文"), F.lit(""))).otherwise(text)
    texts = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text"))
    got, good = texts.select("k", s.decision_sections(F.col("text")).alias("got")), F.col("got.problem").isNull()
    return got.select("k", "got.problem", F.when(good, F.col("got.main")).alias("main"), F.when(good, F.col("got.facts")).alias("fact"))


@query("SELECT doc_id, 'no main text' AS problem FROM documents")
def split_decision_sections(spark, d):
    """None of these texts is a decision; the layouts of decisions are tested apart."""
    return a.read(spark, d, "documents").select("doc_id", s.decision_sections(F.col("text"))["problem"].alias("problem"))


_LINES = "l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i))"
_WHITE = "' ' || chr(9) || chr(10) || chr(13)"


@query(f"""WITH {_LINES}, h AS (SELECT *, nullif(regexp_extract(line, '^([A-Z][a-z]+)\\.$', 1), '') AS name FROM l),
c AS (SELECT *, count(name) OVER (PARTITION BY doc_id ORDER BY i) AS section, count(name) OVER (PARTITION BY doc_id) AS n FROM h),
k AS (SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE section END AS section, CASE WHEN n > 0 THEN name END AS name, line, i FROM c WHERE n = 0 OR section > 0),
g AS (SELECT doc_id, section, max(name) AS name, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (name IS NULL), ''), {_WHITE}) AS body FROM k GROUP BY 1, 2)
SELECT doc_id, section::INT AS section, name, md5(body) AS digest FROM g WHERE body <> ''""")
def split_labelled_sections(spark, d):
    rows = s.labelled_sections(a.read(spark, d, "documents"), "doc_id", "text", r"^([A-Z][a-z]+)\.$")
    return rows.select("doc_id", "section", "name", F.md5("body").alias("digest"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey::VARCHAR END AS who, o_orderstatus AS state, o_orderpriority AS level FROM orders""")
def header_fields(spark, d):
    """Fields written one after the other under labels, of which some are absent."""
    o = a.read(spark, d, "orders")
    who = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("Who: "), F.col("o_custkey").cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("head "), who, F.lit("State:"), F.col("o_orderstatus"), F.lit(" \nLevel: "), F.col("o_orderpriority"))
    fields = s.header_fields(text, {"who": r"Who:\s*", "state": r"State:\s*", "level": r"Level:\s*"})
    return o.select("o_orderkey", fields.alias("f")).select("o_orderkey", *[F.col("f")[k].alias(k) for k in ("who", "state", "level")])


@query("SELECT o_orderkey, 4 - (o_orderkey % 2)::INT AS n, '一、first ' || o_custkey AS second FROM orders")
def split_items(spark, d):
    """A lead and three items, of which one is inside quotes in every other row."""
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    inner = F.when(k % 2 == 1, F.lit("二、see「text。三、inside」end。")).otherwise(F.lit("二、see。三、outside。"))
    text = F.concat(F.lit("lead。一、first "), n, F.lit("\n"), inner)
    items = s.split_items(text)
    return a.read(spark, d, "orders").select("o_orderkey", F.size(items).alias("n"), F.get(items, F.lit(1)).alias("second"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END AS facts, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'b' || o_custkey || 'more' END AS reason FROM orders")
def split_appeal_items(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    head = F.when(k % 4 == 0, F.lit("訴願答辯書\n")).otherwise(F.lit("訴願書\n"))
    text = F.concat(head, F.lit("　事　實　\n一、a\n二、aa\n理由\n一、b"), n, F.lit("\n  more\n附送證件\n一、c"))
    got = s.appeal_items(text)
    return a.read(spark, d, "orders").select("o_orderkey", F.size(got["facts"]).alias("facts"), F.get(got["reasons"], F.lit(0)).alias("reason"))


_ART = r"^([A-Z][a-z]{2}) "


@query(rf"""WITH {_LINES}, n AS (SELECT *, trim(line, {_WHITE}) AS t FROM l WHERE trim(line, {_WHITE}) <> '' AND NOT regexp_matches(trim(line, {_WHITE}), '^Be')),
h AS (SELECT *, nullif(regexp_extract(line, '{_ART}', 1), '') AS number, nullif(trim(regexp_extract(line, '^(([A-Z][a-z]{{3}}) .*)$', 1), {_WHITE}), '') AS name FROM n),
w AS (SELECT *, count(number) OVER p AS place, last_value(name IGNORE NULLS) OVER p AS chapter, count(coalesce(number, name)) OVER p AS part FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT doc_id, part, place, i, number, chapter, trim(CASE WHEN number IS NOT NULL THEN regexp_replace(line, '{_ART}', '') ELSE line END, {_WHITE}) AS body FROM w WHERE name IS NULL)
SELECT doc_id, place::INT AS place, coalesce(arg_min(chapter, i), '') AS chapter, max(number) AS article_no, md5(coalesce(string_agg(body, '' ORDER BY i) FILTER (body <> ''), '')) AS digest FROM b GROUP BY doc_id, part, place HAVING max(number) IS NOT NULL""")
def split_articles(spark, d):
    rows = s.split_articles(a.read(spark, d, "documents"), "doc_id", "text", r"^(([A-Z][a-z]{3}) .*)$", _ART, "^§", "^Be")
    return rows.select("doc_id", "place", "chapter", "article_no", F.md5("body").alias("digest"))


@query(rf"""WITH t AS (SELECT doc_id, trim(text, {_WHITE}) AS t FROM documents), p AS (SELECT *, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: trim(x, {_WHITE})), lambda x: x <> '') AS ps FROM t),
u AS (SELECT *, CASE WHEN len(ps) > 1 THEN ps ELSE list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, {_WHITE})), lambda x: x <> '') END AS us FROM p),
c AS (SELECT doc_id, CASE WHEN length(t) < 2000 THEN [t] ELSE string_split(list_reduce(us, lambda acc, x: CASE WHEN length(regexp_extract(acc, '[^\x01]*$')) + 1 + length(x) <= 1500 THEN acc || chr(10) || x ELSE acc || chr(1) || x END), chr(1)) END AS chunks FROM u)
SELECT doc_id, i - 1 AS i, md5(chunks[i]) AS digest FROM c, range(1, len(chunks) + 1) r(i)""")
def pack_chunks(spark, d):
    docs = a.read(spark, d, "documents").select("doc_id", F.posexplode(s.pack_chunks(F.col("text"))).alias("i", "chunk"))
    return docs.select("doc_id", F.col("i").cast("long").alias("i"), F.md5("chunk").alias("digest"))


_ROLES = {"conclusion": "que|the", "enum": "^[A-Z][a-z] ", "citing": "^(th|la)", "article": "[a-z]+tion", "rebuttal": "claim.*?so", "specific": "ing ", "going_on": "^(an|en)"}


@query(rf"""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last, trim(regexp_replace(text, '^[A-Z][a-z] ', ''), {_WHITE}) AS bare FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'system' THEN '事實敘述' WHEN last AND regexp_matches(text, 'que|the') THEN '結語' WHEN regexp_matches(bare, '^(th|la)') THEN '法規引述' WHEN len(regexp_extract_all(text, '[a-z]+tion')) >= 2 AND NOT regexp_matches(text, 'ing ') THEN '法規引述'
  WHEN regexp_matches(text, 'claim.*?so') THEN '其他項次' WHEN regexp_matches(bare, '^(an|en)') THEN '接續段' WHEN regexp_matches(text, 'ing ') THEN '本案論理' WHEN regexp_matches(text, '^[A-Z][a-z] ') THEN '其他項次' ELSE '本案論理' END AS paragraph_role FROM c""")
def paragraph_role(spark, d):
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1
    turns = a.read(spark, d, "conversations").withColumn("last", last)
    return turns.select("conv_id", "turn", s.paragraph_role(F.col("role"), F.col("text"), F.col("last"), _ROLES, "system").alias("paragraph_role"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '(the|and|same|les) ([a-z]+)', 1) AS laws, regexp_extract_all(text, '(the|and|same|les) ([a-z]+)', 2) AS nos FROM documents),
r AS (SELECT doc_id, i - 1 AS pos, laws[i] AS law, nos[i] AS no FROM m, range(1, len(laws) + 1) t(i)),
c AS (SELECT doc_id, pos, last_value(CASE WHEN law <> 'and' THEN law END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS law, no AS number FROM r)
SELECT doc_id, law, number, min(pos)::INT AS pos FROM c WHERE law IS NOT NULL GROUP BY 1, 2, 3""")
def extract_citations(spark, d):
    return s.extract_citations(a.read(spark, d, "documents"), "doc_id", "text", ["the", "same", "les"], ["and"], " ([a-z]+)()")


@query(with_("citations") + """, f AS (SELECT case_id, pos, CASE WHEN pos % 4 = 3 THEN 'junk' ELSE '法' || law_id || ' 第' || pos || '條' || CASE WHEN pos % 2 = 0 THEN '之1' ELSE '' END END AS fragment, law_id FROM citations)
SELECT case_id, (pos - 1)::INT AS pos, fragment, CASE WHEN pos % 4 <> 3 THEN '法' || law_id END AS name, CASE WHEN pos % 4 <> 3 THEN pos || CASE WHEN pos % 2 = 0 THEN '-1' ELSE '' END END AS number FROM f""")
def parse_citation_string(spark, d):
    pos, law = F.col("pos").cast("string"), F.concat(F.lit("法"), F.col("law_id").cast("string"))
    fragment = F.when(F.col("pos") % 4 == 3, "junk").otherwise(F.concat(law, F.lit(" 第"), pos, F.lit("條"), F.when(F.col("pos") % 2 == 0, "之1").otherwise("")))
    lists = a.citations(spark, d).groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", fragment.alias("f")))), lambda x: x["f"]), "； ").alias("t"))
    return s.parse_citation_string(lists, "case_id", "t")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, 'the ([a-z]+)ing') THEN '§77(' || regexp_extract(text, 'the ([a-z]+)ing', 1) || ')' WHEN regexp_matches(text, 'que|und') THEN '§81' WHEN regexp_matches(text, 'los') THEN '§79' ELSE '' END AS clause,
  CASE WHEN contains(text, 'zz') THEN 'zz' WHEN contains(text, 'eaux') THEN 'eaux' WHEN contains(text, 'tion') THEN 'tion' ELSE 'none' END AS result, list_last(regexp_extract_all(text, '[0-9]{2,}')) AS last_number FROM documents""")
def extract_clause_result_date(spark, d):
    t = F.col("text")
    clause = s.clause_of(t, "the ([a-z]+)ing", "que|und", "los")
    return a.read(spark, d, "documents").select("doc_id", clause.alias("clause"), s.result_of(t, ["zz", "eaux", "tion"], "none").alias("result"), s.last_date(t, "[0-9]{2,}").alias("last_number"))


_LAW = "CASE o_custkey % 3 WHEN 0 THEN '訴願法' WHEN 1 THEN '民法' ELSE '建築法' END"


@query(f"""WITH x AS (SELECT o_orderkey AS k, {_LAW} AS law, o_custkey AS n, o_orderkey % 9 + 1 AS m FROM orders)
SELECT k, law, translate(n::VARCHAR, '0123456789', '０１２３４５６７８９') AS number, 0 AS pos FROM x UNION ALL SELECT k, law, translate(m::VARCHAR || '-' || n, '0123456789', '０１２３４５６７８９'), 1 FROM x""")
def extract_citations_wide(spark, d):
    """Citations of the decisions' own laws, with full-width digits and ideographic spaces, the second one of the same law."""
    k, n, m = F.col("o_orderkey"), F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 9 + 1).cast("string")
    law = F.when(F.col("o_custkey") % 3 == 0, "訴願法").when(F.col("o_custkey") % 3 == 1, "民法").otherwise("建築法")
    text = a.written_wide(F.concat(F.lit("按"), law, F.lit("第"), n, F.lit("條規定，次按同法第"), m, F.lit("條之"), n, F.lit("及"), law, F.lit("第"), n, F.lit("條。")))
    return s.extract_citations(a.read(spark, d, "orders").select(k.alias("k"), text.alias("text")), "k", "text")


@query(f"""WITH x AS (SELECT o_orderkey AS k, {_LAW} AS law, o_custkey AS n FROM orders), w AS (SELECT *, translate(n::VARCHAR, '0123456789', '０１２３４５６７８９') AS f FROM x)
SELECT k, 0 AS pos, law AS name, CASE WHEN n % 2 = 0 THEN f || '-' || f ELSE f END AS number FROM w UNION ALL SELECT k, 1, NULL, NULL FROM w""")
def parse_citation_string_wide(spark, d):
    """Lists with full-width digits, and a fragment that doesn't parse."""
    n = F.translate(F.col("o_custkey").cast("string"), "0123456789", "０１２３４５６７８９")
    law = F.when(F.col("o_custkey") % 3 == 0, "訴願法").when(F.col("o_custkey") % 3 == 1, "民法").otherwise("建築法")
    text = F.concat(law, F.lit("　第"), n, F.lit("條"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("之"), n)).otherwise(""), F.lit("；第三編"))
    rows = s.parse_citation_string(a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text")), "k", "text")
    return rows.select("k", "pos", "name", "number")


@query("""SELECT o_orderkey AS k, CASE o_custkey % 4 WHEN 0 THEN '§77(' || translate((o_orderkey % 8 + 1)::VARCHAR, '0123456789', '０１２３４５６７８９') || ')' WHEN 1 THEN '§81' WHEN 2 THEN '§79' ELSE '' END AS clause,
  CASE o_custkey % 4 WHEN 0 THEN '不受理' WHEN 1 THEN '撤銷' WHEN 2 THEN '駁回' ELSE '其他' END AS result, o_orderdate::DATE AS day FROM orders""")
def extract_clause_result_date_wide(spark, d):
    """Clauses, results and dates as decisions word them, with full-width digits and ideographic spaces."""
    from casegrid.functions.scalars import format_minguo_date, parse_minguo_date

    p, day = F.col("o_custkey") % 4, F.to_date("o_orderdate")
    wide = a.written_wide
    clause = F.when(p == 0, F.concat(F.lit("依訴願法第　77　條第"), wide((F.col("o_orderkey") % 8 + 1).cast("string")), F.lit("款，訴願不受理"))).when(p == 1, "依訴願法第　81　條，原處分撤銷").when(p == 2, "依訴願法第\u200779\u2007條，訴願駁回").otherwise("如主文")
    text = F.concat(clause, wide(F.concat(F.lit("。中華民國1年1月1日。中華"), format_minguo_date(day))))
    return a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), s.clause_of(text).alias("clause"), s.result_of(text).alias("result"), parse_minguo_date(s.last_date(text)).alias("day"))


@query("""SELECT doc_id, 1 + 2 * (length(text) - length(replace(text, '. ', '.')))::INT AS n FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%「%'""")
def split_items_long(spark, d):
    """Every sentence of every document as an item that quotes items of its own."""
    docs = a.read(spark, d, "documents").where(F.col("text").isNotNull() & ~F.col("text").contains("「"))
    text = F.concat(F.lit("x"), F.replace(F.col("text"), F.lit(". "), F.lit("。一、see「a。二、b」。三、more ")))
    return docs.select("doc_id", F.size(s.split_items(text)).alias("n"))


@query("""SELECT n_nationkey, '甲乙市（一）' AS grp, ['N' || n_nationkey || '區', '丁區'] AS districts FROM nation UNION ALL SELECT n_nationkey, '甲乙市（二）', ['戊區'] FROM nation""")
def districts_from_note(spark, d):
    note = F.concat(F.lit("甲乙市（一）：N"), F.col("n_nationkey").cast("string"), F.lit("區、丁 區，x。甲乙市（二）：戊區。"))
    return a.read(spark, d, "nation").select("n_nationkey", F.explode(s.districts_from_note(note)).alias("grp", "districts"))


@query("""SELECT c_custkey, '甲乙市（一）' AS grp, ['N' || c_custkey || '區', '丁區'] AS districts FROM customer UNION ALL SELECT c_custkey, '丙丁市（二）', CASE WHEN c_custkey % 2 = 0 THEN ['戊區'] ELSE [] END FROM customer""")
def districts_from_notes(spark, d):
    """A note for each customer."""
    key = F.col("c_custkey").cast("string")
    note = F.concat(F.lit("甲乙市（一）：N"), key, F.lit("區、丁 區，x。丙丁市（二）："), F.when(F.col("c_custkey") % 2 == 0, "戊區").otherwise("無"), F.lit("。"))
    return a.read(spark, d, "customer").select("c_custkey", F.explode(s.districts_from_note(note)).alias("grp", "districts"))


@query("""SELECT doc_id, lang, length(text)::INT AS size FROM documents""")
def incremental_ingest_stream(spark, d):
    """Documents arrive in files, some of them twice; the table is as if they had come at once."""
    source, work = _folder(spark, "arrivals"), _folder(spark, "ingest")
    docs = a.read(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("size"), F.lit(1).alias("version"))
    old = docs.where("doc_id % 3 = 0").withColumns({"size": F.lit(-1), "version": F.lit(0)})
    docs.unionByName(old).repartition("doc_id").write.parquet(source)
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(source)
    return jobs.ingest(arriving, "doc_id", "version", f"{work}/table", f"{work}/checkpoint").select("doc_id", "lang", "size")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def case_stage_stream(spark, d):
    source, work = _folder(spark, "events"), _folder(spark, "stages")
    events = a.read(spark, d, "events").select("user_id", "event_type", "event_id")
    events.repartition("event_id").write.parquet(source)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return jobs.stages(arriving, "user_id", "event_type", "event_id", f"{work}/out", f"{work}/checkpoint")


@query("""WITH e AS (SELECT user_id, event_id AS nr, CASE WHEN event_id % 3 > 0 THEN event_type END AS stage, CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' END AS status FROM events),
s AS (SELECT user_id, max(nr) AS stage_at, arg_max(stage, nr) AS stage FROM e WHERE stage IS NOT NULL GROUP BY 1), t AS (SELECT user_id, max(nr) AS status_at, arg_max(status, nr) AS status FROM e WHERE status IS NOT NULL GROUP BY 1)
SELECT coalesce(s.user_id, t.user_id) AS user_id, stage_at, stage, status_at, status, CASE WHEN status = 'error' THEN 'failed at ' || status_at END AS error FROM s FULL JOIN t ON s.user_id = t.user_id""")
def case_state_stream(spark, d):
    """Events that tell a stage, a status, both or neither; they come in no order, and a third of them comes again."""
    source, work = _folder(spark, "tellings"), _folder(spark, "states")
    n = F.col("event_id")
    told = a.read(spark, d, "events").select("user_id", n.alias("at"), F.when(n % 3 > 0, F.col("event_type")).alias("stage"), F.when(n % 5 == 0, "error").when(n % 5 == 1, "processing").when(n % 5 == 2, "done").alias("status"), F.concat(F.lit("failed at "), n.cast("string")).alias("error"))
    told.unionByName(told.where("at % 3 = 1")).repartition(6, F.xxhash64("at", F.rand(1))).write.parquet(source)
    arriving = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", 3).parquet(source)
    return states.case_states(arriving, "user_id", "at", f"{work}/table", f"{work}/checkpoint")


@query()
def embed_batches(spark, d):
    rows = plugins.embed_batches(a.read(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda x, y: x + y.cast("double")), 4).alias("total"))


@query("""WITH q AS (SELECT conv_id, lower(text) AS q FROM conversations WHERE turn = 0), c AS (SELECT conv_id, turn AS id, lower(text) AS t FROM conversations WHERE turn > 0),
w AS (SELECT c.conv_id, id, list_distinct(list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '')) AS qs, list_distinct(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS ts FROM c JOIN q ON c.conv_id = q.conv_id),
s AS (SELECT *, CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ts))::DOUBLE / len(qs) ELSE 0 END AS s FROM w)
SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, id)::INT AS ext FROM s""")
def rerank_with(spark, d):
    turns = a.read(spark, d, "conversations")
    first = turns.where("turn = 0").select("conv_id", F.col("text").alias("query"))
    rest = turns.where("turn > 0").select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("pos"), "text")
    return plugins.rerank_with(rest.join(first, "conv_id"), "conv_id")


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings), s AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(c.vec, q.vec), 6) AS score FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3""")
def provider_interface(spark, d):
    provider: plugins.Provider = plugins.TableProvider(a.chunk_vectors(spark, d), a.articles(spark, d).withColumnRenamed("law_id", "key"))
    return provider.similar(a.query_vectors(spark, d), 3)
