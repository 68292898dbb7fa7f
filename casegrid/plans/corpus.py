"""Corpus building and checking: sources, citations, sync planning, assembly, profiles, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid.functions import scalars as s
from casegrid.operators import corpus as k
from casegrid.operators import keyed_table, lookup
from casegrid.operators.keyed_table import KeyedTable
from casegrid.registry import query
from casegrid.sources import files
from casegrid.storage import scratch_path
from casegrid.streaming import jobs

from . import adapters as a
from .adapters import with_


_folder = scratch_path


@query("SELECT count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total FROM events")
def jsonl_source(spark, d):
    path = _folder(spark, "jsonl")
    a.read(spark, d, "events").select(F.col("props").alias("value")).write.text(path)
    return files.jsonl_source(spark, path, "k long").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT event_id, event_id % 3 AS file, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) * 2 AS line FROM events")
def jsonl_source_numbered(spark, d):
    """A file for each third of the events, whose rows stand on every other line, read in small splits."""
    path, events = _folder(spark, "jsonl"), a.read(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("file"))
    lines = events.select("file", F.concat(F.lit(" \n"), F.to_json(F.struct("event_id", F.col("file").alias("third")))).alias("value"), "event_id")
    lines.repartition(3, "file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(path)
    return files.jsonl_source(spark, path, "event_id long, third long", numbered=True).select("event_id", F.col("third").alias("file"), "line")


@query("SELECT source AS bucket, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def bucketed_source(spark, d):
    path = _folder(spark, "buckets")
    files.bucketed_sink(a.read(spark, d, "documents").select("doc_id", "text", "source"), path, "source")
    rows = files.bucketed_source(spark, path, "source=([^/]+)/", "doc_id long, text string")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def bucketed_sink(spark, d):
    path = _folder(spark, "sink")
    files.bucketed_sink(a.read(spark, d, "documents").select("doc_id", "lang"), path, "lang")
    return spark.read.json(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(r"SELECT key, arg_min(url, page_id) AS url FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)/', 1) AS key FROM pages WHERE page_id % 3 > 0) GROUP BY key")
def link_index_source(spark, d):
    path = _folder(spark, "links")
    rows = a.read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("key"), "url", (F.col("page_id") % 3).alias("category"))
    rows.write.csv(path, header=True, escape='"')
    listed = spark.read.schema("page_id long, key string, url string, category int").csv(path, header=True, escape='"')
    return files.first_links(listed, "key", "url", "page_id", F.col("category") > 0)


@query("""WITH c AS (SELECT x::DATE AS day, f FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS x), (VALUES (0), (1)) t(f))
SELECT day, CASE WHEN day(day) % 2 = 0 THEN '放假日' ELSE 'named' END AS label FROM c WHERE isodow(day) <= 5 AND f = CASE WHEN year(day) = 2024 THEN 1 ELSE 0 END AND (day(day) + f) % 7 = 0 AND (SELECT count(*) FROM region) > 0""")
def holiday_calendar_source(spark, d):
    days = a.read(spark, d, "region").limit(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2025-12-31").cast("date"))).alias("x"), F.explode(F.array(F.lit(0), F.lit(1))).alias("f"))
    listed = days.where((F.year("x") == 2024) | (F.col("f") == 0))
    day = F.dayofmonth("x")
    rows = listed.select(F.date_format("x", "yyyyMMdd").alias("date"), F.when((day + F.col("f")) % 7 == 0, "2").otherwise("0").alias("flag"), F.when(day % 2 == 0, " ").otherwise("named").alias("label"), "f")
    return files.closed_weekdays(rows.unionByName(rows.limit(1).withColumn("date", F.lit("2024xx01"))), "date", "flag", "label", "f")


@query("""WITH x AS (SELECT o_orderdate::DATE AS day, o_custkey % 3 AS f FROM orders), y AS (SELECT year(day) AS y, max(f) AS f FROM x GROUP BY 1)
SELECT day, CASE WHEN day(day) % 2 = 0 THEN '放假日' ELSE 'named' END AS label FROM x JOIN y ON y.y = year(day) AND x.f = y.f WHERE isodow(day) <= 5 AND (day(day) + x.f) % 7 = 0""")
def holiday_calendar_orders(spark, d):
    """Calendar rows rendered from orders: as many as there are orders."""
    day, f = F.to_date("o_orderdate"), F.col("o_custkey") % 3
    number = F.dayofmonth(day)
    rows = a.read(spark, d, "orders").select(F.date_format(day, "yyyyMMdd").alias("date"), F.when((number + f) % 7 == 0, "2").otherwise("0").alias("flag"), F.when(number % 2 == 0, " ").otherwise("named").alias("label"), f.alias("f"))
    return files.closed_weekdays(rows, "date", "flag", "label", "f")


@query("SELECT 'A' || c_custkey AS agency, n_name AS residence, (c_custkey % 31)::INT AS days FROM customer JOIN nation ON n_nationkey = c_nationkey")
def transit_matrix_parties(spark, d):
    """Nested tables rendered from customers: a block for each."""
    rows = a.read(spark, d, "customer").join(a.read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    block = F.to_json(F.create_map(F.concat(F.lit("A"), F.col("c_custkey").cast("string")), F.create_map("n_name", (F.col("c_custkey") % 31).cast("int"))))
    return files.transit_matrix(rows.select(block.alias("block")), "block")


@query("SELECT r_name AS agency, n_name AS residence, ((n_nationkey * 7 + r_regionkey) % 31)::INT AS days FROM nation, region")
def transit_matrix_source(spark, d):
    pairs = a.read(spark, d, "nation").join(F.broadcast(a.read(spark, d, "region")))
    days = ((F.col("n_nationkey") * 7 + F.col("r_regionkey")) % 31).cast("int")
    row = F.map_from_entries(F.collect_list(F.struct("n_name", days.alias("v"))))
    blocks = pairs.groupBy("r_name", (F.col("n_nationkey") % 2).alias("half")).agg(row.alias("row")).select(F.to_json(F.create_map("r_name", "row")).alias("block"))
    return files.transit_matrix(blocks, "block")


@query(r"""SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '<[^>]+>', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> ''), chr(10))) AS digest FROM pages""")
def html_to_text(spark, d):
    return a.read(spark, d, "pages").select("page_id", F.md5(files.html_to_text(F.col("html"))).alias("digest"))


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 10 <> 3 UNION ALL SELECT p_partkey, 'new ' || p_name, p_size + 1 FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT p_partkey + 10000000, p_name, p_size FROM part WHERE p_partkey % 50 = 0""")
def snapshot_upsert(spark, d):
    part = a.read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    changed = part.where("p_partkey % 10 = 3").select("p_partkey", F.concat(F.lit("new "), F.col("p_name")).alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    added = part.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 10000000).alias("p_partkey"), "p_name", "p_size")
    return k.snapshot_upsert(part, changed.unionByName(added), "p_partkey")


_UPDATES = "u AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS d FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)"


@query(f"WITH {_UPDATES} SELECT o.o_orderkey, o_custkey, coalesce(u.d, o_orderdate)::DATE AS day FROM orders o LEFT JOIN u ON o.o_orderkey = u.o_orderkey")
def partial_update(spark, d):
    base = a.read(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    delta = a.read(spark, d, "lineitem").where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("day"))
    return k.partial_update(base, delta, "o_orderkey", ["day"])[0]


_FRAGMENTS = with_("citations", "articles") + """, f AS (SELECT case_id, pos, CASE WHEN pos % 5 = 4 THEN 'junk ' || pos ELSE 'art ' || law_id END AS fragment, CASE WHEN pos % 5 <> 4 THEN law_id END AS key FROM citations),
resolved AS (SELECT f.*, a.law_key, CASE WHEN key IS NULL THEN 'unparsed' WHEN a.law_key IS NULL THEN 'unknown' ELSE 'resolved' END AS status FROM f LEFT JOIN articles a ON a.law_id = key)"""


def _resolved(spark, d):
    cited = a.citations(spark, d)
    junk = F.col("pos") % 5 == 4
    fragment = F.when(junk, F.concat(F.lit("junk "), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("art "), F.col("law_id").cast("string")))
    number = F.regexp_extract("fragment", "^art ([0-9]+)$", 1)
    parsed = cited.select("case_id", "pos", fragment.alias("fragment")).withColumn("key", F.nullif(number, F.lit("")).cast("long"))
    table = a.articles(spark, d).select(F.col("law_id").alias("key"), "law_key")
    return k.citation_resolve(parsed, "case_id", "fragment", table, "key", "law_key")


@query(_FRAGMENTS + " SELECT case_id, pos, fragment, key, law_key, status FROM resolved")
def citation_resolve(spark, d):
    return _resolved(spark, d)


@query(_FRAGMENTS + """, m AS (SELECT case_id, fragment, min(pos) AS p, min(key) FILTER (status = 'resolved') AS id, bool_or(status <> 'resolved') AS bad FROM resolved GROUP BY 1, 2)
SELECT case_id, list_transform(coalesce(list(id ORDER BY p) FILTER (id IS NOT NULL), []), lambda x: x) AS ids, list(fragment ORDER BY p) AS raw, coalesce(list(fragment ORDER BY p) FILTER (bad), []) AS unresolved FROM m GROUP BY 1""")
def citation_union(spark, d):
    rows = _resolved(spark, d).withColumn("id", F.when(F.col("status") == "resolved", F.col("key")))
    return k.citation_union(rows, "case_id", "id", "fragment")


@query(_FRAGMENTS + """, c AS (SELECT case_id, bool_and(status = 'resolved') AS w, count(*) AS n, count(*) FILTER (status = 'resolved') AS g FROM resolved GROUP BY 1)
SELECT sum(n)::BIGINT AS fragments, sum(g)::BIGINT AS resolved, count(*) AS cases, count(*) FILTER (w) AS whole_cases FROM c""")
def resolution_report(spark, d):
    return k.resolution_report(_resolved(spark, d), "case_id")


@query(_FRAGMENTS + """, t AS (SELECT status, fragment AS name, count(*) AS count FROM resolved WHERE status <> 'resolved' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY count DESC, name) AS rank FROM t) WHERE rank <= 20""")
def top_unresolved(spark, d):
    return k.top_unresolved(_resolved(spark, d), F.col("fragment"))


@query(with_("articles") + "SELECT law_key, (SELECT count(*) FROM articles WHERE law_id % 4 = 0) AS overlap FROM articles WHERE law_id % 4 <> 0")
def existing_key_anti_join(spark, d):
    rows = a.articles(spark, d).select("law_key", "law_id")
    new, overlap = lookup.existing_key_split(rows, rows.where("law_id % 4 = 0"), "law_key")
    return new.select("law_key").join(F.broadcast(overlap))


_INDEX = """idx AS (SELECT key, CASE t WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'IN_PROGRESS' ELSE 'INDEXED' END AS status FROM (SELECT event_id % 20000 AS key, arg_max(event_type, event_id) AS t FROM events GROUP BY 1))"""


def _index(spark, d):
    last = a.read(spark, d, "events").groupBy((F.col("event_id") % 20000).alias("key")).agg(F.max_by("event_type", "event_id").alias("t"))
    return last.select("key", F.when(F.col("t") == "error", "FAILED").when(F.col("t") == "signup", "IN_PROGRESS").otherwise("INDEXED").alias("status"))


@query(f"""WITH {_INDEX}, w AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 > 0)
SELECT coalesce(i.key, w.key) AS key, status, CASE WHEN w.key IS NULL THEN 'delete_stale' WHEN status IS NULL THEN 'submit' WHEN status = 'FAILED' THEN 'retry_failed' ELSE 'skip' END AS action FROM idx i FULL JOIN w ON i.key = w.key""")
def sync_plan(spark, d):
    wanted = a.read(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("key"))
    return lookup.sync_plan(_index(spark, d), wanted, "key", "status", delete=True)


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 10 <> 3 UNION ALL SELECT p_partkey, 'new ' || p_name, p_size + 1 FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT p_partkey + 10000000, p_name, p_size FROM part WHERE p_partkey % 50 = 0""")
def snapshot_upsert_buckets(spark, d):
    """The same upsert into a table of key buckets, applied twice and vacuumed."""
    part = a.read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    changed = part.where("p_partkey % 10 = 3").select("p_partkey", F.concat(F.lit("new "), F.col("p_name")).alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    added = part.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 10000000).alias("p_partkey"), "p_name", "p_size")
    table = KeyedTable(spark, _folder(spark, "parts"), "p_partkey").create(part.schema, 8)
    for delta in (part, changed.unionByName(added), changed.unionByName(added)):
        table.upsert(delta)
    table.vacuum(1)
    return table.read()


@query(f"WITH {_UPDATES} SELECT o.o_orderkey, o_custkey, coalesce(u.d, o_orderdate)::DATE AS day FROM orders o LEFT JOIN u ON o.o_orderkey = u.o_orderkey")
def partial_update_buckets(spark, d):
    base = a.read(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    delta = a.read(spark, d, "lineitem").where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("day"))
    table = KeyedTable(spark, _folder(spark, "orders"), "o_orderkey").create(base.schema, 8)
    table.upsert(base)
    table.update(delta, ["day"])
    return table.read()


@query(f"""WITH {_INDEX}, w AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 > 0)
SELECT coalesce(i.key, w.key) AS key, status, CASE WHEN w.key IS NULL THEN 'delete_stale' WHEN status IS NULL THEN 'submit' WHEN status = 'FAILED' THEN 'retry_failed' ELSE 'skip' END AS action FROM idx i FULL JOIN w ON i.key = w.key WHERE w.key IS NULL OR status IS NULL OR status = 'FAILED'""")
def sync_changes(spark, d):
    """What sync_plan wouldn't skip, from two tables of key buckets whose digests are compared first."""
    wanted = a.read(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("key"))
    index = _index(spark, d)
    held = jobs.index_of(spark, _folder(spark, "index"), "key").create(index.schema, 8)
    held.upsert(index)
    corpus = KeyedTable(spark, _folder(spark, "wanted"), "key").create(wanted.schema, 8)
    corpus.upsert(wanted)
    return keyed_table.sync_changes(held, corpus, "status", delete=True)


@query(f"WITH {_INDEX} SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT key FROM idx WHERE status IN ('INDEXED', 'IN_PROGRESS'))")
def pending_rows(spark, d):
    return lookup.pending_rows(a.read(spark, d, "orders").select(F.col("o_orderkey").alias("key")), _index(spark, d), "key", "status")


_SNAPSHOTS = "n AS (SELECT user_id, arg_max(event_type, event_id) AS t, arg_max(props, event_id) AS p FROM events GROUP BY 1), u AS (SELECT user_id, arg_max(event_type, event_id) AS t, arg_max(props, event_id) AS p FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1)"


@query(f"WITH {_SNAPSHOTS} SELECT n.user_id, u.user_id IS NOT NULL AND (n.t IS DISTINCT FROM u.t OR n.p IS DISTINCT FROM u.p) AS stale FROM n LEFT JOIN u ON n.user_id = u.user_id")
def snapshot_staleness(spark, d):
    e = a.read(spark, d, "events")
    state = lambda x: x.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.max_by("props", "event_id").alias("p"))
    return lookup.snapshot_staleness(state(e), state(e.where(F.col("ts") < F.lit("2024-01-29").cast("timestamp_ntz"))), "user_id", ["t", "p"])


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE + 1 END AS adopted, CASE WHEN o_orderkey % 3 = 2 THEN 'day: soon' END AS note FROM orders""")
def edited_fields(spark, d):
    day = F.to_date("o_orderdate")
    base = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), s.format_minguo_date(day).alias("day"), F.date_add(day, 1).alias("next"))
    now = base.select("k", F.when(F.col("k") % 3 == 0, F.col("day")).when(F.col("k") % 3 == 1, s.format_minguo_date(F.col("next"))).otherwise("soon").alias("day"))
    return lookup.edited_fields(now, base, "k", "day", s.parse_minguo_date)


_ACTUAL = "act AS (SELECT doc_id, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS quality, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 0 END AS toxic FROM documents)"
_JOINED = f"WITH {_ACTUAL}, e AS (SELECT doc_id, 'quality' AS field, quality::VARCHAR AS expected FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels WHERE toxic IS NOT NULL), g AS (SELECT doc_id, 'quality' AS field, quality::VARCHAR AS actual FROM act UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM act), j AS (SELECT e.doc_id, e.field, expected, actual FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.field = g.field)"


@query(_JOINED + " SELECT * FROM j")
def answer_key_join(spark, d):
    docs = a.read(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("quality"), F.when(F.col("doc_id") % 9 != 0, 0).alias("toxic"))
    return lookup.answer_key_join(a.read(spark, d, "labels"), docs, "doc_id", ["quality", "toxic", "_note"])


@query(_JOINED + " SELECT doc_id, field, CASE WHEN doc_id % 10 = 1 OR actual IS NULL THEN 'unsure' WHEN expected = actual THEN 'correct' ELSE 'wrong' END AS score FROM j")
def score_fields(spark, d):
    return answer_key_join(spark, d).select("doc_id", "field", k.score_field(F.col("expected"), F.col("actual"), F.col("doc_id") % 10 == 1).alias("score"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey AS p, o_orderdate::DATE AS day FROM orders)
SELECT k, CASE WHEN p % 4 = 0 THEN 'unsure' WHEN p % 4 = 3 THEN 'wrong' ELSE 'correct' END AS number, CASE WHEN p % 5 = 0 THEN 'unsure' WHEN p % 5 = 1 THEN 'wrong' ELSE 'correct' END AS date,
  CASE WHEN p % 3 = 0 THEN 'unsure' WHEN p % 3 = 1 THEN 'correct' ELSE 'wrong' END AS category, CASE WHEN p % 7 = 0 THEN 'unsure' WHEN p % 7 = 1 THEN 'wrong' ELSE 'correct' END AS decision,
  CASE WHEN p % 11 = 0 THEN 'unsure' WHEN k % 2 <> p % 2 THEN 'wrong' WHEN p % 2 = 0 THEN 'correct' WHEN p % 3 = 0 THEN 'wrong' ELSE 'correct' END AS screening FROM x""")
def score_answers(spark, d):
    """Each kind of field against the answer key: spellings of one number, day, category or clause are the same answer."""
    p, day = F.col("o_custkey"), F.to_date("o_orderdate")
    key = F.concat(F.lit("字第41-"), p.cast("string"), F.lit("號"))
    number = F.when(p % 4 == 0, "未載明").when(p % 4 == 1, F.concat(F.lit("字第４１–"), p.cast("string"))).when(p % 4 == 2, F.concat(F.lit("字第 41~"), p.cast("string"), F.lit("號"))).otherwise(F.concat(F.lit("字第42-"), p.cast("string")))
    told = F.when(p % 5 == 0, "").when(p % 5 == 1, s.format_minguo_date(F.date_add(day, 1))).when(p % 5 == 2, s.format_minguo_date(day, "spaced")).otherwise(s.format_minguo_date(day, "short"))
    kind = F.when(p % 3 == 0, "未分類").when(p % 3 == 1, "廢棄物清理法").otherwise("違反廢棄物清理法第27條事件")
    draft = F.when(p % 7 == 0, " ").when(p % 7 == 1, "部分不受理部分駁回").otherwise("不受理")
    clause = F.when(p % 3 == 0, "77條第二款").when(p % 3 == 1, "訴願法第 77 條第 8 款").otherwise("77條第八款")
    screening = k.score_screening(F.col("o_orderkey") % 2 == 0, clause, F.when(p % 11 == 0, "to be confirmed"), p % 2 == 0, F.when(p % 2 == 1, "77(8)"))
    return a.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"),
        k.score_text(number, key).alias("number"),
        k.score_text(told, s.format_minguo_date(day), True).alias("date"),
        k.score_category(kind, F.lit("違反廢棄物清理法事件")).alias("category"),
        k.score_decision(draft, F.lit("不受理")).alias("decision"),
        screening.alias("screening"),
    )


@query(_JOINED + """, s AS (SELECT field, CASE WHEN doc_id % 10 = 1 OR actual IS NULL THEN 'unsure' WHEN expected = actual THEN 'correct' ELSE 'wrong' END AS score FROM j)
SELECT field, count(*) FILTER (score = 'correct') AS correct, count(*) FILTER (score = 'wrong') AS wrong, count(*) FILTER (score = 'unsure') AS unsure, count(*) AS total, round(count(*) FILTER (score = 'wrong') / count(*), 3) AS wrong_rate FROM s GROUP BY ROLLUP (field)""")
def tally(spark, d):
    return k.tally(score_fields(spark, d), "field", "score")


@query("""SELECT doc_id FROM documents WHERE NOT (doc_id % 2 = 0 AND md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 5 = 0))""")
def official_duplicate_anti_join(spark, d):
    docs = a.read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return lookup.official_anti_join(docs, docs.where("doc_id % 5 = 0"), "h", F.col("doc_id") % 2 == 0).select("doc_id")


@query("""WITH r AS (SELECT DISTINCT l_partkey AS k, 'Brand#' || (l_partkey % 25) AS kind FROM lineitem) SELECT k, CASE WHEN p_brand IS NULL THEN 'missing' ELSE 'other kind' END AS problem FROM r LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 > 0) ON p_partkey = k WHERE p_brand IS NULL OR p_brand <> kind""")
def consistency_check(spark, d):
    got = a.read(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.concat(F.lit("Brand#"), (F.col("l_partkey") % 25).cast("string")).alias("kind"))
    have = a.read(spark, d, "part").where("p_partkey % 7 > 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("kind"))
    return lookup.consistency_check(got, have, "k", "kind")


@query(with_("citations") + "SELECT case_id, law_id, pos FROM citations WHERE pos = 1")
def case_overview(spark, d):
    return k.case_overview(a.citations(spark, d), "case_id", "pos", ["law_id", "pos"])


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS "user", string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS assistant, list_sort(list(DISTINCT turn % 3)) AS marks FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0""")
def case_assembly(spark, d):
    rows = a.read(spark, d, "conversations").withColumn("mark", F.col("turn") % 3)
    return k.case_assembly(rows, "conv_id", "role", "turn", "text", ["user", "assistant"], "mark")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS full_text, list(turn ORDER BY turn) AS pages, count(*) AS chunks FROM conversations GROUP BY 1")
def document_grouping(spark, d):
    return k.document_grouping(a.read(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""WITH r AS (SELECT lang, source, quality::VARCHAR AS quality, trim(text) <> '' AS f FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS "column", lang AS value, count(*) AS n, count(*) FILTER (f) AS non_empty FROM r GROUP BY lang UNION ALL SELECT 'source', source, count(*), count(*) FILTER (f) FROM r GROUP BY source UNION ALL SELECT 'quality', quality, count(*), count(*) FILTER (f) FROM r GROUP BY quality""")
def corpus_profile(spark, d):
    rows = a.read(spark, d, "documents").join(a.read(spark, d, "labels"), "doc_id", "left")
    return k.corpus_profile(rows, ["lang", "source", "quality"], "text")


@query("SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return k.duplicate_keys(a.read(spark, d, "documents"), F.md5("text"))


@query("SELECT r_regionkey, 5 AS expected, coalesce(c, 0) AS actual, coalesce(c, 0) - 5 AS diff FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS c FROM nation WHERE n_nationkey % 6 > 0 GROUP BY 1) ON n_regionkey = r_regionkey")
def expected_count_check(spark, d):
    nation = a.read(spark, d, "nation").where("n_nationkey % 6 > 0").withColumnRenamed("n_regionkey", "r_regionkey")
    return k.expected_count_check(nation, a.read(spark, d, "region").withColumn("expected", F.lit(5)), "r_regionkey")


@query("SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL")
def facet_values(spark, d):
    return k.facet_values(a.read(spark, d, "part"), "p_type")


@query("SELECT conv_id, bool_or(role = 'system') AS has_role FROM conversations GROUP BY 1")
def any_role_flag(spark, d):
    return k.any_role(a.read(spark, d, "conversations"), "conv_id", "role", "system")


@query(r"""WITH x AS (SELECT conv_id, turn, text || ' 12/05/2024' AS r, replace(text, 'e', 'x') || CASE WHEN turn % 2 = 0 THEN ' 12/05/2024' ELSE '' END AS g FROM conversations), b AS (SELECT *, regexp_replace(r, '\s+', '', 'g') AS rb, regexp_replace(g, '\s+', '', 'g') AS gb FROM x)
SELECT conv_id * 100 + turn AS k, levenshtein(rb, gb)::INT AS edits, length(rb)::INT AS length, levenshtein(rb, gb) / length(rb) AS rate, 1 AS dates, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS found FROM b""")
def text_error_rates(spark, d):
    day = F.lit(" 12/05/2024")
    rows = a.read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.concat("text", day).alias("r"), F.concat(F.replace("text", F.lit("e"), F.lit("x")), F.when(F.col("turn") % 2 == 0, day).otherwise("")).alias("g"))
    return k.text_error_rates(rows, "k", "r", "g", "[0-9]{2}/[0-9]{2}/[0-9]{4}")


@query("SELECT 'd' || doc_id AS id, 'document' AS origin, lang AS kind, length(text)::INT AS size FROM documents UNION ALL SELECT 'p' || page_id, 'page', NULL, length(html)::INT FROM pages")
def corpus_union(spark, d):
    docs = a.read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("document").alias("origin"), F.col("lang").alias("kind"), F.length("text").alias("size"))
    pages = a.read(spark, d, "pages").select(F.length("html").alias("size"), F.lit("page").alias("origin"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"))
    return k.corpus_union(docs, pages)


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderdate, o_orderstatus FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderkey % 40 = 1)
SELECT 'unexpected' AS problem, k::VARCHAR AS key FROM (SELECT DISTINCT k FROM r) WHERE k NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'missing', k::VARCHAR FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) WHERE k NOT IN (SELECT k FROM r)
UNION ALL SELECT 'duplicate', k::VARCHAR FROM r GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'held out', k::VARCHAR FROM r WHERE year(o_orderdate) = 1999 UNION ALL SELECT 'excluded role', k::VARCHAR FROM r WHERE o_orderstatus = 'P' UNION ALL SELECT 'no source', k::VARCHAR FROM r WHERE k % 7 = 0""")
def corpus_assertions(spark, d):
    o = a.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", "o_orderstatus")
    rows = o.where("k % 4 > 0").unionByName(o.where("k % 40 = 1"))
    wanted = a.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return k.corpus_assertions(rows, wanted, "k", F.year("o_orderdate") == 1999, F.col("o_orderstatus") == "P", F.col("k") % 7 != 0)


@query(with_("citations") + """, f AS (SELECT case_id, law_id, min(pos) AS p FROM citations GROUP BY 1, 2), c AS (SELECT case_id, list(law_id ORDER BY p) AS all_ids FROM f GROUP BY 1)
SELECT case_id, all_ids, list_filter(all_ids, lambda x: x % 2 = 0) AS allowed FROM c""")
def ordered_set_ops(spark, d):
    ids = a.citations(spark, d).groupBy("case_id").agg(k.in_order(F.col("pos"), F.col("law_id")).alias("x"))
    union = k.ordered_union(F.slice("x", 1, 2), F.col("x"))
    even = F.filter("x", lambda v: v % 2 == 0)
    return ids.select("case_id", union.alias("all_ids"), k.ordered_allowed(union, even).alias("allowed"))
