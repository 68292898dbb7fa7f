"""Retrieval: filtered vector legs, fusion, reranking, lookups and appended citations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.functions import scalars
from casegrid.operators import lookup, rank, vectors
from casegrid.operators.page_index import PageIndex
from casegrid.registry import query
from casegrid.storage import materialize, scratch_path, parted

from . import adapters as a
from .adapters import with_


#: SQL over the hits and the fused ranking of either pair of legs.
_BEST = """, b AS (SELECT query_id, entity, id, score, leg, row_number() OVER (PARTITION BY query_id, entity ORDER BY score DESC, leg, rank) AS r FROM hits)
SELECT query_id, entity, id, score, leg::INT AS leg FROM b WHERE r = 1"""
_RERANKED = """, e AS (SELECT query_id, entity AS id, rank AS pos FROM fused), x AS (SELECT query_id, id, min(ext) AS ext FROM (SELECT query_id, id, (id * 7919) % 101 AS ext FROM e WHERE id % 2 = 0 AND query_id % 300 > 0) GROUP BY 1, 2)
SELECT query_id, id, rank, reranked FROM (SELECT e.query_id, e.id, row_number() OVER (PARTITION BY e.query_id ORDER BY ext NULLS LAST, pos) AS rank, coalesce(bool_or(ext IS NOT NULL) OVER (PARTITION BY e.query_id), false) AS reranked
  FROM e LEFT JOIN x ON e.query_id = x.query_id AND e.id = x.id) WHERE rank <= 5"""


def _legs(spark, d):
    """Top 100 of two legs: (query_id, id, score, rank, leg, entity). Each leg has the chunks of some kinds, and every chunk
    is in one."""
    corpus, asked = a.chunk_vectors(spark, d), a.query_vectors(spark, d)
    high = F.coalesce(F.col("kind") >= 5, F.lit(False))
    legs = [rank.vector_topk(asked, corpus, 100, keep).withColumn("leg", F.lit(leg)) for leg, keep in enumerate((~high, high))]
    return legs[0].unionByName(legs[1]).withColumn("entity", F.floor(F.col("id") / 5))


def _whole_legs(spark, d):
    """_legs with a query vector for each leg, both over the whole corpus, so a vector can be in both."""
    legs = [rank.vector_topk(a.leg_vectors(spark, d, leg), a.chunk_vectors(spark, d), 100).withColumn("leg", F.lit(leg)) for leg in (0, 1)]
    return legs[0].unionByName(legs[1]).withColumn("entity", F.floor(F.col("id") / 5))


@query(with_("scored") + "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE kind <> 3) WHERE rank <= 25")
def vector_topk(spark, d):
    return rank.vector_topk(a.query_vectors(spark, d), a.chunk_vectors(spark, d), 25, F.col("kind") != 3)


@query(with_("scored", "legs", "entities") + "SELECT * FROM entities")
def entity_rank_dedup(spark, d):
    return rank.entity_rank_dedup(_legs(spark, d), "entity", ["query_id", "leg"])


@query(with_("scored", "legs", "entities", "fused") + "SELECT query_id, entity, score, rank FROM fused")
def rrf_fuse(spark, d):
    return rank.rrf_fuse(entity_rank_dedup(spark, d), "entity", ["query_id"])


@query(with_("scored", "legs") + _BEST)
def best_chunk(spark, d):
    return rank.best_chunk(_legs(spark, d), "entity", ["query_id"], "id")


@query("""SELECT vec_id, label FROM embeddings WHERE label IN (1, 2, 3, 4) AND label <> 2 AND label IS DISTINCT FROM 4""")
def metadata_filter(spark, d):
    spec = {"andAll": [{"in": ["label", [1, 2, 3, 4]]}, {"notEquals": ["label", 2]}, {"distinct": ["label", 4]}]}
    return a.read(spark, d, "embeddings").where(rank.metadata_filter(spec)).select("vec_id", "label")


@query("""WITH x AS (SELECT event_id, event_type AS t, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT event_id, CASE WHEN event_id % 5 > 0 THEN 't-' || t END AS type, CASE WHEN event_id % 4 > 0 THEN k::VARCHAR END AS k FROM x
WHERE event_id % 5 > 0 AND t <> 'click' AND (event_id % 4 = 0 OR k <> 69) AND event_id % 3 IN (0, 2)""")
def metadata_filter_variant(spark, d):
    """Filters on typed paths of the events' metadata, which lacks some paths and has some of another type."""
    n = F.col("event_id")
    inner = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), (n % 3).alias("third")))
    text = F.concat(F.lit('{"case type": '), F.when(n % 5 > 0, F.concat(F.lit('"t-'), F.col("event_type"), F.lit('"'))).otherwise("17"), F.when(n % 4 > 0, F.concat(F.lit(', "in": '), inner)).otherwise(F.concat(F.lit(', "in": {"k": "69", "third": '), (n % 3).cast("string"), F.lit("}"))), F.lit("}"))
    rows = a.read(spark, d, "events").select("event_id", scalars.metadata(text).alias("m"))
    spec = {"andAll": [{"notEquals": ["case type", "t-click"]}, {"distinct": ["in.k", 69]}, {"in": ["in.third", [0, 2]]}]}
    kept = rows.where(rank.metadata_filter(spec, F.col("m"))).withColumn("typed", rank.metadata_value(F.col("m"), "in.k", 0))
    attributes = scalars.metadata_attributes(F.col("m"), ["case type", "nothing"])
    return kept.select("event_id", attributes["case type"].alias("type"), F.col("typed").cast("string").alias("k"))


@query(with_("scored") + """, t AS (SELECT *, CASE WHEN kind = query_id // 100 % 12 AND score > 0.25 THEN 0 WHEN kind = query_id // 100 % 12 THEN 1 ELSE 2 END AS tier FROM scored),
b AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b WHERE tier = best)
SELECT query_id, id, score, tier, rank FROM r WHERE rank <= 15""")
def fallback_tiers(spark, d):
    corpus, asked = a.chunk_vectors(spark, d).withColumn("attr", F.col("kind")), a.query_vectors(spark, d)

    def tier(query: np.ndarray, kind: np.ndarray, score: np.ndarray) -> np.ndarray:
        same = kind == query // 100 % 12
        return np.where(same & (score > 0.25), 0, np.where(same, 1, 2))

    hits = vectors.block_group_topk(asked, corpus, 15, tier).withColumnRenamed("grp", "t")
    tagged = rank.fallback_tiers(hits, [F.col("t") == 0, F.col("t") == 1, None], ["query_id"])
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return tagged.withColumn("rank", F.row_number().over(order)).where("rank <= 15").select("query_id", "id", "score", "tier", "rank")


@query(with_("scored") + """, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 30),
t AS (SELECT h.*, substr(text, 1, 40) AS txt, row_number() OVER (PARTITION BY query_id, entity ORDER BY score DESC, rank) AS r FROM h LEFT JOIN documents ON doc_id = id),
g AS (SELECT query_id, entity, round(sum(score), 6) AS total, min(rank) AS f, coalesce(string_agg(txt, chr(10) ORDER BY r) FILTER (r <= 2), '') AS text FROM t GROUP BY 1, 2)
SELECT * EXCLUDE (f) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, f) AS rank FROM g) WHERE rank <= 10""")
def document_score_sum(spark, d):
    hits = rank.vector_topk(a.query_vectors(spark, d), a.chunk_vectors(spark, d), 30).withColumn("entity", F.floor(F.col("id") / 5))
    hits = materialize(hits, "hits")
    texts = a.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(rank.small(hits.select("id").distinct()), "id")
    return rank.document_score_sum(hits.join(texts, "id", "left"), "entity", ["query_id"], "text")


@query(with_("citations", "docket") + """, c AS (SELECT party AS grp, law_id, row_number() OVER (PARTITION BY party ORDER BY d.case_id, pos) AS p FROM docket d JOIN citations c ON d.case_id = c.case_id),
f AS (SELECT grp, law_id, count(*) AS n, min(p) AS first_pos FROM c GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, first_pos) AS rank FROM f""")
def candidate_frequency(spark, d):
    cited = a.docket(spark, d).join(a.citations(spark, d), "case_id").select("party", "case_id", "pos", "law_id")
    dealt = parted(cited, a.read(spark, d, "lineitem").count(), "party")
    placed = dealt.select(F.col("party").alias("grp"), "law_id", F.row_number().over(W.partitionBy("party").orderBy("case_id", "pos")).cast("long").alias("p"))
    return rank.candidate_frequency(placed, "law_id", ["grp"], "p")


@query(with_("scored") + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, entity ORDER BY score DESC, id) AS dup FROM scored)
SELECT query_id, kind, entity, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS rank FROM o WHERE dup = 1) WHERE rank <= 3""")
def per_kind_topk(spark, d):
    corpus, asked = a.chunk_vectors(spark, d).withColumn("attr", F.col("kind")), a.query_vectors(spark, d)
    found = vectors.block_group_topk(asked, corpus, 3, lambda query, kind, score: kind, "entity")
    hits = found.select("query_id", "id", F.col("name").alias("entity"), F.col("grp").alias("kind"), "score", F.lit(0).alias("rank"))
    return rank.per_kind_topk(hits, "kind", ["query_id"], 3, "entity").select("query_id", "kind", "entity", "id", "score", "rank")


def _rerank(fused):
    candidates = fused.select("query_id", F.col("entity").alias("id"), F.col("rank").alias("pos"))
    ext = candidates.where("id % 2 = 0 AND query_id % 300 > 0").select("query_id", "id", ((F.col("id") * 7919) % 101).alias("ext"))
    return rank.rerank_merge(candidates, ext.unionByName(ext), ["query_id"], 5)


@query(with_("scored", "legs", "entities", "fused") + _RERANKED)
def rerank_merge(spark, d):
    return _rerank(rrf_fuse(spark, d))


@query(with_("scored", "whole_legs", "entities") + "SELECT * FROM entities")
def entity_rank_dedup_whole(spark, d):
    return rank.entity_rank_dedup(_whole_legs(spark, d), "entity", ["query_id", "leg"])


@query(with_("scored", "whole_legs", "entities", "fused") + "SELECT query_id, entity, score, rank FROM fused")
def rrf_fuse_whole(spark, d):
    return rank.rrf_fuse(entity_rank_dedup_whole(spark, d), "entity", ["query_id"])


@query(with_("scored", "whole_legs") + _BEST)
def best_chunk_whole(spark, d):
    return rank.best_chunk(_whole_legs(spark, d), "entity", ["query_id"], "id")


@query(with_("scored", "whole_legs", "entities", "fused") + _RERANKED)
def rerank_merge_whole(spark, d):
    return _rerank(rrf_fuse_whole(spark, d))


@query(with_("citations") + """, p AS (SELECT *, law_id % 3 = 0 AS pinned FROM citations), q AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pinned DESC, pos) AS quota FROM p)
SELECT case_id, pos, law_id, pinned, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS shown FROM q WHERE quota <= 3""")
def pinned_cap(spark, d):
    return rank.pinned_cap(a.citations(spark, d).withColumn("pinned", F.col("law_id") % 3 == 0), ["case_id"], "pos", "pinned", 3)


@query(with_("articles") + """, known AS (SELECT law_key, law_id AS id FROM articles WHERE law_id % 2 = 0), cache AS (SELECT law_key, 1000000 + law_id AS id FROM articles WHERE law_id % 2 = 1 AND law_id % 5 = 0),
fresh AS (SELECT * FROM articles WHERE law_id % 2 = 1 AND law_id % 5 <> 0), top AS (SELECT greatest((SELECT max(id) FROM known), (SELECT max(id) FROM cache)) AS t)
SELECT law_key, id FROM cache UNION ALL SELECT law_key, t + row_number() OVER (ORDER BY law_name, article_no) FROM fresh, top""")
def append_only_ids(spark, d):
    rows = materialize(a.articles(spark, d), "articles")
    known = rows.where("law_id % 2 = 0").select("law_key", F.col("law_id").alias("id"))
    cache = rows.where("law_id % 2 = 1 AND law_id % 5 = 0").select("law_key", (F.col("law_id") + 1000000).alias("id"))
    return rank.append_only_ids(known, rows.where("law_id % 2 = 1"), "law_key", [F.col("law_name"), F.col("article_no")], cache)


@query(with_("articles") + """SELECT law_key, row_number() OVER (ORDER BY law_id >= 10, law_name, article_no) AS id FROM articles""")
def full_id_assignment(spark, d):
    return rank.full_ids(a.articles(spark, d), "law_key", [F.col("law_id") >= 10, F.col("law_name"), F.col("article_no")])


@query(with_("articles") + """SELECT law_key, law_id FROM articles WHERE article_no > 5 ORDER BY md5('seed-1' || law_key), law_key LIMIT 20""")
def deterministic_sample(spark, d):
    return rank.deterministic_sample(a.articles(spark, d).where("article_no > 5"), "law_key", 20, "seed-1").select("law_key", "law_id")


@query("""WITH v AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'user' ELSE role END AS role FROM conversations)),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age, count(*) OVER (PARTITION BY conv_id) > 2 AS dropped FROM v WHERE n = 1 OR role IS DISTINCT FROM l)
SELECT conv_id, turn, role, age, dropped FROM c WHERE age <= 2""")
def version_retention(spark, d):
    turns = a.read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "user").otherwise(F.col("role")).alias("role"))
    return rank.version_retention(turns, "conv_id", "turn", "role", 2)


@query(with_("docket") + """, p AS (SELECT case_id, created, status, CASE status WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS progress_order FROM docket),
n AS (SELECT *, row_number() OVER (ORDER BY created DESC, progress_order, case_id) AS position FROM p) SELECT *, 3 AS page FROM n WHERE position > 40 AND position <= 60""")
def case_list_page(spark, d):
    cases = a.docket(spark, d).select("case_id", "created", "status")
    progress = F.when(F.col("status") == "P", 0).when(F.col("status") == "O", 1).otherwise(2)
    return rank.list_page(cases, "created", progress, "case_id", 3)


@query(with_("docket") + """, p AS (SELECT case_id, created, status, CASE status WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS progress_order FROM docket),
n AS (SELECT *, row_number() OVER (ORDER BY created DESC, progress_order, case_id) AS position FROM p) SELECT *, 3 AS page FROM n WHERE position > 40 AND position <= 60""")
def case_list_page_index(spark, d):
    """The same page from an index of the list's ranges."""
    progress = F.when(F.col("status") == "P", 0).when(F.col("status") == "O", 1).otherwise(2)
    cases = a.docket(spark, d).select("case_id", "created", "status", progress.alias("progress_order"))
    index = PageIndex(spark, scratch_path(spark, "pages"), [F.desc("created"), F.col("progress_order"), F.col("case_id")]).build(cases)
    return index.page(3)


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def carry_forward(spark, d):
    rows = a.read(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "signup", F.col("value")))
    return rows.select("event_id", "user_id", rank.carry_forward(rows, ["user_id"], ["ts", "event_id"], "v").alias("carried"))


@query("""SELECT code, row_number() OVER (ORDER BY a, b NULLS FIRST, code) AS place FROM (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_size || '-' || (p_partkey % 12) ELSE p_size::VARCHAR END AS code, p_size AS a, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 12 END AS b FROM part)""")
def numeric_code_sort(spark, d):
    size = F.col("p_size").cast("string")
    codes = a.read(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("-", size, (F.col("p_partkey") % 12).cast("string"))).otherwise(size).alias("code")).distinct()
    return rank.code_places(codes, "code")


@query("""WITH m AS (SELECT *, event_type = 'signup' AS rerun, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM events),
c AS (SELECT *, max(seg) OVER (PARTITION BY user_id) AS newest FROM m)
SELECT user_id, arg_max(value, event_id) AS current, CASE WHEN bool_or(NOT rerun) THEN any_value(s) ELSE arg_max(value, event_id) END AS system, bool_or(NOT rerun) AS overridden
FROM (SELECT *, first_value(prev) OVER (PARTITION BY user_id ORDER BY rerun, event_id) AS s FROM c WHERE seg = newest) GROUP BY user_id""")
def override_ledger(spark, d):
    return rank.override_ledger(a.read(spark, d, "events"), ["user_id"], "event_id", "value", F.col("event_type") == "signup")


@query(with_("citations", "articles") + """SELECT c.case_id, c.pos - 1 AS pos, c.law_id, coalesce(a.text, '未收錄') AS text, a.text IS NOT NULL AS found FROM citations c LEFT JOIN articles a ON c.law_id = a.law_id""")
def exact_key_lookup(spark, d):
    asked = a.citations(spark, d).groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "law_id"))), lambda x: x["law_id"]).alias("keys"))
    return lookup.exact_key_lookup(asked, "case_id", "keys", a.articles(spark, d), "law_id", "text")


@query(with_("citations", "articles") + """SELECT law_id, law_name, article_no, law_key, text, true AS found FROM articles WHERE law_id IN (SELECT law_id FROM citations)""")
def dimension_hydrate(spark, d):
    return lookup.dimension_hydrate(a.citations(spark, d), "law_id", a.articles(spark, d))


@query(with_("citations", "docket", "articles") + """, f AS (SELECT category, law_id, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, law_id) AS rank FROM docket d JOIN citations c ON d.case_id = c.case_id GROUP BY 1, 2)
SELECT category, law_id, law_key FROM f JOIN articles USING (law_id) WHERE rank <= 50""")
def candidate_semi_join(spark, d):
    counted = a.docket(spark, d).join(a.citations(spark, d), "case_id").groupBy("category", "law_id").count()
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("category").orderBy(F.desc("count"), "law_id")))
    return lookup.candidate_semi_join(a.articles(spark, d), "law_id", ranked, "category").select("category", "law_id", "law_key")


@query(with_("citations", "articles") + """, r AS (SELECT case_id, law_id, min(pos) AS pos FROM citations WHERE pos <= 2 GROUP BY 1, 2), x AS (SELECT case_id, law_id, min(pos) AS pos FROM citations GROUP BY 1, 2),
u AS (SELECT *, 0 AS leg FROM r UNION ALL SELECT x.*, 1 FROM x WHERE law_id IN (SELECT law_id FROM articles) AND NOT EXISTS (SELECT 1 FROM r WHERE r.case_id = x.case_id AND r.law_id = x.law_id))
SELECT case_id, law_id, row_number() OVER (PARTITION BY case_id ORDER BY leg, pos, law_id) AS pos, leg = 1 AS appended FROM u""")
def append_cited(spark, d):
    cited = a.citations(spark, d)
    ranked = cited.where("pos <= 2").groupBy("case_id", "law_id").agg(F.min("pos").alias("pos"))
    return lookup.append_cited(ranked, cited, a.articles(spark, d), "case_id", "law_id")
