"""Ranking: vector top-k, entity ranking, rank fusion, reranking, quotas and id assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.functions.scalars import once
from casegrid.storage import numbered

from .vectors import block_topk

#: Rows of a query table that may be broadcast; beyond that Spark chooses the join itself.
BROADCAST_ROWS = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is checked to have so few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in doubles; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): each query's k most similar vectors other than itself; ties to the smaller id.

    queries: (query_id, query_vec), a stated set; corpus: (id, vec, ...), ids being integers. keep filters the corpus before
    similarities are computed. Both sides are scored in blocks (vectors.block_topk); the k best of each block are merged.
    """
    rows = corpus if keep is None else corpus.where(keep)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return block_topk(queries, rows, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def entity_rank_dedup(hits: DataFrame, entity: str, by: list[str]) -> DataFrame:
    """Rank of entities by the first of their hits: by, entity, rank."""
    first = hits.groupBy(*by, entity).agg(F.min("rank").alias("first_rank"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("first_rank"))).drop("first_rank")


def rrf_fuse(rankings: DataFrame, entity: str, by: list[str], k: int = 60, n: int | None = 25) -> DataFrame:
    """Reciprocal rank fusion over legs: sum of 1 / (k + rank), rank from 1; ties to the earlier leg, then rank.

    rankings: by, leg, entity, rank. A leg without the entity adds nothing.
    """
    summed = rankings.groupBy(*by, entity).agg(F.sum(1 / (k + F.col("rank"))).alias("raw"), F.min(F.struct("leg", "rank")).alias("seen"))
    summed = summed.withColumn("score", F.round("raw", 9))
    order = W.partitionBy(*by).orderBy(F.desc("score"), "seen.leg", "seen.rank")
    fused = summed.withColumn("rank", F.row_number().over(order))
    return (fused if n is None else fused.where(F.col("rank") <= n)).select(*by, entity, "score", "rank")


def metadata_filter(spec: dict | None, metadata: Column | None = None) -> Column:
    """A filter from its spec; of metadata, a VARIANT (see scalars.metadata), fields are paths in it.

    A path's values are compared as the spec's value is typed: text, whole number, number or boolean; a value that isn't
    of that type counts as missing, as a path that isn't there. Only "distinct" passes what is missing. "in" of no values
    passes nothing. A dot parts the names of a path.
    """
    if metadata is not None:
        return once(metadata, lambda m: _filter(spec, m))  # a text that is parsed in metadata's place is parsed once
    return _filter(spec, None)


def _filter(spec: dict | None, metadata: Column | None) -> Column:
    if not spec:
        return F.lit(True)
    ((kind, value),) = spec.items()
    if kind == "andAll":
        out = F.lit(True)
        for s in value:
            out = out & _filter(s, metadata)
        return out
    key, wanted = value
    sample = wanted if kind != "in" else next(iter(wanted), "")
    c = F.col(key) if metadata is None else metadata_value(metadata, key, sample)
    return {"equals": lambda: c == wanted, "notEquals": lambda: c != wanted, "in": lambda: c.isin(*wanted), "distinct": lambda: ~c.eqNullSafe(F.lit(wanted))}[kind]()


def metadata_value(metadata: Column, key: str, sample: object) -> Column:
    """The value of a VARIANT at a path, if it is of sample's type; else null."""
    names = "".join(f"['{name}']" for name in key.split("."))
    raw = F.try_variant_get(metadata, f"${names}", "variant")
    kind = F.schema_of_variant(raw)
    if isinstance(sample, bool):
        type_, fits = "boolean", kind == "BOOLEAN"
    elif isinstance(sample, str):
        type_, fits = "string", kind == "STRING"
    else:
        type_, fits = "bigint" if isinstance(sample, int) else "double", kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")
        # A number with a fraction isn't a whole one, though a cast would make it one.
        whole = F.try_variant_get(metadata, f"${names}", "double")
        fits = fits & (whole == F.floor(whole)) if isinstance(sample, int) else fits
    return F.when(fits, F.try_variant_get(metadata, f"${names}", type_))


def fallback_tiers(hits: DataFrame, tiers: list[Column | None], by: list[str]) -> DataFrame:
    """Hits of the first tier that has any, for each query: one pass tags every hit with the first tier that it meets."""
    tier = F.coalesce(*[F.when(F.lit(True) if t is None else t, F.lit(i)) for i, t in enumerate(tiers)])
    tagged = hits.withColumn("tier", tier).where(F.col("tier").isNotNull())
    return tagged.withColumn("best", F.min("tier").over(W.partitionBy(*by))).where(F.col("tier") == F.col("best")).drop("best")


def document_score_sum(hits: DataFrame, doc: str, by: list[str], text: str, n: int = 10, best: int = 2, clip: int = 40) -> DataFrame:
    """Sum of a document's hit scores, the n largest, with the text of its best hits clipped."""
    parts = F.slice(F.sort_array(F.collect_list(F.struct(F.col("score").alias("s"), (-F.col("rank")).alias("r"), F.col(text).alias("t"))), asc=False), 1, best)
    grouped = hits.groupBy(*by, doc).agg(F.round(F.sum("score"), 6).alias("total"), F.min("rank").alias("first_rank"), F.array_join(F.transform(parts, lambda p: F.substring(p["t"], 1, clip)), "\n").alias("text"))
    order = W.partitionBy(*by).orderBy(F.desc("total"), "first_rank")
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("first_rank")


def best_chunk(hits: DataFrame, entity: str, by: list[str], value: str) -> DataFrame:
    """The hit with the highest score of each entity over all legs; the first seen wins ties."""
    top = F.max_by(F.struct(value, "score", "leg"), F.struct("score", -F.col("leg"), -F.col("rank"))).alias("top")
    return hits.groupBy(*by, entity).agg(top).select(*by, entity, "top.*")


def candidate_frequency(cited: DataFrame, key: str, by: list[str], pos: str) -> DataFrame:
    """How often each key is cited, most often first, then by first appearance."""
    found = cited.groupBy(*by, key).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "first_pos")))


def per_kind_topk(hits: DataFrame, kind: str, by: list[str], n: int, name: str) -> DataFrame:
    """The n best of each kind, each name once at its best."""
    once = hits.withColumn("dup", F.row_number().over(W.partitionBy(*by, kind, name).orderBy(F.desc("score"), "id"))).where(F.col("dup") == 1).drop("dup", "rank")
    return once.withColumn("rank", F.row_number().over(W.partitionBy(*by, kind).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)


def rerank_merge(candidates: DataFrame, ranks: DataFrame, by: list[str], n: int) -> DataFrame:
    """Candidates (by, id, pos) in the order of external ranks (by, id, ext): known ids, first mention; the rest after them
    in their own order; cut to n. reranked is false where no external id was known."""
    known = ranks.groupBy(*by, "id").agg(F.min("ext").alias("ext"))
    merged = candidates.join(known, [*by, "id"], "left")
    order = W.partitionBy(*by).orderBy(F.col("ext").asc_nulls_last(), "pos")
    out = merged.withColumns({"rank": F.row_number().over(order), "reranked": F.max(F.col("ext").isNotNull()).over(W.partitionBy(*by))})
    return out.where(F.col("rank") <= n).select(*by, "id", "rank", "reranked")


def pinned_cap(rows: DataFrame, by: list[str], pos: str, pinned: str, n: int) -> DataFrame:
    """At most n rows a group: pinned ones first, but shown in their original order."""
    quota = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(pinned), pos))
    kept = rows.withColumn("quota", quota).where(F.col("quota") <= n).drop("quota")
    return kept.withColumn("shown", F.row_number().over(W.partitionBy(*by).orderBy(pos)))


def numeric_code_key(code: Column) -> Column:
    """A sort key for codes like 27-1: their parts as numbers."""
    return F.transform(F.split(code, "-"), lambda x: x.try_cast("int"))


def append_only_ids(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column], cache: DataFrame | None = None) -> DataFrame:
    """(key, id) of new keys: cached ids stay; other keys follow the largest id used so far, in the given order.

    existing: (key, id). New keys are numbered by ranges of their order, so no task has to hold them all.
    """
    new = incoming.join(existing.select(key), key, "left_anti")
    known = existing.select("id") if cache is None else existing.select("id").union(cache.select("id"))
    top = known.agg(F.max("id")).first()[0] or 0
    cached = new.limit(0).select(key).withColumn("id", F.lit(0).cast("long")) if cache is None else new.join(cache, key).select(key, "id")
    fresh = new if cache is None else new.join(cache.select(key), key, "left_anti")
    return cached.unionByName(numbered(fresh, order, "id", top + 1).select(key, "id"))


def full_ids(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """(key, id): all keys numbered from 1 in the given order."""
    return numbered(rows, order, "id").select(key, "id")


def code_places(codes: DataFrame, code: str) -> DataFrame:
    """(code, place): codes like 27-1 in the order of their numbers."""
    return numbered(codes.withColumn("code_key_", numeric_code_key(F.col(code))), ["code_key_", code], "place").select(code, "place")


def deterministic_sample(pool: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows of the pool by a hash of seed and key; fails if there are fewer."""
    have = pool.agg(F.count("*").alias("have"))
    checked = pool.crossJoin(F.broadcast(have)).where(F.when(F.col("have") >= n, F.lit(True)).otherwise(F.raise_error(F.lit("the pool is smaller than the sample")).cast("boolean"))).drop("have")
    return checked.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def version_retention(versions: DataFrame, by: str, order: str, content: str, most: int = 20) -> DataFrame:
    """Versions that differ from the one before; the newest of them, and whether older ones were dropped."""
    w = W.partitionBy(by).orderBy(order)
    changed = versions.withColumn("last", F.lag(content).over(w)).withColumn("first", F.row_number().over(w) == 1)
    changed = changed.where(F.col("first") | ~F.col("last").eqNullSafe(F.col(content))).drop("last", "first")
    age = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    return changed.withColumns({"age": age, "dropped": F.count("*").over(W.partitionBy(by)) > most}).where(F.col("age") <= most)


def list_page(cases: DataFrame, created: str, progress: Column, key: str, page: int, size: int = 20) -> DataFrame:
    """One page of cases, newest first and then by progress; a page beyond the last is the last. Only the rows up to the
    page's end are put in order, by a top-k; the window sees no more than those."""
    last = max(1, -(-cases.count() // size))
    page = min(max(page, 1), last)
    order = [F.desc(created), F.col("progress_order"), F.col(key)]
    head = cases.withColumn("progress_order", progress).orderBy(*order).limit(page * size)
    numbered = head.withColumns({"position": F.row_number().over(W.orderBy(*order)), "page": F.lit(page)})
    return numbered.where(F.col("position") > (page - 1) * size)


def carry_forward(rows: DataFrame, by: list[str], order: list[str], value: str) -> Column:
    """The last value that isn't null, up to this row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def override_ledger(edits: DataFrame, by: list[str], order: str, value: str, rerun: Column) -> DataFrame:
    """From an edit log: the current value, the value before the first edit since the last rerun, whether it was edited since.

    A rerun row sets the system's own value.
    """
    w = W.partitionBy(*by).orderBy(order)
    marked = edits.withColumns({"is_rerun": rerun, "prev": F.lag(value).over(w), "segment": F.sum(rerun.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))})
    current = marked.withColumn("newest", F.max("segment").over(W.partitionBy(*by))).where(F.col("segment") == F.col("newest"))
    own = F.when(F.max(~F.col("is_rerun")), F.min_by(F.when(~F.col("is_rerun"), F.struct(F.col("prev").alias("v"))), F.when(~F.col("is_rerun"), F.col(order)))["v"]).otherwise(F.max_by(value, order))
    return current.groupBy(*by).agg(F.max_by(value, order).alias("current"), own.alias("system"), F.max(~F.col("is_rerun")).alias("overridden"))
