"""Lookups and checks between tables: ordered key lookup, hydration, sync planning, staleness, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MISSING = "未收錄"


def exact_key_lookup(requests: DataFrame, by: str, keys: str, table: DataFrame, key: str, text: str) -> DataFrame:
    """(by, pos, key, text, found) for each requested key in its order; a placeholder where the table lacks the key."""
    asked = requests.select(by, F.posexplode(keys).alias("pos", key))
    joined = asked.join(table.select(key, F.col(text).alias("hit")), key, "left")
    return joined.select(by, "pos", key, F.coalesce("hit", F.lit(MISSING)).alias("text"), F.col("hit").isNotNull().alias("found"))


def dimension_hydrate(rows: DataFrame, key: str, table: DataFrame, keep_missing: bool = False) -> DataFrame:
    """rows' distinct keys with their details. Missing ones are dropped or kept with found = false; that none of any rows
    is found is an error."""
    ids = rows.select(key).where(F.col(key).isNotNull()).distinct()
    joined = ids.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    counts = joined.agg(F.count("*").alias("asked_"), F.count_if("found").alias("hits_"))
    good = F.when((F.col("asked_") > 0) & (F.col("hits_") == 0), F.raise_error(F.lit("no id of this lookup is in the table")).cast("boolean")).otherwise(F.lit(True))
    checked = joined.crossJoin(F.broadcast(counts)).where(good).drop("asked_", "hits_")
    return checked if keep_missing else checked.where("found")


def candidate_semi_join(corpus: DataFrame, id_col: str, candidates: DataFrame, by: str, cap: int = 50) -> DataFrame:
    """corpus rows for each query that are among its cap most frequent candidates. candidates: (by, id_col, rank)."""
    return corpus.join(candidates.where(F.col("rank") <= cap).select(by, id_col), id_col)


def existing_key_split(incoming: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with new keys, number of rows with known ones)."""
    known = existing.select(key).distinct()
    return incoming.join(known, key, "left_anti"), incoming.join(known, key, "left_semi").agg(F.count("*").alias("overlap"))


def sync_plan(index: DataFrame, wanted: DataFrame, key: str, status: str, delete: bool) -> DataFrame:
    """(key, action): delete_stale for what the corpus lacks (keep_stale if deletion isn't allowed), retry_failed, submit, skip."""
    joined = index.select(key, status).join(wanted.select(key, F.lit(True).alias("wanted_")), key, "full_outer")
    action = (
        F.when(F.col("wanted_").isNull(), F.lit("delete_stale" if delete else "keep_stale"))
        .when(F.col(status).isNull(), "submit")
        .when(F.col(status) == "FAILED", "retry_failed")
        .otherwise("skip")
    )
    return joined.select(key, status, action.alias("action"))


def pending_rows(rows: DataFrame, index: DataFrame, key: str, status: str, done: tuple[str, ...] = ("INDEXED", "IN_PROGRESS")) -> DataFrame:
    """rows whose key the index doesn't hold as done."""
    return rows.join(index.where(F.col(status).isin(*done)).select(key), key, "left_anti")


def snapshot_staleness(now: DataFrame, used: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, stale): whether the snapshot that was used differs in any column; not stale where either is missing."""
    other = used.select(key, *[F.col(c).alias(f"u_{c}") for c in columns], F.lit(True).alias("u_"))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"u_{c}"))
    return now.join(other, key, "left").select(key, (F.col("u_").isNotNull() & differs).alias("stale"))


def edited_fields(now: DataFrame, base: DataFrame, key: str, field: str, parse) -> DataFrame:
    """(key, adopted, note): an edited value that parses is adopted, one that doesn't is noted, others are ignored."""
    joined = now.join(base.select(key, F.col(field).alias("base_")), key, "left")
    edited = ~F.col(field).eqNullSafe(F.col("base_"))
    value = parse(F.col(field))
    return joined.select(key, F.when(edited, value).alias("adopted"), F.when(edited & value.isNull(), F.concat(F.lit(f"{field}: "), F.coalesce(field, F.lit("")))).alias("note"))


def answer_key_join(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, expected, actual) of every expected value that isn't null; names that begin with _ aren't scored."""
    scored = [f for f in fields if not f.startswith("_")]
    unknown = [f for f in scored if f not in actual.columns]
    if unknown:
        raise ValueError(f"no such fields: {unknown}")
    text = lambda df: df.select(key, *[F.col(f).cast("string").alias(f) for f in scored])
    want = text(expected).unpivot(key, scored, "field", "expected").where(F.col("expected").isNotNull())
    return want.join(text(actual).unpivot(key, scored, "field", "actual"), [key, "field"], "left")


def official_anti_join(rows: DataFrame, official: DataFrame, key: str, flagged: Column) -> DataFrame:
    """rows without those that are flagged and whose key the official corpus holds too."""
    return rows.where(~F.coalesce(flagged, F.lit(False))).unionByName(rows.where(flagged).join(official.select(key), key, "left_anti"))


def consistency_check(retrieved: DataFrame, table: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, problem): retrieved keys that the table lacks, or holds under another kind."""
    detail = table.select(key, F.col(kind).alias("table_kind"))
    problem = F.when(F.col("table_kind").isNull(), "missing").when(F.col(kind) != F.col("table_kind"), "other kind")
    return retrieved.select(key, kind).distinct().join(detail, key, "left").select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def append_cited(ranked: DataFrame, cited: DataFrame, table: DataFrame, by: str, key: str) -> DataFrame:
    """Ranked rows (by, key, pos), then cited keys (by, key, pos) that aren't among them and are in the table, in order."""
    first = cited.groupBy(by, key).agg(F.min("pos").alias("pos")).join(table.select(key), key, "left_semi")
    extra = first.join(ranked.select(by, key), [by, key], "left_anti")
    both = ranked.select(by, key, "pos", F.lit(0).alias("leg")).unionByName(extra.select(by, key, "pos", F.lit(1).alias("leg")))
    return both.select(by, key, F.row_number().over(W.partitionBy(by).orderBy("leg", "pos", key)).alias("pos"), (F.col("leg") == 1).alias("appended"))
