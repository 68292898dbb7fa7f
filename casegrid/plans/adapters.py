"""The driver's tables shaped as the tables of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.storage import parted


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity, kind, vec): five chunks for each entity."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("entity"), F.col("label").alias("kind"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def leg_vectors(spark: SparkSession, sf_dir: str, leg: int) -> DataFrame:
    """The query set of a leg: the asked vector (0), or the next chunk of its entity (1), the asked one if that is missing."""
    asked = query_vectors(spark, sf_dir)
    if leg == 0:
        return asked
    after = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 1).select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("next_vec"))
    return asked.join(after, "query_id", "left").select("query_id", F.coalesce("next_vec", "query_vec").alias("query_vec"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(law_id, law_name, article_no, law_key, text): one row for each key, the one with the smallest id."""
    part = read(spark, sf_dir, "part")
    first = F.min_by(F.struct(F.col("p_partkey").alias("law_id"), F.col("p_name").alias("text")), "p_partkey").alias("first")
    rows = part.groupBy(F.col("p_brand").alias("law_name"), F.col("p_size").alias("article_no")).agg(first)
    return rows.select("first.law_id", "law_name", "article_no", F.concat_ws("#", "law_name", F.col("article_no").cast("string")).alias("law_key"), "first.text")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, pos, law_id): citations numbered from 1 within a case."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return parted(lines, lines.count(), "l_orderkey").select(F.col("l_orderkey").alias("case_id"), F.row_number().over(order).alias("pos"), F.col("l_partkey").alias("law_id"))


def docket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, created, status, category, party)."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("party"))


#: The same tables in SQL.
SQL = {
    "articles": """articles AS (SELECT min(p_partkey) AS law_id, p_brand AS law_name, p_size AS article_no, p_brand || '#' || p_size AS law_key, arg_min(p_name, p_partkey) AS text FROM part GROUP BY p_brand, p_size)""",
    "citations": """citations AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_partkey AS law_id FROM lineitem)""",
    "docket": """docket AS (SELECT o_orderkey AS case_id, o_orderdate::DATE AS created, o_orderstatus AS status, o_orderpriority AS category, o_custkey AS party FROM orders)""",
    "scored": """corpus AS (SELECT vec_id AS id, vec_id // 5 AS entity, label AS kind, embedding::DOUBLE[] AS vec FROM embeddings),
      scored AS (SELECT q.id AS query_id, c.id, c.entity, c.kind, round(list_cosine_similarity(c.vec, q.vec), 6) AS score FROM corpus q JOIN corpus c ON q.id % 100 = 0 AND c.id <> q.id)""",
    "legs": """hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY score DESC, id) AS rank FROM (
        SELECT *, coalesce((kind >= 5)::INT, 0) AS leg FROM scored)) WHERE rank <= 100)""",
    "whole_legs": """asked AS (SELECT id AS query_id, 0 AS leg, vec FROM corpus WHERE id % 100 = 0 UNION ALL
        SELECT q.id, 1, coalesce(n.vec, q.vec) FROM corpus q LEFT JOIN corpus n ON n.id = q.id + 1 WHERE q.id % 100 = 0),
      hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY score DESC, id) AS rank FROM (
        SELECT query_id, leg, c.id, c.entity, c.kind, round(list_cosine_similarity(c.vec, q.vec), 6) AS score FROM asked q JOIN corpus c ON c.id <> q.query_id)) WHERE rank <= 100)""",
    "entities": """entities AS (SELECT query_id, leg, entity, row_number() OVER (PARTITION BY query_id, leg ORDER BY min(rank)) AS rank FROM hits GROUP BY query_id, leg, entity)""",
    "fused": """fused AS (SELECT * FROM (SELECT query_id, entity, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leg, r) AS rank FROM (
        SELECT query_id, entity, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(leg) AS leg, arg_min(rank, leg) AS r FROM entities GROUP BY query_id, entity)) WHERE rank <= 25)""",
}


def with_(*names: str) -> str:
    """WITH clause of the named tables."""
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def written_wide(text):
    """The text with full-width digits and ideographic spaces around them; an empty one as a line feed and such a space."""
    digits = "０１２３４５６７８９"
    wide = F.regexp_replace(F.translate(text, "0123456789", digits), f"([{digits}]+)", "　$1　")
    return F.when(text == "", "\n　").otherwise(wide)
