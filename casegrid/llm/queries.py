"""Queries over the given tables: one for each operator of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, jaccard, lm, mixing, negatives, pieces, pii, quality, secrets, tokenfiles, topk, urls
from .common import table

#: The tokenizer files. They are read on every executor.
PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"
BYTE_MODEL = "byte_bpe_50k.json"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_versions(table(spark, sf_dir, "documents", "doc_id", "text"))
    return secrets.secret_report(found).drop("blob")


def secret_scan_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_secret_scan as the second of two runs: the first has scanned the documents of all sources but the last, and its
    ledger, appended twice over, leaves only what it lacks to the second."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    last = docs.agg(F.max("source")).first()[0]
    _, before = secrets.scan_versions(docs.where(~F.col("source").eqNullSafe(last)))
    found, _ = secrets.scan_versions(docs, ledger=before.unionByName(before))
    return secrets.secret_report(found).drop("blob")


@functools.cache
def _digits(before: str) -> tuple[np.ndarray, np.ndarray]:
    """(the characters of each 16-bit id after before, which of them there are)."""
    words = [f"{before}{i}".encode() for i in range(1 << 16)]
    chars = np.array([w.ljust(6, b"\0") for w in words], "S6").view(np.uint8).reshape(-1, 6)
    return chars, chars != 0


def id_digest(ids: np.ndarray, between: str = " ") -> str:
    """SHA-256 of the decimal ids joined by one character."""
    if not len(ids):
        return hashlib.sha256(b"").hexdigest()
    chars, real = _digits(between)
    return hashlib.sha256(chars[ids].ravel()[real[ids].ravel()][1:].tobytes()).hexdigest()


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    def emit(encoder: pieces.Encoder, text: str, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple:
        decoded = hashlib.sha256(encoder.decode(ids).encode("utf-8")).hexdigest()
        return len(ids), id_digest(ids), decoded, zlib.crc32(np.stack([begins, ends]).astype("<u4").tobytes())

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return pieces.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], public_tokenizers.path(PIECE_MODEL), emit=emit, fields=fields, schema=schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(pii.find_pii(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"]))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), 20)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfiles.write_shards(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(WORD_MODEL), end_id=1)
    return tokenfiles.read_shards(spark, path)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def emit(encoder: bpe.BpeEncoder, ids: np.ndarray) -> tuple:
        decoded = encoder.decode_bytes(ids.tolist())
        try:
            decoded.decode()
        except UnicodeDecodeError:
            decoded = decoded.decode("utf-8", "replace").encode()
        return len(ids), id_digest(ids, ","), hashlib.sha256(decoded).hexdigest()

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bpe.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], public_tokenizers.path(BYTE_MODEL), emit=emit, fields=fields, schema=schema)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.labelled(vectors, label)
    return negatives.mine(rows, rows.where(F.col("id") % 100 == 0))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(PIECE_MODEL))


_FLAT = "coalesce(text, '')"
_RULE_SQL = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))[""'']?\x20*[:=]\x20*[""'']?([A-Za-z0-9+/_.=-]+)""".replace('""', '"'), 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("ghp", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
]


def _op1_sql() -> str:
    """Matches by number: their starts are the lengths of all earlier matches and of what lies between. The character before
    a jwt is part of its match here, and taken off its span."""
    legs = [
        f"""SELECT doc_id, {o} AS o, '{kind}' AS kind, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(parts) AS part, {f"unnest(regexp_extract_all(t, '{p}', 1))" if kind == "jwt" else "''"} AS lead, {least} AS least, unnest(range(len(hits))) AS i
        FROM (SELECT doc_id, string_split_regex(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))] AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS parts, t
              FROM (SELECT doc_id, {_FLAT} AS t FROM documents))"""
        for o, (kind, p, group, least) in enumerate(_RULE_SQL)
    ]
    return f"""WITH hits AS ({' UNION ALL '.join(legs)}),
    placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, o ORDER BY i) AS to_ FROM hits),
    spans AS (SELECT doc_id, o, kind, (to_ - length(hit) + length(lead))::BIGINT AS pos, kind || ':' || (to_ - length(hit) + length(lead))::BIGINT || ':' || to_::BIGINT AS span FROM placed WHERE length(part) - length(lead) >= least),
    found AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
        string_agg(span, ',' ORDER BY pos, o) AS spans, string_agg(span, ',' ORDER BY pos, o) FILTER (o < 3) AS base FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id"""


_OP5_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
  SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


_OP12_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


_OP8_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT x, y FROM p WHERE 100 * c >= 90 * (nx + ny - c)),
  r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
  SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m AS component_id FROM s JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = s.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, secret_scan_increment, op2_sentencepiece, op3_pii, op4_quality_rules, op5_exact_topk, op6_lm_scoring, op7_token_files, op8_jaccard_join, op9_url_filter, op10_mixing, op11_byte_bpe, op12_hard_negatives, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _op1_sql(), "secret_scan_increment": _op1_sql(), "op5_exact_topk": _OP5_SQL, "op8_jaccard_join": _OP8_SQL, "op12_hard_negatives": _OP12_SQL}
