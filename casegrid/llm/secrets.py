"""Secret scans: an incremental blob ledger.

Every version of a file or document is addressed by the SHA-256 of its content (its blob). The ledger says which
(blob, rule version) pairs have been scanned and what was found there. A scan takes only pairs that the ledger lacks,
each blob once however many paths carry it, and joins findings back to all paths. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The patterns of the base kinds, in the order in which they are listed.
#: Kind, pattern, group whose length is judged, characters that it needs.
BASE_RULES = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    # The same as runs of any length of which the short ones are dropped, as a run ends where no such character follows.
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Kinds that this operator adds.
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("ghp", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    # Only where a run of such characters begins, so that a run is gone through once.
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
]
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "3"
#: Matches whose places are added up in one go; longer lists are cut into so many, so that the work grows with their length.
RUN = 256
_SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


def _once(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(lengths: Column, begin: Column, kind: str, order: int) -> Column:
    """Spans of the good ones of some matches in a row, the first of whose gaps begins at begin."""
    end = lambda acc, x: acc["at"] + x["gap"] + x["hit"]
    span = lambda acc, x: F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end(acc, x).alias("end"))
    return F.aggregate(
        lengths,
        F.struct(begin.alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda acc, x: F.struct(end(acc, x).alias("at"), F.when(x["good"], F.concat(acc["out"], F.array(span(acc, x)))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )


def _spans(text: Column, rule: tuple[str, str, int, int], order: int) -> Column:
    """Spans of one rule's leftmost non-overlapping matches: the lengths of matches and of what lies between add up to
    their places. Text without a match costs one search."""
    kind, pattern, group, least = rule
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.zip_with(
        F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))),
        judged,
        lambda x, part: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), (F.length(part) >= least).alias("good")),
    )
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + y["gap"] + y["hit"])
    cut = lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / RUN).cast("int")), lambda i: F.slice(x, i * RUN + 1, F.lit(RUN))), lambda y: F.size(y) > 0)
    begins = lambda runs: F.aggregate(runs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + total(x))))
    placed = lambda runs: F.flatten(F.zip_with(runs, F.slice(begins(runs), F.lit(1), F.size(runs)), lambda x, begin: _placed(x, begin, kind, order)))
    found = _once(lengths, lambda x: _once(cut(x), placed))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob, text) -> (blob, rule_version, spans), the spans by start and then kind; [] where nothing is found."""
    found = F.concat(*[_spans(F.col("text"), rule, i) for i, rule in enumerate(RULES)])
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), F.array_sort(found).alias("spans"))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rule_version string, spans {_SPAN}")


def scan_versions(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan the contents that the ledger lacks; give (findings of every path, new ledger rows).

    Findings have a row for each row of versions: (id, blob, spans). A null text counts as empty; an empty or null id is
    passed through; repeated rows give repeated findings; other columns aren't read, so their names can't clash. An empty
    table gives none. Append the second table to the ledger to make the next run incremental: contents that it holds
    under this rule_version aren't scanned again; under another one they are. Pairs that the ledger holds more than once
    count once.

    One shuffle carries the distinct texts of each input split to the scan, whose findings are written before paths meet
    them. Only blobs with findings take part there, and a blob that very many paths share can be split by Spark, as its
    finding is one row.
    """
    paths = versions.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    paths = paths.withColumn("blob", F.sha2("text", 256))
    unseen = paths.select("blob", "text")
    if ledger is not None:
        # A ledger may hold a pair more than once, as an append that is tried again leaves it.
        known = ledger.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    new = materialize(scan_blobs(unseen.dropDuplicates(["blob"]), rule_version), "secret-findings")
    all_found = new if ledger is None else new.unionByName(known.select("blob", "rule_version", "spans"))
    hits = all_found.where(F.size("spans") > 0).select("blob", "spans")
    found = paths.select("id", "blob").join(hits, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))
    return found, new


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of scan_versions' findings."""
    spans = F.col("spans")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind, *_ in BASE_RULES]
    base = F.filter(spans, lambda s: s["ord"] < len(BASE_RULES))
    return found.select(id_col, *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"), "blob")
