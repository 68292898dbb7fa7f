"""Quality rules: robust multivariate outliers.

Each text gives a vector of transformed statistics. For each language and source the minimum-covariance-determinant
estimate of centre and scatter is found by concentration steps over all of its rows, and texts whose Mahalanobis distance
is beyond the cutoff are rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_prefix, map_texts, materialize

#: The limits of the base rule.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks"]
#: The transformed statistics: their expressions, and the least standard deviation that a group is taken to have in each.
#: Most texts have none of what the last four measure, so the scatter of the central rows alone would be zero there. Those
#: of lines and repeats are under sqrt(0.45 / CUTOFF) = 0.1207, so that 45 % of either alone passes the cutoff.
VECTOR = ["log_word_chars", "log_symbols", "root_dup_lines", "root_repeats", "log_marks"]
LEAST_SD = np.array([0.05, 0.25, 0.12, 0.12, 0.1])
D = len(VECTOR)
#: Share of a group's rows that the estimate rests on; the factor that makes the scatter of so many central rows agree
#: with that of all rows under a normal distribution, 0.75 / P(chi2(D + 2) <= q) with P(chi2(D) <= q) = 0.75.
SUPPORT, CONSISTENCY = 0.75, 1.41
#: Squared distance beyond which a text is rejected: about the 0.99999 quantile of chi-square with D degrees of freedom.
CUTOFF = 30.86
#: Rows that a group needs for an estimate of its own; smaller sources of a language are pooled, then smaller languages.
LEAST_ROWS = 200
STEPS = 6
BROADCAST_GROUPS = 50_000
#: Distances are counted in bins of so many a unit of the natural logarithm, so that a step is one aggregation.
_BINS = 32

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[0x80:0xC0] = 2  # later bytes of a code point
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """STATS of one text; all 0 for a null or empty one."""
    if not text:
        return (0,) * len(STATS)
    words = text.split()
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=5)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated, n = 0, len(words)
    if n >= 4:
        w = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        windows = w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] * np.uint64(0x165667B19E3779F9)
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            again = np.zeros(n - 2, bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : n - 2 + k] |= again
            repeated = int(inside.sum())
    return n, len(text) - int(kinds[1] + kinds[2]), int(kinds[4]), len(lines) - len(set(lines)), repeated, len(lines), int(kinds[3])


def measure(docs: DataFrame, keys: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """The key columns and STATS (long) of each row. prefix goes before the new names, for tables that have such names."""

    def make():
        return lambda texts: [pa.array(c, pa.int64()) for c in zip(*map(text_stats, texts), strict=True)] if texts else [pa.array([], pa.int64())] * len(STATS)

    names = [prefix + s for s in STATS]
    return map_texts(docs, make, keys, text_col, [(s, pa.int64()) for s in names], ", ".join(f"`{s}` long" for s in names), as_bytes=True)


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > int(100 * MOST_REPEATED) * n)


def vector(prefix: str = "") -> list[Column]:
    c = lambda name: F.col(prefix + name).cast("double")
    n, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    return [F.log(F.greatest(c("word_chars"), F.lit(1.0)) / n), F.log1p(100 * c("n_symbols") / n), F.sqrt(c("n_dup_lines") / lines), F.sqrt(c("n_repeat_words") / n), F.log1p(c("n_marks") / n)]


def _distance(z: list[Column], mean: Column, inverse: Column) -> Column:
    gap = [z[i] - mean[i] for i in range(D)]
    return sum((gap[i] * gap[j] * inverse[i * D + j] for i in range(D) for j in range(D)), F.lit(0.0))


def _floored(scatter: np.ndarray) -> np.ndarray:
    """scatter with at least the variance LEAST_SD**2 in every direction, and as it is in directions that have more."""
    unit = np.outer(LEAST_SD, LEAST_SD)
    values, vectors = np.linalg.eigh(scatter / unit)
    return (vectors * np.maximum(values, 1.0)) @ vectors.T * unit


def _estimates(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Moments of the central rows of each group -> centre, inverse scatter and the logarithm of the scatter's determinant."""
    for x in frames:
        out = []
        for row in x.itertuples(index=False):
            mean = np.array(row.s1) / row.n
            upper = np.zeros((D, D))
            upper[np.triu_indices(D)] = np.array(row.s2) / row.n
            scatter = _floored(CONSISTENCY * (upper + np.triu(upper, 1).T - np.outer(mean, mean)))
            out.append((row.g_lang, row.g_source, row.start, row.rows, mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), np.linalg.slogdet(scatter)[1]))
        yield pd.DataFrame(out, columns=["g_lang", "g_source", "start", "rows", "mean", "inverse", "size"])


_MODEL = "g_lang string, g_source string, start int, rows long, mean array<double>, inverse array<double>, size double"


def _starts(middle: DataFrame) -> DataFrame:
    """Where the steps of each group begin: at its medians with fixed scales, at its medians with its quartiles' scales, and
    at texts that repeat nothing and have no symbols or marks."""
    at = [F.col(f"m{i}") for i in range(D)]
    fixed = [F.lit(float(1 / (4 * x**2))) for x in LEAST_SD]
    spread = [1 / F.pow(F.greatest((q[2] - q[0]) / 1.349, F.lit(float(x))), 2) for q, x in zip(at, LEAST_SD, strict=True)]
    diagonal = lambda scales: F.array(*[scales[i] if i == j else F.lit(0.0) for i in range(D) for j in range(D)])
    median = F.array(*[q[1] for q in at])
    clean = F.array(at[0][1], *[F.lit(0.0)] * (D - 1))
    starts = [(median, fixed), (median, spread), (clean, fixed)]
    made = F.array(*[F.struct(F.lit(i).alias("start"), mean.alias("mean"), diagonal(scales).alias("inverse")) for i, (mean, scales) in enumerate(starts)])
    return middle.select("g_lang", "g_source", "rows", F.explode(made).alias("s")).select("g_lang", "g_source", "s.start", "rows", "s.mean", "s.inverse")


def fit_groups(stats: DataFrame, lang_col: str = "lang", source_col: str = "source", steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """(groups, model): the pooled group of each language and source, and each group's estimate.

    stats has the language, the source and STATS of every row. Rows that fail the base rule take no part. A null language
    or source is a value of its own. The steps are taken from several starts, and the estimate with the least determinant
    is kept. Each concentration step is one aggregation by group and distance bin, combined
    before its shuffle, so a group of any size has a few thousand rows there at most. The same rows in any order or
    partitioning give the same bins up to rounding of sums.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
    rows = stats.where(~base_failed()).select(named(lang_col).alias("lang_"), named(source_col).alias("source_"), *[z.alias(f"z{i}") for i, z in enumerate(vector())])
    sizes = rows.groupBy("lang_", "source_").count()
    sizes = sizes.withColumn("own", F.col("count") >= LEAST_ROWS)
    pool = F.sum("count").over(W.partitionBy("lang_", "own"))
    groups = materialize(
        sizes.select(
            "lang_",
            "source_",
            F.when(F.col("own") | (pool >= LEAST_ROWS), F.col("lang_")).otherwise("").alias("g_lang"),
            F.when(F.col("own"), F.col("source_")).otherwise("").alias("g_source"),
        ),
        "quality-groups",
    )
    keys = ["g_lang", "g_source"]
    rows = materialize(rows.join(groups, ["lang_", "source_"]).drop("lang_", "source_"), "quality-vectors")
    z = [F.col(f"z{i}") for i in range(D)]
    middle = rows.groupBy(keys).agg(F.count("*").alias("rows"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"m{i}") for i, c in enumerate(z)])
    model = materialize(_starts(middle), "quality-model")
    each = [*keys, "start"]
    pairs = [(i, j) for i in range(D) for j in range(i, D)]
    for _ in range(steps):
        near = rows.join(model, keys).withColumn("bin", F.floor(F.log(_distance(z, F.col("mean"), F.col("inverse")) + 1e-6) * _BINS))
        binned = near.groupBy(*each, "bin").agg(F.count("*").alias("n"), F.first("rows").alias("rows"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(z)], *[F.sum(z[i] * z[j]).alias(f"p{i}{j}") for i, j in pairs])
        before = F.coalesce(F.sum("n").over(W.partitionBy(*each).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        # Of the bin at the border as much as makes the central rows as many as they should be.
        wanted = F.ceil(F.col("rows") * SUPPORT)
        central = binned.withColumn("before", before).where(F.col("before") < wanted).withColumn("part", F.least(F.lit(1.0), (wanted - F.col("before")) / F.col("n")))
        total = lambda c: F.sum(F.col(c) * F.col("part"))
        moments = central.groupBy(each).agg(total("n").alias("n"), F.first("rows").alias("rows"), F.array(*[total(f"s{i}") for i in range(D)]).alias("s1"), F.array(*[total(f"p{i}{j}") for i, j in pairs]).alias("s2"))
        model = materialize(moments.mapInPandas(_estimates, _MODEL), "quality-model")
    least = F.min_by(F.struct("rows", "mean", "inverse"), F.struct("size", "start")).alias("m")
    return groups, materialize(model.groupBy(keys).agg(least).select(*keys, "m.*"), "quality-model")


def judge(measured: DataFrame, groups: DataFrame, model: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "") -> DataFrame:
    """measured with base_failed, distance (squared; null where the base rule fails) and kept, their names after prefix.

    groups and model have a row for each language and source. Up to BROADCAST_GROUPS of them are broadcast, so that texts
    that go along aren't shuffled; more are joined by a shuffle, in which Spark can split a hot source.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
    own = free_prefix(measured.columns, "m_")
    names = {c: own + c for c in ("lang", "source", "mean", "inverse", "of_lang", "of_source")}
    table = groups.join(model.drop("rows"), ["g_lang", "g_source"]).select(F.col("lang_").alias(names["lang"]), F.col("source_").alias(names["source"]), F.col("mean").alias(names["mean"]), F.col("inverse").alias(names["inverse"]))
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        table = F.broadcast(table)
    failed = base_failed(prefix)
    rows = measured.withColumns({names["of_lang"]: named(lang_col), names["of_source"]: named(source_col)})
    joined = rows.join(table, (F.col(names["of_lang"]) == F.col(names["lang"])) & (F.col(names["of_source"]) == F.col(names["source"])), "left")
    distance = F.when(~failed, _distance(vector(prefix), F.col(names["mean"]), F.col(names["inverse"])))
    out = joined.withColumns({f"{prefix}base_failed": failed, f"{prefix}distance": distance})
    out = out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.coalesce(F.col(f"{prefix}distance"), F.lit(0.0)) <= CUTOFF))
    return out.drop(*names.values())


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, STATS, base_failed, distance and kept of every row.

    Null and empty texts have no words and fail the base rule. Repeated rows get the same verdict each. Columns other
    than the four named aren't read. An empty table gives none.
    """
    stats = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    stats = materialize(measure(stats, ["id_", "lang", "source"]), "quality-stats")
    groups, model = fit_groups(stats)
    return judge(stats, groups, model).withColumnRenamed("id_", id_col).select(id_col, *STATS[:5], "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that quality_report keeps, all columns as they are, whatever their names.

    Null, empty and short texts fail the base rule and go; repeated rows go or stay together, as do ties at the cutoff, which
    stay; null languages and sources are groups of their own; an empty table gives none. Rows come from a second pass over
    the texts, which needs no join back by id and writes no text.
    """
    given = docs.select(F.col(f"`{lang_col}`").alias("k_lang"), F.col(f"`{source_col}`").alias("k_source"), F.col(f"`{text_col}`").alias("k_text"))
    groups, model = fit_groups(materialize(measure(given, ["k_lang", "k_source"], "k_text"), "quality-stats"), "k_lang", "k_source")
    # The text goes along as a key too, so that the row comes out whole.
    own = free_prefix(docs.columns, "q_")
    measured = measure(docs.withColumn(f"{own}text_", F.col(f"`{text_col}`")), docs.columns, f"{own}text_", own)
    judged = judge(measured, groups, model, lang_col, source_col, own)
    return judged.where(F.col(f"{own}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
