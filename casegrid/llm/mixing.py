"""Mixing sources to target weights: temperature mixing.

Source token shares are raised to an exponent that is bisected until the mixture's entropy, or the most repeated source,
meets its limit. The normalised weights become token budgets, and each budget is filled by passes over the source's
blocks, every pass in another order.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_prefix, map_texts, materialize

#: Sources whose token counts the driver takes at most; the weights of more are worked out by aggregations.
MOST_SOURCES = 1_000_000
#: Bits of a block's turn that part a source's blocks into bins, each of which is put in order by itself.
BIN_BITS = 10
#: Sources whose budgets are broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Documents in a block on average.
BLOCK_DOCS = 256
#: How often the most repeated source may be passed over.
MOST_PASSES = 2.0


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    raised = [s**exponent for s in shares]
    total = sum(raised)
    return [r / total for r in raised]


def find_exponent(tokens: list[int], most_passes: float | None = MOST_PASSES, least_entropy: float | None = None) -> float:
    """An exponent in [0, 1] by bisection: with most_passes, the least for which no source is passed over more often than
    that while the largest is used once; with least_entropy (nats), the greatest whose mixture has that entropy. With
    both, the repetition limit wins where they conflict. Sources without tokens don't count."""
    shares = [t / sum(tokens) for t in tokens if t > 0]
    if len(shares) < 2:
        return 1.0

    def bisect(good_at_one, low: float = 0.0, high: float = 1.0) -> float:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if good_at_one(mid) else (mid, high)
        return high

    spread = max(shares) / min(shares)
    floor = 0.0 if most_passes is None or spread <= most_passes else bisect(lambda a: spread ** (1 - a) <= most_passes)
    if least_entropy is None:
        return floor
    if entropy(tempered(shares, 1.0)) >= least_entropy:
        return 1.0
    if entropy(tempered(shares, 0.0)) <= least_entropy:
        return floor
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(tempered(shares, mid)) >= least_entropy else (low, mid)
    return max(floor, low)


def source_budgets(counts: DataFrame, most_passes: float | None = MOST_PASSES, least_entropy: float | None = None, total: int | None = None) -> list[tuple]:
    """(source, tokens, weight, budget) of each source from counts (source, tokens), in the order of source, on the driver.

    total: tokens of the mixture. If None it is as much as uses the source with the lowest weight to share once in full,
    so that no document is left out.
    """
    rows = counts.select("source", "tokens").collect()
    rows = sorted(((r["source"], int(r["tokens"] or 0)) for r in rows), key=lambda r: (r[0] is not None, r[0] or ""))
    tokens = [t for _, t in rows]
    if not sum(tokens):
        return [(s, t, 0.0, 0) for s, t in rows]
    exponent = find_exponent(tokens, most_passes, least_entropy)
    weights = iter(tempered([t / sum(tokens) for t in tokens if t > 0], exponent))
    weights = [next(weights) if t > 0 else 0.0 for t in tokens]
    if total is None:
        total = max(t / w for t, w in zip(tokens, weights, strict=True) if w > 0)
    return [(s, t, w, max(0, round(w * total))) for (s, t), w in zip(rows, weights, strict=True)]


def wide_budgets(counts: DataFrame, most_passes: float | None = MOST_PASSES, least_entropy: float | None = None, total: int | None = None) -> DataFrame:
    """source_budgets as a table, for any number of sources: each step of the bisection is one aggregation over them."""
    held = counts.where("tokens > 0")
    ends = held.agg(F.count("*").alias("n"), F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not ends["n"]:
        return counts.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    share = F.col("tokens") / ends["all"]

    def mixed(a: float) -> tuple[float, float, float]:
        """(sum of raised shares, entropy of the mixture, tokens that use the source with the least weight to share once)."""
        raised = F.pow(share, F.lit(a))
        r = held.agg(F.sum(raised).alias("z"), F.sum(raised * F.log(raised)).alias("l"), F.max(F.pow(share, F.lit(1.0 - a))).alias("t")).first()
        return r["z"], math.log(r["z"]) - r["l"] / r["z"], r["t"] * r["z"] * ends["all"]

    exponent = 1.0
    if ends["n"] > 1:
        # Only the largest and the smallest source decide the limit on passes.
        floor = find_exponent([ends["most"], ends["least"]], most_passes)
        exponent = floor
        if least_entropy is not None:
            if mixed(1.0)[1] >= least_entropy:
                exponent = 1.0
            elif mixed(0.0)[1] > least_entropy:
                low, high = 0.0, 1.0
                for _ in range(40):
                    mid = (low + high) / 2
                    low, high = (mid, high) if mixed(mid)[1] >= least_entropy else (low, mid)
                exponent = max(floor, low)
    z, _, once = mixed(exponent)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / z).otherwise(0.0)
    return counts.select("source", "tokens", weight.alias("weight"), F.greatest(F.lit(0), F.round(weight * (once if total is None else total))).cast("long").alias("budget"))


def budget_table(counts: DataFrame, most_passes: float | None = MOST_PASSES, least_entropy: float | None = None, total: int | None = None) -> DataFrame:
    """(b_source, b_tokens, weight, budget) of each source."""
    if counts.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        return materialize(wide_budgets(counts, most_passes, least_entropy, total).toDF("b_source", "b_tokens", "weight", "budget"), "mixing-budgets")
    return counts.sparkSession.createDataFrame(source_budgets(counts, most_passes, least_entropy, total), "b_source string, b_tokens long, weight double, budget long")


def count_tokens(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The key columns and n_tokens_ (words) of each row."""
    make = lambda: lambda texts: ([len(t.split()) if t else 0 for t in texts],)
    return map_texts(docs, make, keys, text_col, [("n_tokens_", pa.int64())], "n_tokens_ long", as_bytes=True)


def _block(doc: Column, docs: Column, seed: int) -> Column:
    """The block that a document is dealt to."""
    return F.pmod(F.xxhash64(doc, F.lit(seed)), F.greatest(F.lit(1), F.ceil(docs / BLOCK_DOCS)))


def _turn(what: Column, number: Column, seed: int) -> Column:
    """Where a block, or a document in its block, stands in the pass of this number."""
    return F.xxhash64(what, number.cast("long"), F.lit(seed))


def place(counted: DataFrame, budgets: DataFrame, seed: int = 0) -> DataFrame:
    """(doc, source, pass, block, tokens): which documents each pass over a source takes.

    counted: (doc, source, n_tokens_). Whole passes take all blocks. The last pass takes blocks in its own order while
    they fit in what is left of the budget, and of the first block that doesn't, documents while they fit, the one that
    goes over the end included; so a source has its budget to within its longest document. Documents are dealt to blocks
    by a hash of their id, so the running sums are over bins of a source's blocks (one row for some hundred documents), and within
    one block. Rows that repeat a document id share its block and are taken together or in the order of their lengths.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    plan = budgets.withColumn("key", key).select("key", "tokens", "budget", "docs")
    rows = counted.withColumn("key", key).join(F.broadcast(plan) if budgets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan, "key")
    rows = rows.withColumn("block", _block(F.col("doc"), F.col("docs"), seed))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1)
    rows = rows.withColumns({"full": full, "left": F.col("budget") - full * F.col("tokens")})
    blocks = rows.groupBy("key", "block").agg(F.sum("n_tokens_").alias("block_tokens"), F.first("full").alias("full"), F.first("left").alias("left"))
    # Blocks stand in the order of their turns. Bins of turns are added up first, so no task has all blocks of a source.
    turns = blocks.withColumn("turn", _turn(F.col("block"), F.col("full"), seed)).withColumn("bin", F.shiftright("turn", 64 - BIN_BITS))
    bins = turns.groupBy("key", "bin").agg(F.sum("block_tokens").alias("bin_tokens"))
    bins = bins.withColumn("bin_before", F.sum("bin_tokens").over(W.partitionBy("key").orderBy("bin")) - F.col("bin_tokens"))
    order = W.partitionBy("key", "bin").orderBy("turn", "block")
    before = F.col("bin_before") + F.sum("block_tokens").over(order) - F.col("block_tokens")
    last = turns.join(bins, ["key", "bin"]).withColumn("before", before).where(F.col("before") < F.col("left"))
    whole = last.where(F.col("before") + F.col("block_tokens") <= F.col("left")).select("key", "block", F.lit(None).cast("long").alias("room"))
    cut = last.where(F.col("before") + F.col("block_tokens") > F.col("left")).select("key", "block", (F.col("left") - F.col("before")).alias("room"))
    # One row for each block of the last pass; only the block that is cut needs its documents in order.
    taken = whole.unionByName(cut)
    extra = rows.join(taken, ["key", "block"])
    inside = W.partitionBy("key", "block").orderBy(_turn(F.col("doc"), F.col("full"), seed), F.col("doc"), "n_tokens_")
    partly = extra.where(F.col("room").isNotNull()).withColumn("so_far", F.sum("n_tokens_").over(inside.rowsBetween(W.unboundedPreceding, -1))).where(F.coalesce("so_far", F.lit(0)) < F.col("room"))
    columns = ["doc", "source", "full", "block", "n_tokens_"]
    once = extra.where(F.col("room").isNull()).select(columns).unionByName(partly.select(columns))
    every = rows.where(F.col("full") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)))
    columns = ["doc", "source", "pass", "block", F.col("n_tokens_").alias("tokens")]
    return every.select(columns).unionByName(once.withColumn("pass", F.col("full").cast("int")).select(columns))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most_passes: float | None = MOST_PASSES, least_entropy: float | None = None, total: int | None = None, seed: int = 0) -> DataFrame:
    """The mixture: (id, source, pass, block, tokens, place) for each time that a document is taken.

    place orders a pass: blocks by a hash of pass and block, and within a block documents by a hash of pass and id, so a
    reader that sorts by (pass, place) gets block permutations. Null sources are a source of their own. Null, empty or
    blank texts have no tokens and are taken in every whole pass. Rows that repeat an id are taken each. Other columns
    aren't read. An empty table gives none.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    counted = materialize(count_tokens(named, ["doc", "source"]), "mixing-counts")
    counts = counted.groupBy("source").agg(F.sum("n_tokens_").alias("tokens"), F.count("*").alias("docs"))
    sizes = materialize(counts, "mixing-sources")
    found = budget_table(sizes, most_passes, least_entropy, total)
    budgets = sizes.join(found, F.col("source").eqNullSafe(F.col("b_source"))).select("source", "tokens", "docs", "budget")
    place_of = F.concat_ws("-", F.lpad(F.hex(F.xxhash64("pass", "block", "source", F.lit(seed))), 16, "0"), F.lpad(F.hex(F.xxhash64("pass", "doc", F.lit(seed))), 16, "0"))
    return place(counted, budgets, seed).withColumn("place", place_of).select(F.col("doc").alias(id_col), F.col("source").alias(source_col), "pass", "block", "tokens", "place")


def repeat_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", most_passes: float = MOST_PASSES, seed: int = 0) -> DataFrame:
    """docs with each row as often as place() takes it, at least once; all columns stay as they are.

    A row's id there is a hash of the whole row. The last pass over a source takes a first part of its blocks' order, and
    of its last block a first part of the documents' order, so each source has one place where that pass ends. That place
    is all that the rows need for their counts: no text is shuffled, and a source meets its budget to within its longest
    document. Of rows that are the same in all columns, as many are taken as place() takes. Null sources are a source of
    their own; null, empty and blank texts have no tokens and come once for each whole pass; an empty table gives none; the
    columns may have any names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = free_prefix(docs.columns, "m_")
    source = F.col(f"`{source_col}`").cast("string")
    row = F.xxhash64(*columns, F.lit(seed))
    named = docs.select(row.alias("doc"), source.alias("source"), F.col(f"`{text_col}`").alias("text"))
    counted = materialize(count_tokens(named, ["doc", "source"]), "mixing-counts")
    sizes = materialize(counted.groupBy("source").agg(F.sum("n_tokens_").alias("tokens"), F.count("*").alias("docs")), "mixing-sources")
    found = budget_table(sizes, most_passes)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    budgets = sizes.join(found, F.col("source").eqNullSafe(F.col("b_source"))).select("source", "tokens", "docs", "budget")
    plan = budgets.select(F.col("source").alias(f"{own}source_"), F.col("docs").alias(f"{own}docs_"), full.alias(f"{own}full_"))

    def position(doc: Column, block: Column) -> Column:
        turns = [_turn(block, F.col(f"{own}full_"), seed), block, _turn(doc, F.col(f"{own}full_"), seed), doc]
        return F.struct(*[t.alias(f"p{i}") for i, t in enumerate(turns)])

    last = place(counted, budgets, seed).join(plan, F.col("source").eqNullSafe(F.col(f"{own}source_"))).where(F.col("pass") == F.col(f"{own}full_"))
    ends = last.groupBy(F.col("source").alias("e_source_")).agg(F.max(position(F.col("doc"), F.col("block"))).alias(f"{own}end_"))
    ends = materialize(ends, "mixing-ends")
    # Rows like the one at the end, and how many of them the last pass takes.
    at_end = lambda rows: rows.join(ends, F.col("source").eqNullSafe(F.col("e_source_")) & (F.col("doc") == F.col(f"{own}end_.p3"))).groupBy("e_source_")
    some = at_end(last).agg(F.count("*").alias(f"{own}take_")).alias("t").join(at_end(counted).agg(F.count("*").alias("like_")).alias("l"), F.col("t.e_source_").eqNullSafe(F.col("l.e_source_")))
    some = materialize(some.where(f"{own}take_ < like_").select(F.col("t.e_source_").alias("c_source_"), f"{own}take_"), "mixing-cut-copies")
    plan = plan.join(ends, F.col(f"{own}source_").eqNullSafe(F.col("e_source_")), "left").join(some, F.col(f"{own}source_").eqNullSafe(F.col("c_source_")), "left")
    plan = materialize(plan.select(f"{own}source_", f"{own}docs_", f"{own}full_", f"{own}end_", f"{own}take_"), "mixing-plan")
    plan = F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan
    joined = docs.withColumn(f"{own}row_", row).join(plan, source.eqNullSafe(F.col(f"{own}source_")), "left")
    at = position(F.col(f"{own}row_"), _block(F.col(f"{own}row_"), F.col(f"{own}docs_"), seed))
    cut = F.coalesce((at == F.col(f"{own}end_")) & F.col(f"{own}take_").isNotNull(), F.lit(False))
    times = F.greatest(F.lit(1), F.col(f"{own}full_") + F.when(at <= F.col(f"{own}end_"), 1).otherwise(0))
    again = lambda rows, n: rows.withColumn(f"{own}pass_", F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*columns)
    if some.isEmpty():
        return again(joined, times)
    copies = joined.where(cut).groupBy(f"{own}row_").agg(*[F.first(c).alias(n) for c, n in zip(columns, docs.columns, strict=True)], F.count("*").alias(f"{own}n_"), F.first(f"{own}full_").alias(f"{own}full_"), F.first(f"{own}take_").alias(f"{own}take_"))
    return again(joined.where(~cut), times).unionByName(again(copies, F.greatest(F.lit(1), F.col(f"{own}full_")) * F.col(f"{own}n_") + F.when(F.col(f"{own}full_") > 0, F.col(f"{own}take_")).otherwise(0)))
