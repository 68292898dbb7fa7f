"""Corpus tables: assembly, profiles, checks, unions, upserts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.functions.edits import edits as edit_distances
from casegrid.functions.scalars import clause_key, format_minguo_date, nfkc, once, parse_minguo_date


def in_order(pos: Column, value: Column) -> Column:
    """A group's values by position."""
    return F.transform(F.sort_array(F.collect_list(F.struct(pos.alias("p"), value.alias("v")))), lambda x: x["v"])


def snapshot_upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """base with delta's rows inserted or in place of those with their key. The same delta again changes nothing."""
    return base.join(delta.select(key), key, "left_anti").select(base.columns).unionByName(delta.select(base.columns))


def partial_update(base: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(base with the named columns set where delta has a value, counts of attempted, updated and missing keys)."""
    new = delta.select(key, *[F.col(c).alias(f"u_{c}") for c in columns], F.lit(True).alias("u_"))
    joined = base.join(new, key, "left")
    updated = joined.select(*[F.coalesce(f"u_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])
    asked = delta.select(key).distinct()
    hit = asked.join(base.select(key).distinct().withColumn("b_", F.lit(True)), key, "left")
    stats = hit.agg(F.count("*").alias("attempted"), F.count_if(F.col("b_").isNotNull()).alias("updated"), F.count_if(F.col("b_").isNull()).alias("missing"))
    return updated, stats


def citation_resolve(cited: DataFrame, case: str, fragment: str, table: DataFrame, key: str, id_col: str) -> DataFrame:
    """(case, pos, fragment, key, id, status): resolved, unknown key, or unparsed fragment."""
    joined = cited.join(table.select(key, id_col), key, "left")
    status = F.when(F.col(key).isNull(), "unparsed").when(F.col(id_col).isNull(), "unknown").otherwise("resolved")
    return joined.select(case, "pos", fragment, key, id_col, status.alias("status"))


def citation_union(resolved: DataFrame, case: str, id_col: str, fragment: str) -> DataFrame:
    """One row a case: ids and raw fragments in the order of first appearance, each once; fragments that weren't resolved."""
    return resolved.groupBy(case).agg(
        F.array_distinct(F.filter(in_order(F.col("pos"), F.col(id_col)), lambda x: x.isNotNull())).alias("ids"),
        F.array_distinct(in_order(F.col("pos"), F.col(fragment))).alias("raw"),
        F.array_distinct(F.filter(in_order(F.col("pos"), F.when(F.col("status") != "resolved", F.col(fragment))), lambda x: x.isNotNull())).alias("unresolved"),
    )


def case_overview(chunks: DataFrame, case: str, chunk: str, columns: list[str]) -> DataFrame:
    """One row a case: that of its smallest chunk id."""
    return chunks.groupBy(case).agg(F.min_by(F.struct(*columns), chunk).alias("o")).select(case, "o.*")


def case_assembly(chunks: DataFrame, case: str, section: str, pos: str, text: str, wanted: list[str], mark: str) -> DataFrame:
    """A case's sections as texts joined in order, and its sorted marks; cases that lack a section are left out."""
    parts = [F.array_join(F.filter(in_order(F.col(pos), F.when(F.col(section) == s, F.col(text))), lambda x: x.isNotNull()), "\n").alias(s) for s in wanted]
    has = [F.bool_or(F.col(section) == s).alias(f"has_{s}") for s in wanted]
    grouped = chunks.groupBy(case).agg(*parts, *has, F.array_sort(F.collect_set(mark)).alias("marks"))
    whole = F.lit(True)
    for s in wanted:
        whole = whole & F.col(f"has_{s}")
    return grouped.where(whole).select(case, *wanted, "marks")


def document_grouping(chunks: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    return chunks.groupBy(doc).agg(F.array_join(in_order(F.col(pos), F.col(text)), "\n").alias("full_text"), in_order(F.col(pos), F.col(pos)).alias("pages"), F.count("*").alias("chunks"))


def tally(scores: DataFrame, layer: str, score: str) -> DataFrame:
    """Counts and wrong rate of each layer, and of all (layer null)."""
    out = scores.rollup(layer).agg(F.count_if(F.col(score) == "correct").alias("correct"), F.count_if(F.col(score) == "wrong").alias("wrong"), F.count_if(F.col(score) == "unsure").alias("unsure"), F.count("*").alias("total"))
    return out.withColumn("wrong_rate", F.when(F.col("total") > 0, F.round(F.col("wrong") / F.col("total"), 3)).otherwise(0.0))


def corpus_profile(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """(column, value, n, non_empty): distributions of the columns, and how many of their texts aren't empty, in one pass."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    filled = F.coalesce(F.trim(F.col(text)) != "", F.lit(False)).alias("filled")
    return rows.select(one, filled).groupBy("x.column", "x.value").agg(F.count("*").alias("n"), F.count_if("filled").alias("non_empty"))


def resolution_report(resolved: DataFrame, case: str) -> DataFrame:
    """Fragments and cases that resolve."""
    whole = resolved.groupBy(case).agg(F.bool_and(F.col("status") == "resolved").alias("whole"), F.count("*").alias("n"), F.count_if(F.col("status") == "resolved").alias("good"))
    return whole.agg(F.sum("n").alias("fragments"), F.sum("good").alias("resolved"), F.count("*").alias("cases"), F.count_if("whole").alias("whole_cases"))


def top_unresolved(resolved: DataFrame, name: Column, n: int = 20) -> DataFrame:
    """The most frequent names of each kind of failure."""
    counted = resolved.where("status <> 'resolved'").groupBy("status", name.alias("name")).count()
    return counted.withColumn("rank", F.row_number().over(W.partitionBy("status").orderBy(F.desc("count"), "name"))).where(F.col("rank") <= n)


def duplicate_keys(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def expected_count_check(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, diff) over the keys of either."""
    have = actual.groupBy(key).agg(F.count("*").alias("actual"))
    joined = expected.select(key, "expected").join(have, key, "full_outer")
    e, x = F.coalesce("expected", F.lit(0)), F.coalesce("actual", F.lit(0))
    return joined.select(key, e.alias("expected"), x.alias("actual"), (x - e).alias("diff"))


def corpus_assertions(rows: DataFrame, wanted: DataFrame, key: str, held_out: Column, excluded: Column, source: Column) -> DataFrame:
    """(problem, key) of what breaks the corpus's contract."""
    named = lambda df, p: df.select(F.lit(p).alias("problem"), F.col(key).cast("string").alias("key"))
    out = named(rows.select(key).distinct().join(wanted.select(key), key, "left_anti"), "unexpected")
    out = out.unionByName(named(wanted.select(key).distinct().join(rows.select(key), key, "left_anti"), "missing"))
    out = out.unionByName(named(rows.groupBy(key).count().where("count > 1"), "duplicate"))
    for problem, bad in (("held out", held_out), ("excluded role", excluded), ("no source", ~F.coalesce(source, F.lit(False)))):
        out = out.unionByName(named(rows.where(bad), problem))
    return out


def text_error_rates(pairs: DataFrame, key: str, reference: str, read: str, date: str) -> DataFrame:
    """(key, edits, length, rate, dates, found): edits per character of the reference, white space apart, and how many of its
    distinct dates the reading has. Nulls count as empty; long texts take linear memory."""
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "")
    dates = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(date), F.lit(0)))
    n, edits = F.length(bare(reference)), edit_distances(bare(reference), bare(read))
    return pairs.select(
        key,
        edits.alias("edits"),
        n.alias("length"),
        F.when(n > 0, edits / n).otherwise(0.0).alias("rate"),
        F.size(dates(reference)).alias("dates"),
        F.size(F.array_intersect(dates(reference), dates(read))).alias("found"),
    )


def score_field(expected: Column, actual: Column, unsure: Column) -> Column:
    """correct, wrong, or unsure for what is honestly not stated."""
    blank = F.coalesce((F.trim(actual) == "") | (actual == "未載明"), F.lit(True))
    return F.when(unsure | blank, "unsure").when(expected == actual, "correct").otherwise("wrong")


def valid_articles(rows: DataFrame, good: Column, name: str, number: str, order: str) -> DataFrame:
    """Rows that are good, of each name and number the first by order; other columns aren't kept."""
    return rows.where(good).groupBy(name, number).agg(F.min(order).alias(order))


def facet_values(rows: DataFrame, column: str) -> DataFrame:
    """(value): the distinct values of a column, without null, in order."""
    return rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")


def any_role(rows: DataFrame, key: str, role: str, wanted: str) -> DataFrame:
    """(key, has_role): whether any row of a key has the role."""
    return rows.groupBy(key).agg(F.bool_or(F.col(role) == wanted).alias("has_role"))


def corpus_union(*parts: DataFrame) -> DataFrame:
    """The parts by column name; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ordered_union(first: Column, second: Column) -> Column:
    """Both arrays' values, each once, in the order of first appearance."""
    return F.array_union(first, second)


def ordered_allowed(ids: Column, allowed: Column) -> Column:
    """The ids that are allowed, in their own order, each once."""
    return F.array_intersect(ids, allowed)


#: What a field holds that is honestly not stated, and the shell of a category's name.
NOT_STATED, UNSORTED, SHELL = ["未載明", "未收錄", ""], "未分類", ("^違反", "事件$")


def score_form(c: Column) -> Column:
    """The form in which values are compared: compatibility form, no white space, one kind of dash, no trailing 號."""
    return F.regexp_replace(F.translate(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"(?U)\s+", ""), "–—－~〜", "-----"), "號$", "")


def _three_way(unsure: Column, good: Column) -> Column:
    return F.when(unsure, "unsure").when(F.coalesce(good, F.lit(False)), "correct").otherwise("wrong")


def score_text(actual: Column, expected: Column, is_date: bool = False) -> Column:
    """correct or wrong by the compared forms, dates by the day if they parse; unsure for what isn't stated."""
    day = lambda c: once(parse_minguo_date(c), lambda d: format_minguo_date(d)) if is_date else F.lit(None).cast("string")
    compared = lambda c: F.struct(score_form(c).alias("form"), day(c).alias("day"))
    told = lambda x: F.coalesce(x["day"], x["form"])
    return once(F.struct(compared(actual).alias("a"), compared(expected).alias("e")), lambda x: _three_way(x["a"]["form"].isin(NOT_STATED), told(x["a"]) == told(x["e"])))


def score_category(actual: Column, expected: Column) -> Column:
    """As score_text without the shell of the names; an unsorted case is unsure, and an empty key is never met."""
    core = lambda c: F.regexp_replace(F.regexp_replace(c, SHELL[0], ""), SHELL[1], "")
    good = lambda x: once(core(x["e"]), lambda wanted: (wanted != "") & (core(x["a"]) == wanted))
    return once(F.struct(score_form(actual).alias("a"), score_form(expected).alias("e")), lambda x: _three_way(x["a"].isin([*NOT_STATED, UNSORTED]), good(x)))


def score_decision(actual: Column, expected: Column) -> Column:
    """A result's type by equality only; unsure without a draft."""
    return _three_way(F.regexp_replace(F.coalesce(actual, F.lit("")), r"(?U)\s+", "") == "", score_form(actual) == score_form(expected))


def score_screening(passed: Column, clause: Column, note: Column, expected_passed: Column, expected_clause: Column) -> Column:
    """A screening by its verdict and, if it failed, its clause; one that asks for review is unsure, whatever it says."""
    same = F.coalesce(passed, F.lit(False)) == F.coalesce(expected_passed, F.lit(False))
    return _three_way(F.regexp_replace(F.coalesce(note, F.lit("")), r"(?U)\s+", "") != "", same & (expected_passed | clause_key(score_form(clause)).eqNullSafe(expected_clause)))
