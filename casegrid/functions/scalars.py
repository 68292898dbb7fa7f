"""Column builders for dates, numerals, clauses, names, texts and keys. No Python runs on the rows but for normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import number, plain_digits, strip, wide
from pyspark.sql import types as T

#: The calendar's first year, full-width digits, numerals.
ERA_YEAR = 1911
FULL_WIDTH = "０１２３４５６７８９"
NUMERALS = "一二三四五六七八九"


def once(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, day), "yyyy-M-d")


def parse_minguo_date(c: Column) -> Column:
    """A date in any of three grammars, tried in order: Gregorian from 1912 on, year-month-day words of the republican
    era, era years with separators. The first that matches decides; a day that doesn't exist is null."""
    sep, end = r"\s*[./-]\s*", r"(?!\d)"
    era = r"^(?:中華民國|民國)?\s*(\d{1,3})\s*"
    western = wide(rf"^(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}}){end}")
    words = wide(rf"{era}年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日")
    marks = wide(rf"{era}[./-]\s*(\d{{1,2}}){sep}(\d{{1,2}}){end}")

    def read(s: Column) -> Column:
        groups = lambda p: F.struct(*[_part(s, p, i).alias(n) for i, n in ((1, "y"), (2, "m"), (3, "d"))])
        made = lambda p, shift: once(groups(p), lambda x: _date(number(x["y"]) + shift, plain_digits(x["m"]), plain_digits(x["d"])))
        late = once(_part(s, western, 1), number) > ERA_YEAR
        return F.when(s.rlike(western) & late, made(western, 0)).when(s.rlike(words), made(words, ERA_YEAR)).when(s.rlike(marks), made(marks, ERA_YEAR))

    return once(strip(c), read)


def format_minguo_date(d: Column, style: str = "full") -> Column:
    """full: with the era's name; short: year, month and day only; spaced: zero-padded with separators of spaces."""
    year, month, day = (F.year(d) - ERA_YEAR).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    if style == "full":
        return F.concat(F.lit("民國"), year, F.lit("年"), month, F.lit("月"), day, F.lit("日"))
    if style == "short":
        return F.concat(year, F.lit("年"), month, F.lit("月"), day, F.lit("日"))
    return F.concat(F.lit("民國 "), year, F.lit(" 年 "), F.lpad(month, 2, "0"), F.lit(" 月 "), F.lpad(day, 2, "0"), F.lit(" 日"))


def amend_date(c: Column) -> Column:
    """Spaced form of a date that parses; else a mark that it isn't recorded."""
    return F.coalesce(format_minguo_date(parse_minguo_date(c), "spaced"), F.lit("未收錄"))


def fullwidth_digits(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", FULL_WIDTH)


def cjk_number(c: Column, most: int = 99) -> Column:
    """一 to 九十九, 十 alone being 10; null for anything else or above most."""
    digit = lambda x: F.when(F.length(x) == 1, F.nullif(F.instr(F.lit(NUMERALS), x), F.lit(0)))
    parts = F.split(c, "十")
    tens, ones = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    value = F.when(F.size(parts) == 1, digit(c)).when(F.size(parts) == 2, F.when(tens == "", F.lit(1)).otherwise(digit(tens)) * 10 + F.when(ones == "", F.lit(0)).otherwise(digit(ones)))
    return F.when(value <= most, value)


def to_cjk_number(n: Column) -> Column:
    """The numeral of 1 to 99."""
    numeral = lambda x: F.substring(F.lit(NUMERALS), x, F.lit(1))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    return F.concat(F.when(tens == 0, "").when(tens == 1, "十").otherwise(F.concat(numeral(tens), F.lit("十"))), F.when(ones == 0, "").otherwise(numeral(ones)))


def parse_clause(c: Column, default_article: int = 77) -> Column:
    """struct(article, clause) from forms like 77條第2款 and 第二款; null if there is none."""
    number = r"([0-9]+|[一二三四五六七八九十]+)"

    def read(x: Column) -> Column:
        article = F.coalesce(_part(x, r"([0-9]+)\s*條", 1).try_cast("int"), F.lit(default_article))
        clause = once(_part(x, rf"第\s*{number}\s*款", 1), lambda raw: F.when(raw.rlike("^[0-9]"), raw.try_cast("int")).otherwise(cjk_number(raw, 19)))
        return once(clause, lambda n: F.when(n.isNotNull(), F.struct(article.alias("article"), n.alias("clause"))))

    return once(c, read)


def clause_key(c: Column) -> Column:
    """77(2) of a clause; null if it has none."""
    named = lambda parsed: F.when(parsed.isNotNull(), F.concat(parsed["article"].cast("string"), F.lit("("), parsed["clause"].cast("string"), F.lit(")")))
    return once(parse_clause(c), named)


def section_key(c: Column) -> Column:
    """§77(2) -> 77(2); anything else is empty."""
    return _part(c, r"^§(77\([0-9]+\))$", 1)


def canonical_category(c: Column, prefix: str, suffix: str, aliases: dict[str, str], buckets: list[str], other: str) -> Column:
    """Without its shell, with its alias, and one of a closed set or other."""
    bare = F.regexp_replace(F.regexp_replace(c, f"^{prefix}", ""), f"{suffix}$", "")
    named = F.coalesce(*[F.when(bare == k, F.lit(v)) for k, v in aliases.items()], bare)
    return F.when(named.isin(*buckets), named).otherwise(other)


def readable_ratio(c: Column, allowed: str) -> Column:
    """Share of characters in an allowed class; 0 for none."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0.0).otherwise(1 - F.length(F.regexp_replace(c, f"[{allowed}]", "")) / F.length(c))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_token(c: Column, compose: bool = True) -> Column:
    """Compatibility form without white space, with one kind of dash and without a trailing 號."""
    base = nfkc(c) if compose else c
    return F.regexp_replace(F.translate(F.regexp_replace(base, r"(?U)\s+", ""), "‐‑‒–—―−", "-------"), "號$", "")


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def head_tail(c: Column, n: int = 2000, mark: str = "…") -> Column:
    """The first and last n characters around a mark, where the text is longer than both."""
    return F.when(F.length(c) <= 2 * n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(mark), F.right(c, F.lit(n))))


def sentence_summary(c: Column, most: int = 200, stop: str = "。") -> Column:
    """At most so many characters, to the last stop among them if there is one."""
    head = F.substring(c, 1, most)
    upto = _part(head, f"(?s)^(.*{stop})", 1)
    return F.when(F.length(c) <= most, c).when(upto != "", upto).otherwise(head)


def filename_metadata(c: Column, grammars: dict[str, tuple[str, list[str]]]) -> Column:
    """struct(grammar, fields map) of the first grammar (pattern, field names) that the name fits; null if none does."""
    made = [
        F.when(c.rlike(p), F.struct(F.lit(name).alias("grammar"), F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[_part(c, p, i + 1) for i in range(len(fields))])).alias("fields")))
        for name, (p, fields) in grammars.items()
    ]
    return F.coalesce(*made)


def derive_url(code: Column, number: Column, raw: Column, template: tuple[str, str]) -> Column:
    """An address from a code and a number; without a code the raw address if it is one; else null."""
    return F.when(code.isNotNull(), F.concat(F.lit(template[0]), code, F.lit(template[1]), number)).when(raw.rlike("^https?://"), raw)


def closed_type(c: Column, known: list[str], named: str, other: str | None) -> Column:
    """named for a closed set of names, other for the rest; if other is None, the rest is an error."""
    rest = F.lit(other) if other is not None else F.raise_error(F.concat(F.lit("unknown name: "), F.coalesce(c, F.lit("null"))))
    return F.when(c.isin(*known), named).otherwise(rest)


def clean_text(c: Column, suffix: str = r"\([0-9]+\)$", compose: bool = True) -> Column:
    """Composed, without NUL characters and a copy's suffix."""
    bare = F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), suffix, "")
    return nfc(bare) if compose else bare


def metadata(c: Column) -> Column:
    """A JSON text as a VARIANT, parsed once for every path that is asked of it; null where it isn't JSON."""
    return F.try_parse_json(c)


def metadata_attributes(c: Column, paths: list[str]) -> Column:
    """map of the paths that a VARIANT has, as text; empty values and JSON nulls go. A dot parts the names of a path."""
    names = lambda p: "".join(f"['{n}']" for n in p.split("."))
    values = F.map_from_arrays(F.array(*map(F.lit, paths)).cast("array<string>"), F.array(*[F.try_variant_get(c, f"${names(p)}", "string") for p in paths]).cast("array<string>"))
    return F.map_filter(values, lambda _, v: v.isNotNull() & (v != ""))


def metadata_project(c: Column, keys: list[str]) -> Column:
    """map of the keys that a JSON text has; empty values go."""
    values = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.get_json_object(c, f"$.{k}") for k in keys]))
    return F.map_filter(values, lambda _, v: v.isNotNull() & (v != ""))


def join_notes(*notes: Column, sep: str = "；") -> Column:
    """The notes that aren't empty."""
    return F.array_join(F.filter(F.array(*notes), lambda x: x.isNotNull() & (x != "")), sep)


def payload_bytes(**columns: Column) -> Column:
    """UTF-8 bytes of names and values."""
    return sum((F.lit(len(k.encode())) + F.coalesce(F.octet_length(v.cast("string")), F.lit(0)) for k, v in columns.items()), F.lit(0))


def build_input_text(slots: dict[str, Column]) -> Column:
    """The slots' texts under their labels; an absent one leaves its label."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"【{label}】\n"), F.coalesce(c, F.lit(""))) for label, c in slots.items()])


def retrieval_query_text(category: Column, issues: Column, facts: Column, reasons: Column) -> Column:
    """struct(short, long): category and first issue, clipped; facts and reasons, clipped, with the short one if empty."""
    short = F.trim(F.concat_ws(" ", category, F.substring(F.get(issues, F.lit(0)), 1, 40)))
    long = F.substring(F.concat_ws("\n", facts, reasons), 1, 900)
    return F.struct(short.alias("short"), F.coalesce(F.nullif(long, F.lit("")), short).alias("long"))


def key_problem(key: Column, exists: Column, reserved: list[str]) -> Column:
    """Why a key can't be used; null if it can. A blank key gets one of its own."""
    return F.when(F.coalesce(F.trim(key), F.lit("")) == "", None).when(~key.rlike(r"(?U)^[\w-]{1,64}$"), "malformed").when(F.lower(key).isin(*reserved), "reserved").when(exists, "taken")


def valid_citations(keys: Column) -> Column:
    """Keys whose part after # is a number or two with a dash."""
    return F.filter(keys, lambda x: x.rlike("^[^#]+#[0-9]+(-[0-9]+)?$"))


#: The nine rules of the safety screen. Name and pattern. Digits are those of any script, a dot stops at a
#: line feed only, and digit guards keep parts of longer numbers out. An address starts where its run of characters does.
SCREENING_RULES = {
    "id_number": r"(?<![A-Za-z0-9])[A-Z][12]\p{Nd}{8}(?!\p{Nd})",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "mobile": r"(?<!\p{Nd})09\p{Nd}{2}[- ]?\p{Nd}{3}[- ]?\p{Nd}{3}(?!\p{Nd})",
    "card": r"(?<!\p{Nd})(?:\p{Nd}[ -]?){13,19}(?!\p{Nd})",
    "account": r"(?d)(?:銀行帳號|金融帳號|信用卡號|存摺帳號|付款帳號).{0,24}\p{Nd}{5,}",
    "address": r"(?U)(?:戶籍地址|居住地址|通訊地址|住址)[\s\x1c-\x1f]*[：:]",
    "medical": r"病歷|診斷證明|身心障礙|精神疾病|罹患|住院|就醫|醫院診療",
    "identity": r"(?d)(?:身分證字號|國民身分證|統一編號).{0,24}[A-Z0-9]{6,}",
    "injected": r"(?iu)<script(?![\p{L}\p{N}_])|javascript:|ignore previous instructions|忽略先前指示",
}


def screening_findings(c: Column, rules: dict[str, str] | None = None) -> Column:
    """Names of the rules that a text breaks."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in (rules or SCREENING_RULES).items()]))


def holdout_filter(rows: DataFrame, year: Column, held: list[int]) -> tuple[DataFrame, DataFrame]:
    """(rows of other years, how many were dropped of each). A null year stays."""
    out = F.coalesce(year.isin(*held), F.lit(False))
    return rows.where(~out), rows.where(out).groupBy(year.alias("year")).agg(F.count("*").alias("dropped"))


def chunk_key(source: Column, place: Column, pieces: Column) -> Column:
    """source#place, and #p with the number from 1 where a document has several pieces."""
    return F.concat(source, F.lit("#"), place.cast("string"), F.when(pieces > 1, F.concat(F.lit("#p"), (place + 1).cast("string"))).otherwise(""))


def chunk_body(header: Column, piece: Column) -> Column:
    """A piece below its document's header in brackets."""
    return F.concat(F.lit("["), header, F.lit("]\n"), piece)


def indexed_role(role: Column, left_out: list[str]) -> Column:
    """Whether rows of a role go into the index; those without a role don't."""
    return ~role.isin(*left_out)


def article_number(number: Column) -> Column:
    """An article's number as it is; one that isn't a number, or a number with a part, is an error."""
    good = number.cast("string").rlike("^[0-9]+(-[0-9]+)?$")
    return F.when(good, number).otherwise(F.raise_error(F.lit("bad article number")))


def list_filter(search: str | None, texts: list[Column], status: Column, wanted: str | None, day: Column, until: Column, days: int | None) -> Column:
    """Cases that any text finds, of a status, no older than so many days; a part that isn't given lets all pass."""
    out = F.lit(True)
    if search:
        found = F.lit(False)
        for t in texts:
            found = found | F.lower(t.cast("string")).contains(search.lower())
        out = out & found
    if wanted is not None:
        out = out & (status == wanted)
    return out if days is None else out & (day >= F.date_sub(until, days))
