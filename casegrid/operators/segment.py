"""Texts to rows: sections, items, articles, chunks and citations. Patterns are parameters; the defaults are the decisions' own."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.functions.patterns import strip, wide
from casegrid.functions.scalars import once

#: Numerals, and the law names that citations are looked for under, the longest first.
_NUM = "[一二三四五六七八九十百]+"
LAW_NAMES = [
    "行政院及各級行政機關訴願審議委員會審議規則",
    "違反廢棄物清理法罰鍰額度裁罰準則",
    "一般廢棄物回收清除處理辦法",
    "道路交通管理處罰條例",
    "公寓大廈管理條例",
    "毒品危害防制條例",
    "空氣污染防制法",
    "工廠管理輔導法",
    "政府資訊公開法",
    "水污染防治法",
    "廢棄物清理法",
    "洗錢防制法",
    "都市更新條例",
    "行政程序法",
    "噪音管制法",
    "社會救助法",
    "都市計畫法",
    "行政訴訟法",
    "行政執行法",
    "停車場法",
    "地方制度法",
    "行政罰法",
    "土地稅法",
    "訴願法",
    "建築法",
    "民法",
]
SAME_LAW = ["同法", "同條例", "同辦法", "同細則", "同準則"]


def loose(word: str) -> str:
    """A pattern for a word that line breaks or spaces may part."""
    return wide(r"\s*").join(word)


# The words that border a decision's sections.
_ALONE = "(?<![一-龥])"
_MAIN, _FACTS, _REASONS = (_ALONE + loose(w) for w in ("主文", "事實", "理由"))
_SIGNED = loose("訴願審議委員會") + f"(?:{loose('兼')})?" + loose("主任委員")
_CONCLUSION = loose("綜上論結") + "|" + loose("決定如主文")


def decision_sections(c: Column, most_main: int = 200) -> Column:
    """struct(problem, main, facts, reasons) of a decision; problem is null where the borders are certain."""
    head, either = rf"(?s)^.{{0,298}}?{_MAIN}", f"{_FACTS}|{_REASONS}"

    # Each step is worked out once and handed on, as later ones use it more than once.
    def begun(tail: Column) -> Column:
        return F.struct(tail.rlike(head).alias("has_main"), F.regexp_extract(tail, f"{head}(.*)$", 1).alias("after"))

    def parted(x: Column) -> Column:
        main = strip(F.regexp_extract(x["after"], f"(?s)^(.*?)(?:{either})", 1))
        rest = F.regexp_extract(x["after"], f"(?s)^.*?((?:{either}).*)$", 1)
        return F.struct(x["has_main"].alias("has_main"), x["after"].rlike(either).alias("has_rest"), main.alias("main"), rest.alias("rest"))

    def opened(x: Column) -> Column:
        inner = F.regexp_extract(x["rest"], f"(?s)^(?:{loose('事實')}|{loose('理由')})(.*)$", 1)
        return x.withField("facts_first", x["rest"].rlike(f"^{loose('事實')}")).withField("inner", inner)

    def reasoned(x: Column) -> Column:
        return x.withField("has_reasons", ~x["facts_first"] | x["inner"].rlike(_REASONS))

    def given(x: Column) -> Column:
        both, inner = x["facts_first"] & x["has_reasons"], x["inner"]
        facts = F.when(both, strip(F.regexp_extract(inner, f"(?s)^(.*?){_REASONS}", 1))).otherwise("")
        return x.withField("facts", facts).withField("given", F.when(both, F.regexp_extract(inner, f"(?s){_REASONS}(.*)$", 1)).otherwise(inner))

    def closed(x: Column) -> Column:
        return x.withField("signed", x["given"].rlike(_SIGNED)).withField("reasons", strip(F.regexp_extract(x["given"], f"(?s)^(.*?){_SIGNED}", 1)))

    def judged(x: Column) -> Column:
        problem = (
            F.when(~x["has_main"], "no main text")
            .when(~x["has_rest"], "no facts or reasons")
            .when(F.length(x["main"]) > most_main, "main text too long")
            .when(x["has_reasons"] & ~x["signed"], "no signature")
            .when(x["has_reasons"] & (x["reasons"] == ""), "no reasons")
            .when(~x["has_reasons"] & (~x["signed"] | ~x["reasons"].rlike(_CONCLUSION)), "facts without reasons")
        )
        return x.withField("problem", problem)

    def shown(x: Column) -> Column:
        return F.struct(x["problem"].alias("problem"), *[F.when(x["problem"].isNull(), x[n]).alias(n) for n in ("main", "facts", "reasons")])

    anchored = lambda body: F.when(body.rlike(loose("決定如下")), F.regexp_extract(body, wide(rf"(?s){loose('決定如下')}\s*[:：]?(.*)$"), 1)).otherwise(body)
    out = strip(F.regexp_extract(c, wide(r"(?s)^(?:.*[全內]\s*文[：:])?(.*)$"), 1))
    for step in (anchored, begun, parted, opened, reasoned, given, closed, judged, shown):
        out = once(out, step)
    return out


def labelled_sections(docs: DataFrame, key: str, text: str, heading: str, unique: bool = False) -> DataFrame:
    """(key, section, name, body): texts parted at whole-line headings, whose name is the pattern's first group, which isn't
    empty. Without any, or if unique with a repeated one, the whole text is one section named null. Empty sections are left out,
    and so are null texts.

    Headings are found once and marked; the text is parted at the marks within its row, so nothing is shuffled."""
    line = "^(?:" + heading.removeprefix("^").removesuffix("$") + ")$"
    parts = F.split(F.regexp_replace(_marked(F.col(text)), f"(?md){line}", f"{_MARK}m$1{_MARK}n"), _MARK + "m")
    headed = lambda x: F.split(x, _MARK + "n", 2)
    section = lambda number, name, body: F.struct(number.cast("int").alias("section"), name.alias("name"), _unmarked(strip(body)).alias("body"))

    def sections(all_parts: Column) -> Column:
        named = F.slice(all_parts, F.lit(2), F.greatest(F.size(all_parts) - 1, F.lit(0)))
        name = lambda x: _unmarked(F.get(headed(x), F.lit(0)))
        whole = F.size(all_parts) == 1
        if unique:
            whole = whole | (F.size(F.array_distinct(F.transform(named, name))) < F.size(named))
        each = F.transform(named, lambda x, i: section(i + 1, name(x), F.get(headed(x), F.lit(1))))
        return F.when(whole, F.array(section(F.lit(0), F.lit(None).cast("string"), _marked(F.col(text))))).otherwise(each)

    out = docs.select(key, F.explode(once(parts, sections)).alias("s")).select(key, "s.section", "s.name", "s.body")
    return out.where("body <> ''")


def header_fields(c: Column, labels: dict[str, str]) -> Column:
    """map of the labels' values: labels are found in order, each after the one before; a value runs to the next found one."""
    empty = F.array().cast("array<struct<name:string,from:int,to:int>>")

    def found(text: Column, acc: Column, name: str, pattern: str) -> Column:
        def placed(x: Column) -> Column:
            begin = acc["at"] + F.instr(x["rest"], x["hit"]) - 1
            return once(begin, lambda b: F.struct(b.alias("from"), (b + F.length(x["hit"])).alias("to")))

        def told(x: Column) -> Column:
            mark = lambda m: F.struct(m["to"].alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(name).alias("name"), m["from"].alias("from"), m["to"].alias("to")))).alias("out"))
            return F.when(x["hit"] != "", once(placed(x), mark)).otherwise(acc)

        rest = F.substring(text, acc["at"], F.length(text))
        return once(once(rest, lambda r: F.struct(r.alias("rest"), F.regexp_extract(r, pattern, 0).alias("hit"))), told)

    def fields(text: Column, marks: Column) -> Column:
        until = lambda i: F.coalesce(F.get(marks, i + 1)["from"], F.length(text) + 1)
        return F.map_from_entries(F.transform(marks, lambda m, i: F.struct(m["name"].alias("k"), strip(F.substring(text, m["to"], until(i) - m["to"])).alias("v"))))

    def read(text: Column) -> Column:
        # A step a label, so that each has its pattern as a constant, which is compiled once.
        state = F.struct(F.lit(1).alias("at"), empty.alias("out"))
        step = lambda *label: lambda acc: found(text, acc, *label)
        for label in labels.items():
            state = once(state, step(*label))
        return once(state["out"], lambda marks: fields(text, marks))

    return once(c, read)


#: What marks places in a text while it is taken apart, and how the texts' own ones are written meanwhile.
_MARK, _OWN = "\x01", "\x01e"


def _marked(c: Column) -> Column:
    return F.replace(c, F.lit(_MARK), F.lit(_OWN))


def _unmarked(c: Column) -> Column:
    return F.replace(c, F.lit(_OWN), F.lit(_MARK))


def split_items(c: Column, marker: str = wide(rf"(?:^|(?<=[。\n」]))(?=\s*{_NUM}\s*、)"), quotes: tuple[str, str] = ("「", "」")) -> Column:
    """array of top-level items: parted before markers that aren't inside open quotes; what leads is an item too. A marker is
    inside where an odd number of quotation marks stands before it.

    One pass, in time by the length: the text is parted at the quotation marks, every other part is outside, and markers
    there get a mark at which the text is parted again. Null gives null, and a blank text none."""
    either = "".join(map(re.escape, quotes))

    def items(text: Column) -> Column:
        opens = F.substring(text, 1, 1).isin(*quotes).cast("int")
        parts = F.transform(F.split(text, f"(?=[{either}])"), lambda x, i: F.when((i + opens) % 2 == 0, F.regexp_replace(x, marker, _MARK + "m")).otherwise(x))
        return F.split(F.array_join(parts, ""), _MARK + "m")

    return F.filter(F.transform(once(strip(_marked(c)), items), lambda x: _unmarked(strip(x))), lambda x: x != "")


def appeal_items(c: Column) -> Column:
    """struct(facts, reasons) lists of an appeal's headed parts; both empty where either can't be parted, or in an answer."""
    gap = wide(r"\s*")
    head = lambda w: rf"(?m)^{gap}{w[0]}{gap}{w[1]}{gap}$"
    tail = rf"(?m)^{gap}(?:附{gap}送{gap}證{gap}件|證{gap}物|此{gap}致|收受或知悉行政處分日期)"
    answer = c.rlike(rf"訴{gap}願{gap}答{gap}辯{gap}書|答{gap}辯{gap}聲{gap}明")
    facts = F.regexp_extract(c, f"(?s){head('事實')}(.*?){head('理由')}", 1)
    after = F.regexp_extract(c, f"(?s){head('事實')}.*?{head('理由')}(.*)$", 1)
    reasons = F.get(F.split(after, tail), F.lit(0))
    lines = lambda x: F.array_join(F.transform(F.split(x, "\n"), strip), "")
    # What leads before the first marker isn't an item.
    items = lambda x: F.filter(F.transform(F.slice(F.split(x, rf"(?m)^{gap}[一二三四五六七八九十]+、"), F.lit(2), F.lit(1_000_000)), lines), lambda i: i != "")
    a, b = items(facts), items(reasons)
    good = ~answer & (F.size(a) > 0) & (F.size(b) > 0)
    none = F.array().cast("array<string>")
    return F.struct(F.when(good, a).otherwise(none).alias("facts"), F.when(good, b).otherwise(none).alias("reasons"))


# How statutes write chapters, articles and the items of lists.
CHAPTER = r"^[ \t]*(第[ \t]*[一二三四五六七八九十百千零]+(?:之[一二三四五六七八九十百千零]+)?[ \t]*[編章節款目][^\n]*)$"
ARTICLE = wide(r"^[ \t]*第[ \t]*(\d+(?:-\d+)?)[ \t]*條")
LIST_MARK = wide(r"^(\d+\s|[一二三四五六七八九十百千]+、|（[一二三四五六七八九十百千]+）)")


def split_articles(docs: DataFrame, key: str, text: str, chapter: str = CHAPTER, article: str = ARTICLE, mark: str = LIST_MARK, noise: str = "^(所有條文|法規名稱|法規類別|列印時間|生效狀態)") -> DataFrame:
    """(key, place, chapter, article_no, body) of statutes: noise lines go, wrapped lines are joined unless a list marker
    begins them, and the chapter is carried on. A chapter ends the article before it, so what follows it before the next
    article belongs to none; a line that is both counts as a chapter. Null texts give none.

    A text's lines are filtered and marked by their kind, put together, and parted at chapters and then at articles, within its
    row: nothing is shuffled, and each article has its chapter beside it."""

    def kind(raw: Column) -> Column:
        name, number = strip(F.regexp_extract(raw, chapter, 1)), F.regexp_extract(raw, article, 1)
        line = strip(raw)
        return (
            F.when(name != "", F.concat(F.lit(_MARK + "c"), name, F.lit(_MARK + "n")))
            .when(number != "", F.concat(F.lit(_MARK + "a"), number, F.lit(_MARK + "n"), strip(F.regexp_replace(raw, article, ""))))
            .when(line.rlike(mark), F.concat(F.lit("\n"), line))
            .otherwise(line)
        )

    lines = F.filter(F.split(_marked(F.col(text)), "\n"), lambda raw: (strip(raw) != "") & ~strip(raw).rlike(noise))
    chapters = F.split(F.array_join(F.transform(lines, kind), ""), _MARK + "c")

    def articles(part: Column, i: Column) -> Column:
        name = F.when(i > 0, F.get(F.split(part, _MARK + "n", 2), F.lit(0))).otherwise("")
        found = F.split(part, _MARK + "a")
        headed = lambda x: F.split(x, _MARK + "n", 2)
        # The first list marker begins no new line.
        body = lambda x: F.regexp_replace(F.get(headed(x), F.lit(1)), "^\n", "")
        each = lambda x: F.struct(_unmarked(name).alias("chapter"), _unmarked(F.get(headed(x), F.lit(0))).alias("article_no"), _unmarked(body(x)).alias("body"))
        return F.transform(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), each)

    rows = docs.select(key, F.posexplode(F.flatten(F.transform(chapters, articles))).alias("pos", "x"))
    return rows.select(key, (F.col("pos") + 1).cast("int").alias("place"), "x.chapter", "x.article_no", "x.body")


def pack_chunks(c: Column, whole: int = 2000, most: int = 1500) -> Column:
    """array of chunks: a short text whole; else paragraphs, or lines where there is one paragraph only, packed greedily. A
    unit over the limit stays whole."""
    parts = lambda text, p: F.filter(F.transform(F.split(text, p), strip), lambda x: x != "")

    def step(acc: Column, x: Column) -> Column:
        fits = F.length(acc["now"]) + 1 + F.length(x) <= most
        return (
            F.when(acc["now"] == "", F.struct(acc["done"].alias("done"), x.alias("now")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit("\n"), x).alias("now")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), x.alias("now")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    packed = lambda units: F.aggregate(units, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    units = lambda text: once(parts(text, r"\n\s*\n"), lambda paragraphs: packed(F.when(F.size(paragraphs) > 1, paragraphs).otherwise(parts(text, "\n"))))
    return once(strip(c), lambda text: F.when(F.length(text) < whole, F.array(text)).otherwise(units(text)))


# Patterns of paragraph roles, as the decisions are worded, in the order of the operator's rules.
ROLE_PATTERNS = {
    "conclusion": _CONCLUSION,
    "enum": wide(rf"^(?:{_NUM}\s*、|[（(]{_NUM}[）)])"),
    "citing": "^(?:又|另|次|再)?(按|依|查)",
    "article": wide(r"第\s*\d+\s*條"),
    "rebuttal": "主張.*?(等語|云云)",
    "specific": "系爭|卷查|經查|查本件|查本案",
    "going_on": "^(?:又|另|惟)(?!.{0,2}(按|依|查))",
}


def paragraph_role(section: Column, c: Column, last: Column, p: dict[str, str] | None = None, facts: str = "事實") -> Column:
    """The first of eight rules that fits."""
    p = p or ROLE_PATTERNS
    bare = strip(F.regexp_replace(c, p["enum"], ""))
    specific = c.rlike(p["specific"])
    return (
        F.when(section == facts, "事實敘述")
        .when(last & c.rlike(p["conclusion"]), "結語")
        .when(bare.rlike(p["citing"]), "法規引述")
        .when((F.size(F.regexp_extract_all(c, F.lit(p["article"]), F.lit(0))) >= 2) & ~specific, "法規引述")
        .when(c.rlike(p["rebuttal"]), "其他項次")
        .when(bare.rlike(p["going_on"]), "接續段")
        .when(specific, "本案論理")
        .when(c.rlike(p["enum"]), "其他項次")
        .otherwise("本案論理")
    )


def extract_citations(docs: DataFrame, key: str, text: str, names: list[str] | None = None, same: list[str] | None = None, tail: str = wide(r"第\s*(\d+)\s*條(?:之\s*(\d+))?")) -> DataFrame:
    """(key, law, number, pos): each citation once, by first appearance. A word for the same law means the last one named."""
    names, same = names or LAW_NAMES, same or SAME_LAW
    pattern = F.lit(f"({'|'.join(names + same)}){tail}")
    groups = [F.regexp_extract_all(text, pattern, F.lit(i)).alias(n) for i, n in ((1, "law"), (2, "no"), (3, "sub"))]
    rows = docs.select(key, F.posexplode(F.arrays_zip(*groups)).alias("pos", "x")).select(key, "pos", "x.*")
    named = F.last(F.when(~F.col("law").isin(*same), F.col("law")), ignorenulls=True).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    number = F.concat("no", F.when(F.col("sub") != "", F.concat(F.lit("-"), F.col("sub"))).otherwise(""))
    found = rows.select(key, named.alias("law"), number.alias("number"), "pos").where("law is not null")
    return found.groupBy(key, "law", "number").agg(F.min("pos").alias("pos"))


def parse_citation_string(rows: DataFrame, key: str, text: str, pattern: str = wide(r"^(.+?)\s*第(\d+)條(?:之(\d+))?(?:第\d+項)?(?:第\d+款)?$")) -> DataFrame:
    """(key, pos, fragment, name, number): fragments of a list; name and number are null where one doesn't parse."""
    parts = rows.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "[；;]")).alias("pos", "raw")).select(key, "pos", strip(F.col("raw")).alias("fragment")).where("fragment <> ''")
    get = lambda i: F.nullif(F.regexp_extract("fragment", pattern, i), F.lit(""))
    return parts.select(key, "pos", "fragment", strip(get(1)).alias("name"), F.concat(get(2), F.coalesce(F.concat(F.lit("-"), get(3)), F.lit(""))).alias("number"))


def clause_of(c: Column, clause: str = wide(r"訴願法第\s*77\s*條第\s*(\d+)\s*款"), second: str = wide(r"訴願法第\s*81\s*條|另為適法之處分"), third: str = wide(r"訴願法第\s*79\s*條")) -> Column:
    n = F.regexp_extract(c, clause, 1)
    return F.when(n != "", F.concat(F.lit("§77("), n, F.lit(")"))).when(c.rlike(second), "§81").when(c.rlike(third), "§79").otherwise("")


def result_of(c: Column, terms: list[str] = ("部分", "不受理", "駁回", "撤銷"), other: str = "其他") -> Column:
    return F.coalesce(*[F.when(c.contains(t), F.lit(t)) for t in terms], F.lit(other))


def last_date(c: Column, pattern: str = wide(r"中華民國\s*\d+\s*年\s*\d+\s*月\s*\d+\s*日")) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(-1))


def districts_from_note(c: Column, pattern: str = "([一-龥]{2}市)（([一二])）[:：]?([^。；]+)") -> Column:
    """map of group -> districts from a note's records."""
    flat = F.regexp_replace(c, wide(r"[─\s]"), "")
    groups = [F.regexp_extract_all(flat, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "city"), (2, "part"), (3, "names"))]
    entry = lambda x: F.struct(F.concat(x["city"], F.lit("（"), x["part"], F.lit("）")).alias("k"), F.filter(F.split(x["names"], "[、，]"), lambda d: d.endswith("區")).alias("v"))
    return F.map_from_entries(F.transform(F.arrays_zip(*groups), entry))
