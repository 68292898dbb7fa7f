"""Reading and writing the corpus's files: JSON lines, files by category, link lists, calendars, nested tables, pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their number from 1 in the file.

    Files are read in splits as always, so a file may be larger than any memory. The lines of each split are counted in a first
    pass, and the counts of a file's earlier splits are added to the places in a split. A split's lines follow each other in
    one task, and the same files are dealt to the same tasks in both passes."""
    here = lambda: spark.read.text(path).select(F.col("_metadata.file_path").alias("path_"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start_"), F.monotonically_increasing_id().alias("at_"), "value")
    splits = here().groupBy("path_", "start_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = F.sum("n_").over(W.partitionBy("path_").orderBy("start_")) - F.col("n_")
    offsets = splits.select("path_", "start_", (before - F.col("first_") + 1).alias("offset_"))
    return here().join(offsets, ["path_", "start_"]).select("file", (F.col("at_") + F.col("offset_")).alias("line"), "value")


def jsonl_source(spark: SparkSession, path: str, schema: str, strict: bool = True, skip_missing: bool = False, numbered: bool = False, counted: bool = True) -> DataFrame:
    """Rows of JSON lines with file, the file's name. Blank lines are skipped. strict: a malformed line fails, with its
    file, number and text; else it comes as a row of nulls with the line in corrupt. numbered: with line, the number from 1 in
    the file, of each row. skip_missing: a path that isn't there gives no rows; else it is an error.

    Numbers take a pass that counts the lines of each split. counted false: strict reading does without it, and an error
    names the file and the text only."""
    columns = StructType.fromDDL(f"{schema}, corrupt string")
    more = "file string, line long" if numbered else "file string"
    if skip_missing and not _exists(spark, path):
        none = spark.createDataFrame([], StructType.fromDDL(f"{schema}, corrupt string, {more}"))
        return none.drop("corrupt") if strict else none
    if numbered or (strict and counted):
        lines = numbered_lines(spark, path).where(F.col("value").rlike(r"(?s)[^ \t\r\n]"))
        raw = lines.select(F.from_json("value", columns, _PERMISSIVE).alias("x"), "file", "line").select("x.*", "file", "line")
        where = F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"))
    else:
        raw = spark.read.schema(columns).json(path, **_PERMISSIVE).withColumn("file", F.col("_metadata.file_name"))
        where = F.col("file")
    if not strict:
        return raw
    message = F.concat(F.lit("malformed line in "), where, F.lit(": "), F.substring("corrupt", 1, 80))
    return raw.where(F.when(F.col("corrupt").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop(*(("corrupt",) if numbered else ("corrupt", "line")))


_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at the path, in any store that Spark reads."""
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, text) of lines that aren't JSON of the schema, with their number from 1 in the file."""
    rows = jsonl_source(spark, path, schema, strict=False, numbered=True)
    return rows.where(F.col("corrupt").isNotNull()).select("file", "line", F.col("corrupt").alias("text"))


def bucketed_source(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    """Rows of many files with bucket, taken from the file's or folder's name; a name that doesn't fit is an error."""
    rows = spark.read.schema(schema).json(path, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path"))
    found = F.regexp_extract("file", pattern, 1)
    return rows.withColumn("bucket", F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no bucket in "), F.col("file"))))).drop("file")


def first_links(rows: DataFrame, key: str, url: str, order: str, keep: Column) -> DataFrame:
    """(key, url): of a list's rows of a category with web addresses, the first of each key."""
    good = rows.where(keep & F.col(url).rlike("^https?://"))
    return good.groupBy(key).agg(F.min_by(url, order).alias(url))


def closed_weekdays(rows: DataFrame, date: str, flag: str, label: str, file_pos: str, default: str = "放假日") -> DataFrame:
    """(day, label) of official calendar rows: closed days that aren't on a weekend. Of a year's files the last listed holds."""
    parsed = rows.withColumn("day", F.try_to_date(F.col(date), "yyyyMMdd")).where(F.col("day").isNotNull())
    latest = parsed.groupBy(F.year("day").alias("year_")).agg(F.max(file_pos).alias("latest_"))  # a row for each year
    closed = parsed.join(latest, F.year("day") == F.col("year_")).where((F.col(file_pos) == F.col("latest_")) & (F.col(flag) == "2") & (F.weekday("day") < 5))
    return closed.select("day", F.coalesce(F.nullif(F.trim(F.col(label)), F.lit("")), F.lit(default)).alias("label"))


def transit_matrix(blocks: DataFrame, column: str) -> DataFrame:
    """(agency, residence, days) of nested maps in JSON text; later blocks of an agency add to it."""
    table = F.from_json(F.col(column), "map<string,map<string,int>>")
    return blocks.select(F.explode(table).alias("agency", "row")).select("agency", F.explode("row").alias("residence", "days")).distinct()


def html_to_text(c: Column) -> Column:
    """Without scripts, tags as line breaks, without blank lines."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<script.*?</script>", ""), r"<[^>]+>", "\n")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def bucketed_sink(rows: DataFrame, path: str, by: str) -> None:
    """One folder of JSON lines for each category."""
    rows.write.partitionBy(by).mode("overwrite").json(path)
