"""Business days and deadlines: open-day lookup, statutory periods, travel days, reference coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rank import small


def calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame) -> DataFrame:
    """(day, open, next_open) for each day: the first day from it on that is neither on a weekend nor a holiday.

    One row for each day, so the window over the whole table is as long as the calendar, whatever the data.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    closed = holidays.select(F.col("day"), F.lit(True).alias("closed")).distinct()
    marked = days.join(F.broadcast(closed), "day", "left").withColumn("open", (F.weekday("day") < 5) & F.col("closed").isNull()).drop("closed")
    ahead = W.orderBy("day").rowsBetween(0, W.unboundedFollowing)
    return marked.withColumn("next_open", F.min(F.when(F.col("open"), F.col("day"))).over(ahead))


def business_day_roll(rows: DataFrame, day: str, days: DataFrame, out: str) -> DataFrame:
    """rows with out, the first open day from day on; null where the calendar doesn't reach. The calendar is broadcast: a
    row for each day."""
    roll = days.select(F.col("day").alias("roll_day_"), F.col("next_open").alias(out))
    return rows.join(F.broadcast(roll), F.col(day) == F.col("roll_day_"), "left").drop("roll_day_")


def public_notice_date(posted: Column, kind: Column) -> Column:
    """When a public notice takes effect: 20 days after it was posted, 60 for one abroad, 1 for one repeated."""
    return F.date_add(posted, F.when(kind == "abroad", 60).when(kind == "repeat", 1).otherwise(20))


def deadline_columns(service: Column, period: Column, transit: Column) -> tuple[Column, Column]:
    """(first day, last day before it rolls): the day of service doesn't count; travel days come on top of the period."""
    return F.date_add(service, 1), F.date_add(service, (period + transit).cast("int"))


def one_year_due(service: Column) -> Column:
    """The day before the first day's anniversary; of 29 February that is 1 March."""
    start = F.date_add(service, 1)
    leap = (F.month(start) == 2) & (F.dayofmonth(start) == 29)
    return F.when(leap, F.date_add(F.add_months(start, 12), 0)).otherwise(F.date_sub(F.add_months(start, 12), 1))


def residence_column(address: Column, plain: list[str], groups: dict[str, list[str]], cities: list[str]) -> tuple[Column, Column]:
    """(column of the travel table, split city whose district isn't known) that an address names.

    Cities that are split need one of a group's districts too; other names must be the only one that the address has.
    """
    text = F.translate(address, "台", "臺")
    in_city, masked = F.lit(None).cast("string"), F.lit(None).cast("string")
    for city in reversed(cities):
        group = F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, names)), text.contains), F.lit(key)) for key, names in groups.items() if key.startswith(city)], F.lit(None))
        in_city = F.when(text.contains(city), group).otherwise(in_city)
        masked = F.when(text.contains(city), F.lit(city)).otherwise(masked)
    hits = F.filter(F.array(*map(F.lit, plain)), text.contains)
    key = F.when(masked.isNotNull(), in_city).when(F.size(hits) == 1, F.get(hits, F.lit(0)))
    return key, F.when(key.isNull(), masked)


def transit_days_lookup(rows: DataFrame, agency: str, address: str, matrix: DataFrame, groups: dict[str, list[str]], cities: list[str], plain: list[str]) -> DataFrame:
    """rows with transit_days and transit_note. matrix: (agency, residence, days), one row for each pair of places.

    A split city without a known district counts if all its groups are equally far; else the note says by how much not.
    """
    key, masked = residence_column(F.col(address), plain, groups, cities)
    named = rows.withColumns({"t_agency_": F.translate(F.col(agency), "台", "臺"), "t_key_": key, "t_city_": masked})
    table = matrix.select(F.col("agency").alias("m_agency_"), F.col("residence").alias("m_key_"), F.col("days").alias("transit_days"))
    city_of = F.coalesce(*[F.when(F.col("residence").startswith(c), F.lit(c)) for c in cities], F.lit(None).cast("string"))
    spread = matrix.where(F.col("residence").isin(*groups)).groupBy(F.col("agency").alias("c_agency_"), city_of.alias("c_city_")).agg(F.min("days").alias("low_"), F.max("days").alias("high_"))
    out = named.join(small(table), (F.col("t_agency_") == F.col("m_agency_")) & (F.col("t_key_") == F.col("m_key_")), "left")
    out = out.join(small(spread), (F.col("t_agency_") == F.col("c_agency_")) & (F.col("t_city_") == F.col("c_city_")), "left")
    days = F.coalesce("transit_days", F.when(F.col("low_") == F.col("high_"), F.col("low_")))
    note = F.when(F.col("low_") != F.col("high_"), F.concat(F.lit("住居所行政區不明，"), F.col("t_city_"), F.lit("各組相差"), (F.col("high_") - F.col("low_")).cast("string"), F.lit("日")))
    return out.withColumns({"transit_days": days, "transit_note": F.coalesce(note, F.lit(""))}).select(*rows.columns, "transit_days", "transit_note")


def deadline_check(rows: DataFrame, days: DataFrame, standard: int = 30) -> DataFrame:
    """rows with due, overdue (null if undetermined), blocked and note.

    Reads service, filed, transit_days, transit_note, basis (statutory, stated_longer, one_year, restart, undetermined,
    not_assessed), stated_days, corrected (day of a correction's service) and caveat. The basis picks where the period
    starts and how long it is; a one-year period takes no travel days. Caveats and a missing filing day block the override;
    unknown travel days leave the period uncomputed rather than count as 0.
    """
    basis, yearly = F.col("basis"), F.col("basis") == "one_year"
    start = F.when(basis == "restart", F.col("corrected")).otherwise(F.col("service"))
    period = F.when(basis == "stated_longer", F.col("stated_days")).otherwise(F.lit(standard))
    due_raw = F.when(basis == "undetermined", None).when(yearly, one_year_due(F.col("service"))).when(F.col("transit_days").isNotNull(), F.date_add(start, (period + F.col("transit_days")).cast("int")))
    rolled = business_day_roll(rows.withColumn("due_raw_", due_raw), "due_raw_", days, "due")
    overdue = F.col("filed") > F.col("due")
    no_filing = F.when(F.col("due").isNotNull() & F.col("filed").isNull(), "no filing day")
    late_longer = F.when((basis == "stated_longer") & overdue, "beyond the stated period")
    of_basis = F.when(~basis.isin("statutory"), F.concat(F.lit("basis "), basis))
    computed = F.array_join(F.array_compact(F.array(no_filing, of_basis, late_longer, F.nullif(F.col("caveat"), F.lit("")))), ";")
    none = F.when(basis == "undetermined", F.concat(F.lit("not computed, basis undetermined"))).otherwise(F.concat(F.lit("not computed, "), F.when(F.col("due_raw_").isNotNull(), "due day beyond the calendar").when(F.col("transit_note") != "", F.col("transit_note")).otherwise("travel days unknown")))
    return rolled.withColumns({"overdue": overdue, "note": F.when(F.col("due").isNull(), none).otherwise(computed)}).withColumn("blocked", F.col("due").isNotNull() & (F.col("note") != "")).drop("due_raw_")


def reference_coverage(days: DataFrame, day: str, today: Column) -> DataFrame:
    """First, last and number of years that a reference table covers, and whether next year is missing."""
    year = F.year(day)
    return days.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(year).alias("years")).withColumn("stale", F.col("last_year") < F.year(today) + 1)
