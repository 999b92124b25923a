"""Dates of frames, files and climate axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats in which the start of a time axis may be written.
BASE_FORMATS = [
    "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH-mm-ss", "yyyy/MM/dd HH/mm/ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd-HH-mm-ss",
    "yyyy/MM/dd/HH/mm/ss", "yyyy:MM:dd:HH:mm:ss", "yyyy-MM-dd-HH:mm:ss", "yyyy/MM/ddHH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy:MM:dd HH:mm", "yyyyMMdd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd", "yyyy:MM:dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-M-d H:m:s", "yyyy-M-d", "MM/dd/yyyy",
    "dd-MM-yyyy", "yyyy-MM", "yyyy",
]
# Units of a time axis, in the order in which they are looked for.
UNITS = ["seconds", "minutes", "hours", "days", "months", "years"]


def parse_any(text: Column, formats: list[str] | None = None) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats or BASE_FORMATS])


def time_unit(units: Column) -> Column:
    found = F.lit(None).cast("string")
    for u in reversed(UNITS):
        found = F.when(F.contains(F.lower(units), F.lit(u[:-1])), u).otherwise(found)
    return found


def decode_time(value: Column, units: Column) -> Column:
    """Time of ``value`` on an axis of ``units`` such as ``hours since 2000-01-01``; months and years step
    through the calendar."""
    base = parse_any(F.trim(F.regexp_extract(units, r"since\s+(.*)$", 1)))
    unit = time_unit(units)
    seconds = F.when(unit == "seconds", 1).when(unit == "minutes", 60).when(unit == "hours", 3600).when(unit == "days", 86400)
    plain = F.timestamp_micros((F.unix_micros(base.cast("timestamp")) + F.round(value * seconds * 1_000_000)).cast("long"))
    months = F.when(unit == "years", value * 12).otherwise(value).cast("int")
    return F.when(unit.isin("months", "years"), base + F.make_interval(months=months)).otherwise(plain)


def frame_of_name(name: Column, position: int = 1, separator: str = "_") -> Column:
    """Frame number in a file name: the token at ``position``."""
    return F.try_element_at(F.split(name, separator), F.lit(position + 1)).cast("bigint")


def accumulation_frame(name: Column) -> Column:
    """Tokens 1 and 2 of a dotted name, joined."""
    parts = F.split(name, "\\.")
    return F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))


def strike_time(date: Column, time: Column) -> Column:
    """Date and time without the fraction."""
    return F.concat_ws(" ", date, F.substring_index(time, ".", 1))


def frame_hour(frame: Column) -> Column:
    """``yyyyMMddHH`` (or with minutes) as ``yyyy/MM/dd HH:mm:00``."""
    s = frame.cast("string")
    minute = F.when(F.length(s) >= 12, F.substring(s, 11, 2)).otherwise("00")
    return F.concat(F.substring(s, 1, 4), F.lit("/"), F.substring(s, 5, 2), F.lit("/"), F.substring(s, 7, 2), F.lit(" "), F.substring(s, 9, 2), F.lit(":"), minute, F.lit(":00"))


def three_hourly(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Readings every three hours from ``start`` to ``end``: time, day of the year, hour, and the day that
    files are kept under (a midnight reading belongs to the day before)."""
    rows = spark.sql("select explode(sequence(cast(:a as timestamp_ntz), cast(:b as timestamp_ntz), interval 3 hours)) as ts", {"a": start, "b": end})
    return rows.select("ts", F.dayofyear("ts").alias("day"), F.hour("ts").alias("hour"), F.dayofyear(F.expr("ts - interval 3 hours")).alias("folder"), F.date_format("ts", "yyyyMMdd.HH").alias("stamp"))


def reading_links(readings: DataFrame, base: str, prefix: str = "3B42", version: str = "7") -> DataFrame:
    """``link`` of each reading; years before 2011 have an A after the version."""
    a = F.when(F.year("ts") < 2011, "A").otherwise("")
    folder = F.format_string("%04d/%03d", F.year(F.expr("ts - interval 3 hours")), F.col("folder"))
    return readings.withColumn("link", F.concat(F.lit(base.rstrip("/") + "/"), folder, F.lit(f"/{prefix}."), F.col("stamp"), F.lit(f".{version}"), a, F.lit(".HDF")))


def daily_links(spark: SparkSession, start: str, end: str, base: str, prefix: str = "3B42_daily", suffix: str = "7.bin") -> DataFrame:
    """``link`` of each day's file; it is kept under the day before, the year's first under the last of the year
    before."""
    days = spark.sql("select explode(sequence(cast(:a as date), cast(:b as date))) as day", {"a": start, "b": end})
    folder = F.format_string("%04d/%03d", F.year(F.date_sub("day", 1)), F.dayofyear(F.date_sub("day", 1)))
    return days.select(F.concat(F.lit(base.rstrip("/") + "/"), folder, F.lit(f"/{prefix}."), F.date_format("day", "yyyy.MM.dd"), F.lit(f".{suffix}")).alias("link"))


def dap_constraint(variable: str, *ranges: tuple[int, ...]) -> str:
    """As ``name[0:1:399][0:1:1439]``, of (first, last) or (first, step, last) on each axis."""
    return variable + "".join(f"[{r[0]}:{r[1] if len(r) == 3 else 1}:{r[-1]}]" for r in ranges)


def dates_between(spark: SparkSession, start: str, n: int) -> DataFrame:
    return spark.sql("select explode(sequence(cast(:a as date), date_add(cast(:a as date), :n - 1))) as day", {"a": start, "n": n})


def url_group(url: Column, n: int, prefix: str = "") -> Column:
    """The first ``n`` characters of the file's name after ``prefix``: 4 group by year, 8 by day."""
    return F.substring(F.regexp_replace(F.element_at(F.split(url, "/"), -1), f"^{prefix}", ""), 1, n)
